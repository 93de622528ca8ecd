"""Numbers from binary columns: fixed widths in either byte order, LEB128, dates of file formats, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import as_column, let, slice_


def _unsigned(piece: Column, width: int) -> Column:
    text = F.conv(F.hex(piece), 16, 10)
    return text.cast("decimal(20,0)") if width == 8 else text.cast("long")


def uint(b: Column, offset: Column | int, width: int, little: bool = True) -> Column:
    """Unsigned integer of 1 to 8 bytes at offset; long, decimal(20,0) for 8 bytes; null unless all bytes are there."""
    offset = as_column(offset)
    piece = slice_(b, offset, offset + width)
    if little and width > 1:
        piece = F.unhex(F.concat(*(F.substring(F.hex(piece), 2 * i + 1, 2) for i in range(width - 1, -1, -1))))
    return _unsigned(piece, width)


def sint(b: Column, offset: Column | int, width: int, little: bool = True) -> Column:
    """Two's-complement integer of 1 to 8 bytes at offset, as long."""
    u = uint(b, offset, width, little)
    if width == 8:
        return F.when(u >= F.lit(str(1 << 63)).cast("decimal(20,0)"), u - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(u).cast("long")
    return F.when(u >= 1 << (8 * width - 1), u - (1 << 8 * width)).otherwise(u)


def double(b: Column, offset: Column | int = 0, little: bool = True) -> Column:
    """The IEEE double of 8 bytes at offset; null unless all bytes are there."""
    offset = as_column(offset)
    piece = slice_(b, offset, offset + 8)
    h = F.hex(piece)
    if little:
        h = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)))
    head, tail = F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), F.conv(F.substring(h, 4, 13), 16, 10).cast("double")
    power, sign = head.bitwiseAND(2047), F.when(head >= 2048, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = F.when(power == 0, tail * F.lit(5e-324)).otherwise((tail + F.lit(float(1 << 52))) * F.pow(F.lit(2.0), power - 1075))
    return F.when(piece.isNull(), F.lit(None)).when(power == 2047, F.when(tail > 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))).otherwise(sign * size)


def adler32(b: Column) -> Column:
    """Adler-32 of a binary, as long; null for null."""
    h = F.hex(b)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda a, i: let((a["a"] + byte(i)) % 65521, lambda x: F.struct(x.alias("a"), ((a["b"] + x) % 65521).alias("b")))
    sums = F.aggregate(places, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), step)
    return F.when(b.isNotNull(), let(sums, lambda x: x["b"] * 65536 + x["a"]))


def _leb_digits(b: Column, offset: Column) -> Column:
    """Hexadecimal digits of the LEB128 number at offset: up to the first byte below 128; null if there is none in ten."""
    return F.regexp_substr(F.hex(F.substring(b, offset + 1, F.lit(10))), F.lit(r"\A(?:[89A-F].){0,9}[0-7]."))


def uleb128(b: Column, offset: Column | int = 0) -> Column:
    """struct(value decimal(38,0), length int) of an unsigned LEB128 number of up to ten bytes; null if it doesn't end."""

    def value(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        short = F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda acc, i: acc * 128 + F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("long") % 128)
        wide = F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.lit(0).cast("decimal(38,0)"), lambda acc, i: (acc * 128 + (F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 128).cast("decimal(10,0)")).cast("decimal(38,0)"))
        return F.when(h.isNotNull(), F.struct(F.when(n <= 8, short.cast("decimal(38,0)")).otherwise(wide).alias("value"), n.alias("length")))

    return let(_leb_digits(b, as_column(offset)), value)


def sleb128(b: Column, offset: Column | int = 0) -> Column:
    """struct(value decimal(38,0), length int) of a signed LEB128 number: the last byte's bit 6 is the sign."""

    def sign(u: Column) -> Column:
        last = F.conv(F.hex(F.substring(b, as_column(offset) + u["length"], F.lit(1))), 16, 10).cast("int")
        span = F.aggregate(F.sequence(F.lit(1), u["length"]), F.lit(1).cast("decimal(38,0)"), lambda a, _: (a * 128).cast("decimal(38,0)"))
        return F.struct(F.when(last.bitwiseAND(64) != 0, u["value"] - span).otherwise(u["value"]).cast("decimal(38,0)").alias("value"), u["length"].alias("length"))

    return let(uleb128(b, offset), lambda u: F.when(u.isNotNull(), sign(u)))


def uleb128p1(b: Column, offset: Column | int = 0) -> Column:
    """An unsigned LEB128 number less one: -1 stands for absent."""
    return let(uleb128(b, offset), lambda u: F.when(u.isNotNull(), F.struct((u["value"] - 1).cast("decimal(38,0)").alias("value"), u["length"].alias("length"))))


def safe_number(value: Column) -> Column:
    """As long if a double holds it exactly, else null."""
    return F.when(F.abs(value) <= (1 << 53) - 1, value.cast("long"))


def wrap32(value: Column) -> Column:
    """The low 32 bits as a signed int, as unchecked 32-bit arithmetic leaves them."""
    low = F.pmod(value.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")).cast("long")
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def nibbles(byte: Column) -> Column:
    """struct(high, low) of a byte."""
    return F.struct(F.shiftright(byte, 4).bitwiseAND(15).alias("high"), byte.bitwiseAND(15).alias("low"))


def align(position: Column, k: int) -> Column:
    """Bytes to skip to the next multiple of k."""
    return F.pmod(F.lit(k) - F.pmod(position, F.lit(k)), F.lit(k))


def flags(value: Column, names: dict[str, int]) -> Column:
    """struct of booleans for the bits of a mask."""
    return F.struct(*(((value.bitwiseAND(F.lit(bit))) != 0).alias(name) for name, bit in names.items()))


def dos_datetime(time: Column, date: Column) -> Column:
    """Timestamp from DOS time and date words (two-second resolution); null if the fields are no date."""
    part = lambda v, shift, mask: F.shiftright(v, shift).bitwiseAND(mask).cast("int")
    return F.try_make_timestamp(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), (part(time, 0, 31) * 2).cast("decimal(16,6)"))


def dos_words(ts: Column) -> Column:
    """struct(time, date): the inverse for 1980 to 2107."""
    time = F.shiftleft(F.hour(ts), 11) + F.shiftleft(F.minute(ts), 5) + F.floor(F.second(ts) / 2)
    date = F.shiftleft(F.year(ts) - 1980, 9) + F.shiftleft(F.month(ts), 5) + F.dayofmonth(ts)
    return F.struct(time.cast("int").alias("time"), date.cast("int").alias("date"))


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value.cast("long"))


def to_bytes(value: Column, width: int, little: bool = True) -> Column:
    """Unsigned integer as a binary of `width` bytes: the writer's side of uint."""
    h = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    h = F.substring(h, -2 * width, 2 * width)
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1))) if little else h)
