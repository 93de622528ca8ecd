"""The primitives every operator stands on, alike for string columns (code points) and binary columns (bytes).

Positions count from 0. Ranges that reach beyond the end give null, not a shorter piece; -1 says "not found".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it; keeps nested expressions linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(s: Column) -> Column:
    """Elements of a string or binary."""
    return F.length(s)


def is_text(s: Column) -> Column:
    """Is a sequence of characters, not of bytes."""
    return F.typeof(s) == "string"


def utf16_length(s: Column) -> Column:
    """Length of a string in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def slice_(s: Column, start: Column | int, end: Column | int) -> Column:
    """Elements start (included) to end (excluded); null unless all of them are there."""
    start, end = as_column(start), as_column(end)
    return F.when((start >= 0) & (end >= start) & (end <= F.length(s)), F.substring(s, start + 1, end - start))


def at(s: Column, i: Column | int) -> Column:
    """The element at i as a sequence of one; negative positions count from the end; null if out of range."""
    i = as_column(i)
    i = F.when(i < 0, F.length(s) + i).otherwise(i)
    return F.when((i >= 0) & (i < F.length(s)), F.substring(s, i + 1, F.lit(1)))


def byte_at(b: Column, i: Column | int) -> Column:
    """The byte at i as an int from 0 to 255; null if out of range."""
    return F.conv(F.hex(at(b, i)), 16, 10).cast("int")


def index_of(s: Column, what: Column | str | bytes, start: Column | int = 0) -> Column:
    """Position of the first occurrence at or after start, else -1. An empty subsequence is found at start."""
    if isinstance(start, int) and start == 0:
        return (F.position(as_column(what), s) - 1).cast("int")
    start, what = as_column(start), as_column(what)
    found = F.position(what, F.substring(s, start + 1, F.greatest(F.length(s) - start, F.lit(0))))
    return F.when(F.length(what) == 0, start).when(found > 0, found - 1 + start).otherwise(F.lit(-1)).cast("int")


def rest_from(s: Column, start: Column | int) -> Column:
    """What follows position start; empty beyond the end."""
    return F.substring(s, as_column(start) + 1, F.lit(2**31 - 1))


def equals(a: Column, b: Column) -> Column:
    return a == b


def bytes_from(elements: Column) -> Column:
    """A binary from an array of ints 0 to 255."""
    return F.unhex(F.array_join(F.transform(elements, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def string_from(elements: Column) -> Column:
    """A string from an array of strings."""
    return F.array_join(elements, "")


def starts_with(s: Column, what: Column | str | bytes) -> Column:
    """Does s begin with what; for binaries a comparison of a slice."""
    what = as_column(what)
    return F.substring(s, F.lit(1), F.length(what)) == what
