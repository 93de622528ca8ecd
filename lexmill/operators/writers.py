"""Writers over columns: a writer is a function from a value to the string or binary that stands for it; they compose as rules do."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import to_bytes
from ..functions.sequence import as_column, let

Writer = Callable[[Column], Column]


def constant(what: str | bytes) -> Writer:
    return lambda _: F.lit(what)


def as_is() -> Writer:
    return lambda v: v


def integer(width: int, little: bool = True) -> Writer:
    """An unsigned integer of so many bytes."""
    return lambda v: to_bytes(v, width, little)


def fields(writers: Mapping[str, Writer]) -> Writer:
    """A record's fields one after the other, in the order of the mapping; a field the record lacks takes a constant."""
    return lambda v: F.concat(*(w(v) if k.startswith("_") else w(v[k]) for k, w in writers.items()))


def array_of(w: Writer, separator: str = "") -> Writer:
    """An array's items, strings, with a separator between each two."""
    return lambda v: F.array_join(F.transform(v, w), separator)


def bytes_of(w: Writer) -> Writer:
    """An array's items, binaries, one after the other."""
    return lambda v: F.unhex(F.array_join(F.transform(v, lambda x: F.hex(w(x))), ""))


def prefixed(w: Writer, width: int, little: bool = True) -> Writer:
    """What w writes, behind its number of bytes."""
    return lambda v: let(w(v), lambda b: F.concat(to_bytes(F.octet_length(b).cast("long"), width, little), b))


def choice(tests: Sequence[tuple[Callable[[Column], Column], Writer]]) -> Writer:
    """The first writer whose test the value passes; none of them gives null."""

    def run(v: Column) -> Column:
        out = None
        for test, w in tests:
            out = F.when(test(v), w(v)) if out is None else out.when(test(v), w(v))
        return out if out is not None else F.lit(None)

    return run


def offsets(parts: Sequence[Column], before: int = 0) -> list[Column]:
    """Where each of several binaries begins if they are written one after the other behind `before` bytes."""
    out, at = [], F.lit(before).cast("long")
    for p in parts:
        out.append(at)
        at = at + F.octet_length(p).cast("long")
    return out


def with_table(parts: Sequence[Column], width: int = 4, little: bool = True) -> Column:
    """Binaries behind a table of their offsets: what is written first tells of what is known only later."""
    table = [to_bytes(as_column(o), width, little) for o in offsets(parts, width * len(parts))]
    return F.concat(*table, *parts)
