"""BSON documents of doubles, strings, documents, arrays, booleans, nulls and 32-bit integers."""

from __future__ import annotations

import struct

from ..operators.cursor import Cursor


def _utf8(c: Cursor, raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise c.fail("Unexpected", "no UTF-8") from e


def _string(c: Cursor) -> str:
    raw = c.take(c.number(4))
    if raw[-1:] != b"\0":
        raise c.fail("Unexpected", "a string ends with a zero byte")
    return _utf8(c, raw[:-1])


def _element(c: Cursor) -> tuple[str, object]:
    kind = c.number(1)
    name = _utf8(c, c.until(b"\0"))
    if kind == 1:
        return name, struct.unpack("<d", c.take(8))[0]
    if kind == 2:
        return name, _string(c)
    if kind == 3:
        return name, document(c)
    if kind == 4:
        return name, list(document(c).values())
    if kind == 8:
        return name, c.number(1) == 1
    if kind == 10:
        return name, None
    if kind == 16:
        return name, c.number(4, signed=True)
    raise c.fail("Unexpected", f"element type {kind}")


def document(c: Cursor) -> dict:
    """A document; its stated size is read and not relied on."""
    c.take(4)
    out = {}
    while not c.accept(b"\0"):
        name, v = _element(c)
        out[name] = v
    return out


def write(value: dict | list) -> bytes:
    """The inverse. Integers beyond 32 bits become doubles."""
    items = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
    out = b""
    for name, v in items:
        key = name.encode() + b"\0"
        if v is None:
            out += b"\x0a" + key
        elif isinstance(v, bool):
            out += b"\x08" + key + bytes([v])
        elif isinstance(v, int) and -(1 << 31) <= v < 1 << 31:
            out += b"\x10" + key + struct.pack("<i", v)
        elif isinstance(v, int | float):
            out += b"\x01" + key + struct.pack("<d", v)
        elif isinstance(v, str):
            raw = v.encode() + b"\0"
            out += b"\x02" + key + struct.pack("<I", len(raw)) + raw
        elif isinstance(v, dict | list):
            out += (b"\x03" if isinstance(v, dict) else b"\x04") + key + write(v)
        else:
            raise TypeError(f"no BSON for {type(v).__name__}")
    return struct.pack("<I", len(out) + 5) + out + b"\0"
