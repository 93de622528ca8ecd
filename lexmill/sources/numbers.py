"""Numbers of variable length, read from a cursor and written."""

from __future__ import annotations

from ..operators.cursor import Cursor


def uleb128(c: Cursor) -> int:
    out = shift = 0
    while True:
        b = c.number(1)
        out |= (b & 127) << shift
        if b < 128:
            return out
        shift += 7


def sleb128(c: Cursor) -> int:
    out = shift = 0
    while True:
        b = c.number(1)
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out - (1 << shift) if b & 64 else out


def to_uleb128(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def to_sleb128(n: int) -> bytes:
    out = b""
    while not -64 <= n < 64:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n & 127])
