"""Android packages: a ZIP archive with a signing block before its central directory."""

from __future__ import annotations

import struct

from ..operators.cursor import Cursor
from . import zip_archive

MAGIC = b"APK Sig Block 42"
PADDING, V2 = 0x42726577, 0x7109871A


def _prefixed(c: Cursor, width: int = 4) -> Cursor:
    return c.inner(c.number(width))


def _list(c: Cursor, item) -> list:  # noqa: ANN001
    inner, out = _prefixed(c), []
    while not inner.done():
        out.append(item(_prefixed(inner)))
    return out


def _rest(c: Cursor) -> bytes:
    return c.take(c.end - c.at)


def _algorithm(c: Cursor) -> dict:
    return {"algorithm": c.number(4), "value": c.take(c.number(4))}


def _signer(c: Cursor) -> dict:
    signed = _prefixed(c)
    data = {"digests": _list(signed, _algorithm), "certificates": _list(signed, _rest), "attributes": _list(signed, lambda a: {"id": a.number(4), "value": _rest(a)})}
    data["padding"] = len(_rest(signed))
    return {"signed_data": data, "signatures": _list(c, _algorithm), "public_key": c.take(c.number(4))}


def _pair(c: Cursor) -> dict:
    inner = _prefixed(c, 8)
    key = inner.number(4)
    if key == PADDING:
        return {"id": key, "padding": len(_rest(inner))}
    if key == V2:
        return {"id": key, "signers": _list(inner, _signer)}
    return {"id": key, "value": _rest(inner)}


def signing_block(c: Cursor) -> dict:
    size = c.number(8)
    if size < 24:
        raise c.fail("Unexpected", "a signing block is larger")
    inner, pairs = c.inner(size - 24), []
    while not inner.done():
        pairs.append(_pair(inner))
    if c.number(8) != size:
        raise c.fail("Unexpected", "the two sizes of the signing block differ")
    c.expect(MAGIC)
    return {"pairs": pairs}


def package(c: Cursor) -> dict:
    return zip_archive.archive(c, signing_block)


def signable_sections(data: bytes) -> list[bytes]:
    """What a signature covers: before the signing block, central directory, end record (with the block's offset in it)."""
    end = data.rfind(zip_archive.END)
    if end < 0:
        raise Cursor(data).fail("Unexpected", "no end record")
    directory = struct.unpack_from("<I", data, end + 16)[0]
    start = directory
    if data[directory - 16 : directory] == MAGIC:
        start = directory - 8 - struct.unpack_from("<Q", data, directory - 24)[0]
    return [data[:start], data[directory:end], data[end : end + 16] + struct.pack("<I", start) + data[end + 20 :]]


def write_block(pairs: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<QI", len(v) + 4, k) + v for k, v in pairs)
    size = struct.pack("<Q", len(body) + 24)
    return size + body + size + MAGIC
