"""Java keystores with private-key entries."""

from __future__ import annotations

import struct

from ..operators.cursor import Cursor

MAGIC = {b"\xfe\xed\xfe\xed": "JKS", b"\xce\xce\xce\xce": "JCEKS"}


def modified_utf8(raw: bytes) -> str:
    """Strings as Java writes them: zero as two bytes, characters beyond the basic plane as two surrogates."""
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def to_modified_utf8(text: str) -> bytes:
    units = text.encode("utf-16-be")
    return b"".join(chr(int.from_bytes(units[i : i + 2], "big")).encode("utf-8", "surrogatepass") for i in range(0, len(units), 2)).replace(b"\0", b"\xc0\x80")


def _text(c: Cursor) -> str:
    return modified_utf8(c.take(c.number(2, "big")))


def _entry(c: Cursor) -> dict:
    kind = c.number(4, "big")
    if kind != 1:
        raise c.fail("Unexpected", f"entries of kind {kind} aren't supported")
    alias, created = _text(c), c.number(8, "big")
    key = c.take(c.number(4, "big"))
    chain = [{"type": _text(c), "certificate": c.take(c.number(4, "big"))} for _ in range(c.number(4, "big"))]
    return {"type": "privateKey", "alias": alias, "created_millis": created, "private_key": key, "certificates": chain}


def keystore(c: Cursor) -> dict:
    """{implementation, version, entries, hash}; the hash isn't checked."""
    magic = c.take(4)
    if magic not in MAGIC:
        raise c.fail("Unexpected", "no keystore")
    version = c.number(4, "big")
    return {"implementation": MAGIC[magic], "version": version, "entries": [_entry(c) for _ in range(c.number(4, "big"))], "hash": c.take(20)}


def write(value: dict) -> bytes:
    text = lambda s: struct.pack(">H", len(to_modified_utf8(s))) + to_modified_utf8(s)
    data = lambda b: struct.pack(">I", len(b)) + b
    out = {v: k for k, v in MAGIC.items()}[value["implementation"]] + struct.pack(">II", value["version"], len(value["entries"]))
    for e in value["entries"]:
        out += struct.pack(">I", 1) + text(e["alias"]) + struct.pack(">Q", e["created_millis"]) + data(e["private_key"]) + struct.pack(">I", len(e["certificates"]))
        out += b"".join(text(x["type"]) + data(x["certificate"]) for x in e["certificates"])
    return out + value["hash"]
