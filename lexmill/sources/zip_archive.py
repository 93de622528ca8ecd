"""ZIP archives, forward: local files, central directory, end record; entries are paired by their place."""

from __future__ import annotations

import struct
import zlib
from datetime import UTC, datetime

from ..operators.cursor import Cursor

LOCAL, CENTRAL, END, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"
METHODS = {0: "store", 8: "deflate"}


def dos_datetime(time: int, date: int) -> datetime:
    return datetime((date >> 9) + 1980, max(1, date >> 5 & 15), max(1, date & 31), time >> 11, time >> 5 & 63, min(59, (time & 31) * 2), tzinfo=UTC)


def _method(c: Cursor, n: int) -> str:
    if n not in METHODS:
        raise c.fail("Unexpected", f"compression method {n}")
    return METHODS[n]


def _inflate(c: Cursor, raw: bytes) -> bytes:
    try:
        d = zlib.decompressobj(-15)
        return d.decompress(raw) + d.flush()
    except zlib.error as e:
        raise c.fail("Unexpected", f"deflated data: {e}") from e


def local_file(c: Cursor) -> dict:
    """One local file; behind bit 3 of the flags the sizes follow the data, in a descriptor with or without a signature."""
    c.expect(LOCAL)
    c.number(2)
    bits, method, time, date = (c.number(2) for _ in range(4))
    crc, packed, size, n_name, n_extra = c.number(4), c.number(4), c.number(4), c.number(2), c.number(2)
    name, extra = c.take(n_name), c.take(n_extra)
    if bits & 1:
        raise c.fail("Unexpected", "encrypted entries aren't supported")
    if bits & 8 and not packed:
        if _method(c, method) == "deflate":
            d = zlib.decompressobj(-15)
            try:
                content = d.decompress(c.data[c.at : c.end])
            except zlib.error as e:
                raise c.fail("Unexpected", f"deflated data: {e}") from e
            packed = c.end - c.at - len(d.unused_data)
            raw = c.take(packed)
        else:  # stored without sizes: up to the descriptor that fits
            i = c.data.find(DESCRIPTOR, c.at, c.end)
            while i >= 0 and struct.unpack_from("<I", c.data, i + 8)[0] != i - c.at:
                i = c.data.find(DESCRIPTOR, i + 1, c.end)
            if i < 0:
                raise c.fail("Unterminated", "no data descriptor")
            content = raw = c.take(i - c.at)
        c.accept(DESCRIPTOR)
        crc, packed, size = c.number(4), c.number(4), c.number(4)
    else:
        raw = c.take(packed)
        content = _inflate(c, raw) if _method(c, method) == "deflate" else raw
        if bits & 8:
            c.accept(DESCRIPTOR)
            c.take(12)
    return {"name": name, "bits": bits, "method": METHODS[method], "date": dos_datetime(time, date), "crc": crc, "packed_size": len(raw), "size": size, "extra": extra, "content": content}


def central_header(c: Cursor) -> dict:
    c.expect(CENTRAL)
    made, host = c.number(1), c.number(1)
    c.number(2)
    bits, method, time, date = (c.number(2) for _ in range(4))
    crc, packed, size, n_name, n_extra, n_comment = c.number(4), c.number(4), c.number(4), c.number(2), c.number(2), c.number(2)
    c.take(4)
    external, offset = c.number(4), c.number(4)
    name, extra, comment = c.take(n_name), c.take(n_extra), c.take(n_comment)
    return {"name": name, "version": made, "host": {0: "dos", 3: "unix"}.get(host, str(host)), "bits": bits, "method": method, "date": dos_datetime(time, date), "crc": crc, "packed_size": packed, "size": size, "external": external, "offset": offset, "extra": extra, "comment": comment}


def end_record(c: Cursor) -> dict:
    c.expect(END)
    c.take(4)
    c.number(2)
    return {"entries": c.number(2), "size": c.number(4), "offset": c.number(4), "comment": c.take(c.number(2))}


def _directory(entry: dict) -> bool:
    return bool(entry["external"] & 16) if entry["host"] == "dos" else (entry["external"] >> 28) == 4 or entry["name"].endswith(b"/")


def entries(local: list[dict], central: list[dict]) -> list[dict]:
    """The i-th local file with the i-th central header."""
    out = []
    for a, b in zip(local, central, strict=False):
        folder = _directory(b)
        out.append({"type": "directory" if folder else "file", "path": b["name"].decode("utf-8", "replace"), "date": b["date"], "comment": b["comment"].decode("utf-8", "replace"), "host": b["host"], "compression": None if folder else a["method"], "content": None if folder else a["content"]})
    return out


def archive(c: Cursor, between=None) -> dict:  # noqa: ANN001
    """{comment, entries}; between: a rule of what may stand before the central directory."""
    local = c.repeat(local_file) if not c.starts(END) else []
    if not (c.starts(CENTRAL) or c.starts(END)) and between is None:
        local_file(c)  # for its failure
    extra = None
    if between is not None:
        ok, extra = c.attempt(between)
        extra = extra if ok else None
    central = []
    while c.starts(CENTRAL):
        central.append(central_header(c))
    end = end_record(c)
    if len(local) != len(central):
        raise c.fail("Unexpected", f"{len(local)} local files and {len(central)} headers")
    out = {"comment": end["comment"].decode("utf-8", "replace"), "entries": entries(local, central)}
    return out | {"signing_block": extra} if between is not None else out


def write(value: dict, data_descriptor: bool = False) -> bytes:
    """The inverse of archive."""
    body, directory = b"", b""
    for e in value["entries"]:
        name, content = e["path"].encode(), e.get("content") or b""
        deflate = e.get("compression") == "deflate" and e["type"] == "file"
        raw = content
        if deflate:
            d = zlib.compressobj(wbits=-15)
            raw = d.compress(content) + d.flush()
        t = e["date"]
        time, date = t.hour << 11 | t.minute << 5 | t.second // 2, (t.year - 1980) << 9 | t.month << 5 | t.day
        sizes, bits = (zlib.crc32(content), len(raw), len(content)), 0x800 | (8 if data_descriptor else 0)
        head = struct.pack("<HHHHH", 20, bits, 8 if deflate else 0, time, date)
        unix = e.get("host") == "unix"
        external = (0o040755 if e["type"] == "directory" else 0o100644) << 16 if unix else (16 if e["type"] == "directory" else 0)
        comment = (e.get("comment") or "").encode()
        directory += CENTRAL + struct.pack("<BB", 20, 3 if unix else 0) + head + struct.pack("<IIIHHHHHII", *sizes, len(name), 0, len(comment), 0, 0, external, len(body)) + name + comment
        body += LOCAL + head + struct.pack("<IIIHH", *((0, 0, 0) if data_descriptor else sizes), len(name), 0) + name + raw
        if data_descriptor:
            body += DESCRIPTOR + struct.pack("<III", *sizes)
    comment = (value.get("comment") or "").encode()
    n = len(value["entries"])
    return body + directory + END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), len(body), len(comment)) + comment
