"""Dalvik executables: header and identifier sections, each a table keyed by its place, resolved by joins elsewhere."""

from __future__ import annotations

from ..operators.cursor import Cursor
from .dex_data import annotations, code_item, encoded_array
from .keystore import modified_utf8
from .numbers import uleb128

HEADER = ("string_ids", "type_ids", "proto_ids", "field_ids", "method_ids", "class_defs")
NO_INDEX = 0xFFFFFFFF


def header(c: Cursor) -> dict:
    c.expect(b"dex\n")
    version = c.take(4)[:3].decode("ascii", "replace")
    checksum, signature, size, header_size, endian = c.number(4), c.take(20), c.number(4), c.number(4), c.number(4)
    link_size, link_offset, map_offset = c.number(4), c.number(4), c.number(4)
    out = {"version": version, "checksum": checksum, "signature": signature, "file_size": size, "header_size": header_size, "endian_tag": endian, "link_size": link_size, "link_offset": link_offset, "map_offset": map_offset}
    for name in HEADER:
        out[name] = (c.number(4), c.number(4))
    out["data"] = (c.number(4), c.number(4))
    return out


def _rows(c: Cursor, where: tuple[int, int], widths: tuple[int, ...], names: tuple[str, ...]) -> list[dict]:
    n, offset = where
    part = Cursor(c.data, offset, c.end)
    return [{"idx": i, **{k: part.number(w) for k, w in zip(names, widths, strict=True)}} for i in range(n)]


def _types(c: Cursor, offset: int) -> list[int]:
    if not offset:
        return []
    part = Cursor(c.data, offset, c.end)
    return [part.number(2) for _ in range(part.number(4))]


def _class_data(c: Cursor, offset: int) -> dict:
    """Fields and methods; their indices are stored as differences, and summed here."""
    out: dict = {"static_fields": [], "instance_fields": [], "direct_methods": [], "virtual_methods": []}
    if offset:
        part = Cursor(c.data, offset, c.end)
        sizes = [uleb128(part) for _ in range(4)]
        for (name, rows), n in zip(out.items(), sizes, strict=True):
            idx = 0
            for _ in range(n):
                idx += uleb128(part)
                rows.append({"idx": idx, "access_flags": uleb128(part)} | ({"code": code_item(c, uleb128(part))} if "methods" in name else {}))
    return out


def executable(c: Cursor) -> dict:
    """{header, string_ids, string_data, type_ids, proto_ids, field_ids, method_ids, class_defs, map, link}."""
    h = header(c)
    out: dict = {"header": h, "string_ids": _rows(c, h["string_ids"], (4,), ("offset",))}
    data = []
    for r in out["string_ids"]:
        part = Cursor(c.data, r["offset"], c.end)
        uleb128(part)  # its length in UTF-16 units
        data.append({"offset": r["offset"], "value": modified_utf8(part.until(b"\0"))})
    out["string_data"] = data
    out["type_ids"] = _rows(c, h["type_ids"], (4,), ("string_idx",))
    out["proto_ids"] = [r | {"parameters": _types(c, r.pop("parameters_offset"))} for r in _rows(c, h["proto_ids"], (4, 4, 4), ("shorty_idx", "return_type_idx", "parameters_offset"))]
    out["field_ids"] = _rows(c, h["field_ids"], (2, 2, 4), ("class_idx", "type_idx", "name_idx"))
    out["method_ids"] = _rows(c, h["method_ids"], (2, 2, 4), ("class_idx", "proto_idx", "name_idx"))
    out["class_defs"] = [r | {"interfaces": _types(c, r["interfaces_offset"]), "annotations": annotations(c, r["annotations_offset"]), "static_values": encoded_array(Cursor(c.data, r["static_values_offset"], c.end)) if r["static_values_offset"] else [], "data": _class_data(c, r["class_data_offset"])} for r in _rows(c, h["class_defs"], (4,) * 8, ("class_idx", "access_flags", "superclass_idx", "interfaces_offset", "source_file_idx", "annotations_offset", "class_data_offset", "static_values_offset"))]
    part = Cursor(c.data, h["map_offset"], c.end)
    out["map"] = [{"type": part.number(2), "unused": part.number(2), "size": part.number(4), "offset": part.number(4)} for _ in range(part.number(4))] if h["map_offset"] else []
    out["link"] = Cursor(c.data, h["link_offset"], c.end).take(h["link_size"]) if h["link_size"] else None
    c.at = c.end
    return out
