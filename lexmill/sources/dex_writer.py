"""Dalvik executables written from their pools and classes: sections, then data, then the map of what lies where."""

from __future__ import annotations

import struct

from . import dalvik_bytecode
from .dex_data import DEBUG, FLOATS, SIGNED, VALUE_KINDS, VISIBILITIES
from .keystore import to_modified_utf8
from .numbers import to_sleb128, to_uleb128

#: Section types of the map, in the order of the pools, then of data.
POOLS = {"string_ids": 0x0001, "type_ids": 0x0002, "proto_ids": 0x0003, "field_ids": 0x0004, "method_ids": 0x0005, "class_defs": 0x0006}
DATA = {"map": 0x1000, "type_list": 0x1001, "set_refs": 0x1002, "set": 0x1003, "class_data": 0x2000, "code": 0x2001, "string_data": 0x2002, "debug": 0x2003, "annotation": 0x2004, "array": 0x2005, "directory": 0x2006}
VALUE_CODES = {name: code for code, name in VALUE_KINDS.items()}


def encoded_value(v: dict) -> bytes:
    kind, x = v["type"], v["value"]
    code = VALUE_CODES[kind]
    if kind == "null":
        return bytes([code])
    if kind == "boolean":
        return bytes([code | bool(x) << 5])
    if kind == "array":
        return bytes([code]) + encoded_array(x)
    if kind == "annotation":
        return bytes([code]) + encoded_annotation(x)
    if kind in FLOATS:
        raw = struct.pack(FLOATS[kind][0], x).lstrip(b"\0") or b"\0"
    else:
        signed = kind in SIGNED
        n = 1
        while not (-(1 << 8 * n - 1) <= x < 1 << 8 * n - 1 if signed else x < 1 << 8 * n):
            n += 1
        raw = x.to_bytes(n, "little", signed=signed)
    return bytes([code | len(raw) - 1 << 5]) + raw


def encoded_array(values: list[dict]) -> bytes:
    return to_uleb128(len(values)) + b"".join(map(encoded_value, values))


def encoded_annotation(a: dict) -> bytes:
    return to_uleb128(a["type_idx"]) + to_uleb128(len(a["elements"])) + b"".join(to_uleb128(e["name_idx"]) + encoded_value(e["value"]) for e in a["elements"])


def debug_info(d: dict) -> bytes:
    index = lambda n: to_uleb128(0 if n is None else n + 1)
    out = to_uleb128(d["line_start"]) + to_uleb128(len(d["parameter_names"])) + b"".join(map(index, d["parameter_names"]))
    for x in d["codes"]:
        if x["op"] == "special":
            out += bytes([x["value"]])
            continue
        out += bytes([DEBUG.index(x["op"])])
        if "value" in x:
            out += (to_sleb128 if x["op"] == "advance_line" else to_uleb128)(x["value"])
        if "register" in x:
            out += to_uleb128(x["register"])
        out += b"".join(index(x[n]) for n in ("name_idx", "type_idx", "signature_idx") if n in x)
    return out + b"\0"


def code_item(code: dict, debug_at: int) -> bytes:
    body = dalvik_bytecode.write(code["instructions"])
    out = struct.pack("<4H2I", code["registers"], code["ins"], code["outs"], len(code["tries"]), debug_at, len(body) // 2) + body
    if not code["tries"]:
        return out
    lists = []
    for t in code["tries"]:
        n, rest = len(t["handlers"]), b"" if t["catch_all"] is None else to_uleb128(t["catch_all"])
        lists.append(to_sleb128(n if t["catch_all"] is None else -n) + b"".join(to_uleb128(h["type_idx"]) + to_uleb128(h["address"]) for h in t["handlers"]) + rest)
    distinct = list(dict.fromkeys(lists))
    count = to_uleb128(len(distinct))
    place, at = {}, len(count)
    for raw in distinct:
        place[raw], at = at, at + len(raw)
    rows = b"".join(struct.pack("<IHH", t["start"], t["count"], place[raw]) for t, raw in zip(code["tries"], lists, strict=True))
    return out + b"\0\0" * (len(body) // 2 % 2) + rows + count + b"".join(distinct)


class _Data:
    """The data section while it grows; where each kind begins and how many items it has."""

    def __init__(self, start: int) -> None:
        self.start, self.blob = start, bytearray()
        self.sections: dict[int, list[int]] = {}

    def add(self, kind: str, raw: bytes, align: int = 1) -> int:
        self.blob += b"\0" * (-(self.start + len(self.blob)) % align)
        at = self.start + len(self.blob)
        self.blob += raw
        self.sections.setdefault(DATA[kind], [at, 0])[1] += 1
        return at

    def type_list(self, idx: list[int]) -> int:
        return self.add("type_list", struct.pack(f"<I{len(idx)}H", len(idx), *idx), 4) if idx else 0

    def annotation_set(self, items: list[dict]) -> int:
        if not items:
            return 0
        at = [self.add("annotation", bytes([VISIBILITIES.index(a["visibility"])]) + encoded_annotation(a)) for a in items]
        return self.add("set", struct.pack(f"<{len(at) + 1}I", len(at), *at), 4)

    def directory(self, a: dict | None) -> int:
        if not a or not any(a.values()):
            return 0
        rows = [(x["idx"], self.annotation_set(x["annotations"])) for kind in ("fields", "methods") for x in a[kind]]
        for x in a["parameters"]:
            sets = [self.annotation_set(s) for s in x["annotations"]]
            rows.append((x["idx"], self.add("set_refs", struct.pack(f"<{len(sets) + 1}I", len(sets), *sets), 4)))
        head = struct.pack("<4I", self.annotation_set(a["class"]), len(a["fields"]), len(a["methods"]), len(a["parameters"]))
        return self.add("directory", head + b"".join(struct.pack("<II", *r) for r in rows), 4)

    def code(self, code: dict | None) -> int:
        if not code:
            return 0
        debug = self.add("debug", debug_info(code["debug"])) if code["debug"] else 0
        return self.add("code", code_item(code, debug), 4)

    def class_data(self, d: dict) -> int:
        if not any(d.values()):
            return 0
        raw = b"".join(to_uleb128(len(v)) for v in d.values())
        for kind, rows in d.items():
            before = 0
            for r in rows:
                raw += to_uleb128(r["idx"] - before) + to_uleb128(r["access_flags"])
                raw += to_uleb128(self.code(r.get("code"))) if "methods" in kind else b""
                before = r["idx"]
        return self.add("class_data", raw)


def write(strings: list[str], types: list[int], protos: list[tuple[int, int, list[int]]], fields: list[tuple[int, int, int]], methods: list[tuple[int, int, int]], classes: list[dict]) -> bytes:
    """A file of version 035 with these pools and classes; checksum and signature are zero.

    protos: shorty, return type, parameter types; fields and methods: class, type or prototype, name; classes as
    executable() gives them, where code, annotations and static_values may be missing.
    """
    at, places = 112, []
    for (name, kind), rows, width in zip(POOLS.items(), (strings, types, protos, fields, methods, classes), (4, 4, 12, 8, 8, 32), strict=True):
        places.append((kind, len(rows), at if rows else 0))
        at += len(rows) * width
    data = _Data(at)
    body = b"".join(struct.pack("<I", data.add("string_data", to_uleb128(len(s.encode("utf-16-le", "surrogatepass")) // 2) + to_modified_utf8(s) + b"\0")) for s in strings)
    body += struct.pack(f"<{len(types)}I", *types)
    body += b"".join(struct.pack("<III", a, b, data.type_list(p)) for a, b, p in protos)
    body += b"".join(struct.pack("<HHI", *r) for r in [*fields, *methods])
    for c in classes:
        static = data.add("array", encoded_array(c["static_values"])) if c.get("static_values") else 0
        body += struct.pack("<8I", c["class_idx"], c["access_flags"], c["superclass_idx"], data.type_list(c["interfaces"]), c["source_file_idx"], data.directory(c.get("annotations")), data.class_data(c["data"]), static)
    rows = [(0, 1, 0), *((kind, n, where) for kind, n, where in places if n), *((kind, n, where) for kind, (where, n) in data.sections.items())]
    map_at = data.start + len(data.blob) + -(data.start + len(data.blob)) % 4
    rows = sorted([*rows, (DATA["map"], 1, map_at)], key=lambda r: r[2])
    data.add("map", struct.pack("<I", len(rows)) + b"".join(struct.pack("<HHII", kind, 0, n, where) for kind, n, where in rows), 4)
    head = b"dex\n035\0" + struct.pack("<I20sIIIIII", 0, bytes(20), data.start + len(data.blob), 112, 0x12345678, 0, 0, map_at)
    head += b"".join(struct.pack("<II", n, where) for _, n, where in places) + struct.pack("<II", len(data.blob), data.start)
    return head + body + bytes(data.blob)
