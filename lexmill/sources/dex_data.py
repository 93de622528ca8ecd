"""What Dalvik executables hold beside their pools: encoded values, annotations, code with its tries, debug information."""

from __future__ import annotations

import struct

from ..operators.cursor import Cursor
from . import dalvik_bytecode
from .numbers import sleb128, uleb128

#: Kinds of encoded values by their code, visibilities of annotations, the debug state machine's opcodes.
VALUE_KINDS = {0x00: "byte", 0x02: "short", 0x03: "char", 0x04: "int", 0x06: "long", 0x10: "float", 0x11: "double", 0x15: "method_type", 0x16: "method_handle", 0x17: "string", 0x18: "type", 0x19: "field", 0x1A: "method", 0x1B: "enum", 0x1C: "array", 0x1D: "annotation", 0x1E: "null", 0x1F: "boolean"}
VISIBILITIES = ("build", "runtime", "system")
DEBUG = ("end_sequence", "advance_pc", "advance_line", "start_local", "start_local_extended", "end_local", "restart_local", "set_prologue_end", "set_epilogue_begin", "set_file")
SIGNED = {"byte", "short", "int", "long"}
FLOATS = {"float": ("<f", 4), "double": ("<d", 8)}


def encoded_value(c: Cursor) -> dict:
    """{type, value}; indices stay indices, to be resolved by joins."""
    head = c.number(1)
    kind, more = VALUE_KINDS.get(head & 31), head >> 5
    if kind is None:
        raise c.fail("Unexpected", f"no value has the kind {head & 31:#x}")
    if kind == "null":
        value = None
    elif kind == "boolean":
        value = bool(more)
    elif kind == "array":
        value = encoded_array(c)
    elif kind == "annotation":
        value = encoded_annotation(c)
    elif kind in FLOATS:
        code, width = FLOATS[kind]
        value = struct.unpack(code, c.take(more + 1).rjust(width, b"\0"))[0]
    else:
        value = c.number(more + 1, signed=kind in SIGNED)
    return {"type": kind, "value": value}


def encoded_array(c: Cursor) -> list[dict]:
    return [encoded_value(c) for _ in range(uleb128(c))]


def encoded_annotation(c: Cursor) -> dict:
    kind = uleb128(c)
    return {"type_idx": kind, "elements": [{"name_idx": uleb128(c), "value": encoded_value(c)} for _ in range(uleb128(c))]}


def at(c: Cursor, offset: int) -> Cursor:
    return Cursor(c.data, offset, c.end)


def annotation_set(c: Cursor, offset: int) -> list[dict]:
    """Annotations with their visibility; offset 0 is the empty set."""
    if not offset:
        return []
    part, out = at(c, offset), []
    for _ in range(part.number(4)):
        item = at(c, part.number(4))
        code = item.number(1)
        if code >= len(VISIBILITIES):
            raise item.fail("Unexpected", f"no visibility is {code}")
        out.append({"visibility": VISIBILITIES[code]} | encoded_annotation(item))
    return out


def annotations(c: Cursor, offset: int) -> dict:
    """{class, fields, methods, parameters} of a class's directory."""
    out: dict = {"class": [], "fields": [], "methods": [], "parameters": []}
    if offset:
        part = at(c, offset)
        out["class"] = annotation_set(c, part.number(4))
        fields, methods, parameters = (part.number(4) for _ in range(3))
        out["fields"] = [{"idx": part.number(4), "annotations": annotation_set(c, part.number(4))} for _ in range(fields)]
        out["methods"] = [{"idx": part.number(4), "annotations": annotation_set(c, part.number(4))} for _ in range(methods)]
        for _ in range(parameters):
            idx, refs = part.number(4), at(c, part.number(4))
            out["parameters"].append({"idx": idx, "annotations": [annotation_set(c, refs.number(4)) for _ in range(refs.number(4))]})
    return out


def debug_info(c: Cursor, offset: int) -> dict | None:
    """{line_start, parameter_names, codes}; an absent index is null."""
    if not offset:
        return None
    part = at(c, offset)

    def index() -> int | None:
        n = uleb128(part)
        return n - 1 if n else None

    out: dict = {"line_start": uleb128(part), "parameter_names": [index() for _ in range(uleb128(part))], "codes": []}
    while True:
        op = part.number(1)
        if op >= len(DEBUG):
            out["codes"].append({"op": "special", "value": op})
            continue
        name = DEBUG[op]
        x: dict = {"op": name}
        if name == "advance_pc":
            x["value"] = uleb128(part)
        elif name == "advance_line":
            x["value"] = sleb128(part)
        elif name == "set_file":
            x["name_idx"] = index()
        elif "local" in name:
            x["register"] = uleb128(part)
            if name.startswith("start"):
                x |= {"name_idx": index(), "type_idx": index()} | ({"signature_idx": index()} if name.endswith("extended") else {})
        if name == "end_sequence":
            return out
        out["codes"].append(x)


def lines(info: dict) -> list[tuple[int, int]]:
    """(address, line) of every position that the state machine emits; a special opcode moves both at once."""
    address, line, out = 0, info["line_start"], []
    for x in info["codes"]:
        if x["op"] == "advance_pc":
            address += x["value"]
        elif x["op"] == "advance_line":
            line += x["value"]
        elif x["op"] == "special":
            pc, step = divmod(x["value"] - 10, 15)
            address, line = address + pc, line + step - 4
            out.append((address, line))
    return out


def code_item(c: Cursor, offset: int) -> dict | None:
    """{registers, ins, outs, instructions, tries, debug}; addresses count 16-bit units."""
    if not offset:
        return None
    part = at(c, offset)
    registers, ins, outs, tries = (part.number(2) for _ in range(4))
    debug, units = part.number(4), part.number(4)
    body = dalvik_bytecode.instructions(part.inner(2 * units))
    found = []
    if tries:
        part.take(2 * (units % 2))
        rows = [(part.number(4), part.number(2), part.number(2)) for _ in range(tries)]
        base, handlers = part.at, {}
        for _ in range(uleb128(part)):
            place, n = part.at - base, sleb128(part)
            pairs = [{"type_idx": uleb128(part), "address": uleb128(part)} for _ in range(abs(n))]
            handlers[place] = {"handlers": pairs, "catch_all": uleb128(part) if n <= 0 else None}
        for start, count, place in rows:
            if place not in handlers:
                raise part.fail("Unexpected", f"no handler list begins at {place}")
            found.append({"start": start, "count": count} | handlers[place])
    return {"registers": registers, "ins": ins, "outs": outs, "instructions": body, "tries": found, "debug": debug_info(c, debug)}
