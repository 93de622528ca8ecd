"""Dalvik instructions, both ways. The opcode table follows the families in which the instruction set is laid out."""

from __future__ import annotations

import struct

from ..operators.cursor import Cursor, GrammarError

KINDS = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
MATH = ("add", "sub", "mul", "div", "rem", "and", "or", "xor", "shl", "shr", "ushr")
UNARY = ("neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double", "int-to-long", "int-to-float", "int-to-double", "long-to-int", "long-to-float", "long-to-double", "float-to-int", "float-to-long", "float-to-double", "double-to-int", "double-to-long", "double-to-float", "int-to-byte", "int-to-char", "int-to-short")
CALLS = ("virtual", "super", "direct", "static", "interface")
TESTS = ("eq", "ne", "lt", "ge", "gt", "le")


def _table() -> dict[int, tuple[str, str]]:
    out: dict[int, tuple[str, str]] = {}

    def put(at: int, *rows: tuple[str, str]) -> None:
        out.update({at + i: r for i, r in enumerate(rows)})

    put(0x00, ("nop", "10x"))
    for i, kind in enumerate(("", "-wide", "-object")):
        put(1 + 3 * i, (f"move{kind}", "12x"), (f"move{kind}/from16", "22x"), (f"move{kind}/16", "32x"))
    put(0x0A, *((f"move-{x}", "11x") for x in ("result", "result-wide", "result-object", "exception")))
    put(0x0E, ("return-void", "10x"), *((f"return{x}", "11x") for x in ("", "-wide", "-object")))
    put(0x12, ("const/4", "11n"), ("const/16", "21s"), ("const", "31i"), ("const/high16", "21h"), ("const-wide/16", "21s"), ("const-wide/32", "31i"), ("const-wide", "51l"), ("const-wide/high16", "21h"))
    put(0x1A, ("const-string", "21c"), ("const-string/jumbo", "31c"), ("const-class", "21c"), ("monitor-enter", "11x"), ("monitor-exit", "11x"), ("check-cast", "21c"), ("instance-of", "22c"), ("array-length", "12x"))
    put(0x22, ("new-instance", "21c"), ("new-array", "22c"), ("filled-new-array", "35c"), ("filled-new-array/range", "3rc"), ("fill-array-data", "31t"), ("throw", "11x"), ("goto", "10t"), ("goto/16", "20t"), ("goto/32", "30t"), ("packed-switch", "31t"), ("sparse-switch", "31t"))
    put(0x2D, *((f"cmp{x}", "23x") for x in ("l-float", "g-float", "l-double", "g-double", "-long")))
    put(0x32, *((f"if-{x}", "22t") for x in TESTS), *((f"if-{x}z", "21t") for x in TESTS))
    for at, name, form in ((0x44, "a", "23x"), (0x52, "i", "22c"), (0x60, "s", "21c")):
        put(at, *((f"{name}{verb}{kind}", form) for verb in ("get", "put") for kind in KINDS))
    put(0x6E, *((f"invoke-{x}", "35c") for x in CALLS))
    put(0x74, *((f"invoke-{x}/range", "3rc") for x in CALLS))
    put(0x7B, *((x, "12x") for x in UNARY))
    binary = [f"{op}-{kind}" for kind, n in (("int", 11), ("long", 11), ("float", 5), ("double", 5)) for op in MATH[:n]]
    put(0x90, *((x, "23x") for x in binary))
    put(0xB0, *((f"{x}/2addr", "12x") for x in binary))
    put(0xD0, *(("rsub-int" if op == "sub" else f"{op}-int/lit16", "22s") for op in MATH[:8]))
    put(0xD8, *((("rsub" if op == "sub" else op) + "-int/lit8", "22b") for op in MATH))
    put(0xFA, ("invoke-polymorphic", "45cc"), ("invoke-polymorphic/range", "4rcc"), ("invoke-custom", "35c"), ("invoke-custom/range", "3rc"), ("const-method-handle", "21c"), ("const-method-type", "21c"))
    return out


OPCODES = _table()
CODES = {name: code for code, (name, _) in OPCODES.items()}
#: The fields of a format: struct codes of what follows the opcode byte, "n" for a byte of two nibbles (low one first).
LAYOUT = {
    "10x": ("x", ()), "12x": ("n", ("a", "b")), "11n": ("n", ("a", "literal")), "11x": ("B", ("a",)), "10t": ("b", ("target",)), "20t": ("xh", ("target",)), "22x": ("BH", ("a", "b")), "21t": ("Bh", ("a", "target")),
    "21s": ("Bh", ("a", "literal")), "21h": ("Bh", ("a", "literal")), "21c": ("BH", ("a", "index")), "23x": ("BBB", ("a", "b", "c")), "22b": ("BBb", ("a", "b", "literal")), "22t": ("nh", ("a", "b", "target")), "22s": ("nh", ("a", "b", "literal")),
    "22c": ("nH", ("a", "b", "index")), "30t": ("xi", ("target",)), "32x": ("xHH", ("a", "b")), "31i": ("Bi", ("a", "literal")), "31t": ("Bi", ("a", "target")), "31c": ("BI", ("a", "index")), "3rc": ("BHH", ("count", "index", "first")),
    "4rcc": ("BHHH", ("count", "index", "first", "prototype")), "51l": ("Bq", ("a", "literal")), "35c": ("nHHx", ()), "45cc": ("nHHH", ()),
}


def _nibbles(b: int) -> tuple[int, int]:
    return b & 15, b >> 4


def instruction(c: Cursor) -> dict:
    """One instruction or payload: {operation, offset, units, ...its fields}; offset and units count 16-bit units."""
    start = c.at
    ident = c.peek(2)
    if ident in (b"\x00\x01", b"\x00\x02", b"\x00\x03"):
        c.take(2)
        n = c.number(2)
        if ident[1] == 1:
            first = c.number(4, signed=True)
            out = {"operation": "packed-switch-payload", "first": first, "targets": [c.number(4, signed=True) for _ in range(n)]}
        elif ident[1] == 2:
            out = {"operation": "sparse-switch-payload", "keys": [c.number(4, signed=True) for _ in range(n)], "targets": [c.number(4, signed=True) for _ in range(n)]}
        else:
            count = c.number(4)
            out = {"operation": "fill-array-data-payload", "width": n, "data": c.take(n * count)}
            if n * count % 2:
                c.take(1)
    else:
        code = c.number(1)
        if code not in OPCODES:
            c.at = start
            raise c.fail("Unexpected", f"opcode {code:#04x} is unused")
        name, form = OPCODES[code]
        out = {"operation": name}
        layout, names = LAYOUT[form]
        values: list[int] = []
        if form in ("35c", "45cc"):
            low, count = _nibbles(c.number(1))
            index, bits = c.number(2), c.number(2)
            registers = [bits >> 4 * i & 15 for i in range(4)] + [low]
            out |= {"index": index, "registers": registers[:count]} | ({"prototype": c.number(2)} if form == "45cc" else {})
        else:
            for x in layout:
                if x == "n":
                    a, b = _nibbles(c.number(1))
                    values += [a, b - 16 if form == "11n" and b > 7 else b]
                elif x == "x":
                    c.take(1)
                else:
                    values.append(struct.unpack("<" + x, c.take(struct.calcsize(x)))[0])
            fields = dict(zip(names, values, strict=True))
            if form == "21h":
                fields["literal"] <<= 48 if name == "const-wide/high16" else 16
            if "count" in fields:
                first = fields.pop("first")
                fields["registers"] = [*range(first, first + fields.pop("count"))]
            out |= fields
    return out | {"offset": start // 2, "units": (c.at - start) // 2}


def instructions(c: Cursor) -> list[dict]:
    """All instructions to the end; offsets are from the start of the code. Payloads begin at even units, nops fill the gaps."""
    base, out = c.at, []
    while not c.done():
        x = instruction(c)
        out.append(x | {"offset": x["offset"] - base // 2})
    return out


def with_target_indices(code: list[dict]) -> list[dict]:
    """Branch targets (relative units) as the index of the instruction there; switch payloads are relative to their switch."""
    place = {x["offset"]: i for i, x in enumerate(code)}
    owner = {x["offset"] + x["target"]: x["offset"] for x in reversed(code) if x["operation"] in ("packed-switch", "sparse-switch")}

    def index(at: int) -> int:
        if at not in place:
            raise GrammarError(f"no instruction at {at}")
        return place[at]

    return [x | ({"target_index": index(x["offset"] + x["target"])} if "target" in x else {}) | ({"target_indices": [index(owner[x["offset"]] + t) for t in x["targets"]]} if "targets" in x else {}) for x in code]


def write(code: list[dict]) -> bytes:
    """The inverse of instructions."""
    out = b""
    for x in code:
        name = x["operation"]
        if name == "packed-switch-payload":
            out += struct.pack(f"<HHi{len(x['targets'])}i", 0x100, len(x["targets"]), x["first"], *x["targets"])
        elif name == "sparse-switch-payload":
            out += struct.pack(f"<HH{2 * len(x['keys'])}i", 0x200, len(x["keys"]), *x["keys"], *x["targets"])
        elif name == "fill-array-data-payload":
            out += struct.pack("<HHI", 0x300, x["width"], len(x["data"]) // x["width"] if x["width"] else 0) + x["data"] + b"\0" * (len(x["data"]) % 2)
        else:
            code_byte = CODES[name]
            form = OPCODES[code_byte][1]
            layout, names = LAYOUT[form]
            out += bytes([code_byte])
            if form in ("35c", "45cc"):
                r = x["registers"] + [0] * (5 - len(x["registers"]))
                out += struct.pack("<BHH", len(x["registers"]) << 4 | r[4], x["index"], sum(v << 4 * i for i, v in enumerate(r[:4])))
                out += struct.pack("<H", x["prototype"]) if form == "45cc" else b""
                continue
            fields = dict(x)
            if "registers" in x:
                fields |= {"count": len(x["registers"]), "first": x["registers"][0] if x["registers"] else 0}
            if form == "21h":
                fields["literal"] = x["literal"] >> (48 if name == "const-wide/high16" else 16)
            values = [fields[n] for n in names]
            for k in layout:
                if k == "n":
                    out += bytes([values.pop(0) & 15 | (values.pop(0) & 15) << 4])
                else:
                    out += b"\0" if k == "x" else struct.pack("<" + k, values.pop(0))
    return out
