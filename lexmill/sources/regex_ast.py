"""Syntax trees of regular expressions, with character sets as sorted ranges of code points of the basic plane."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor

TOP = 0xFFFF
Ranges = list[tuple[int, int]]
DIGIT, WORD = [(48, 57)], [(48, 57), (65, 90), (95, 95), (97, 122)]
SPACES = [(9, 13), (32, 32), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288), (65279, 65279)]
NEWLINES = [(10, 10), (13, 13), (8232, 8233)]
COUNT = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
CONTROL = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "0": 0}


def union(*sets: Ranges) -> Ranges:
    """Sorted ranges without overlaps or neighbours."""
    out: Ranges = []
    for a, b in sorted(r for s in sets for r in s):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def complement(s: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in union(s):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, TOP)] if at <= TOP else out


def difference(a: Ranges, b: Ranges) -> Ranges:
    return complement(union(complement(a), b))


CLASSES = {"d": DIGIT, "w": WORD, "s": SPACES, "D": complement(DIGIT), "W": complement(WORD), "S": complement(SPACES)}


def _code(c: Cursor, width: int) -> int:
    digits = c.take(width)
    try:
        return int(digits, 16)
    except ValueError as e:
        raise c.fail("Unexpected", f"{width} hexadecimal digits wanted") from e


def _escape(c: Cursor) -> Ranges:
    x = c.take(1)
    if x in CLASSES:
        return CLASSES[x]
    code = CONTROL[x] if x in CONTROL else _code(c, 2) if x == "x" else _code(c, 4) if x == "u" else ord(x)
    if x.isalnum() and x not in CONTROL and x not in "xu":
        raise c.fail("Unexpected", f"escape {x!r}")
    return [(code, code)]


def _plain(c: Cursor) -> Ranges:
    code = ord(c.take(1))
    return [(code, code)]


def _class(c: Cursor) -> Ranges:
    negative, sets = c.accept("^"), []
    while not c.accept("]"):
        one = _escape(c) if c.accept("\\") else _plain(c)
        if one[0][0] == one[-1][1] and c.starts("-") and not c.peek(2).endswith("]"):
            c.take(1)
            other = _escape(c) if c.accept("\\") else _plain(c)
            if other[0][0] != other[-1][1] or other[0][0] < one[0][0]:
                raise c.fail("Unexpected", "a range wanted")
            one = [(one[0][0], other[0][0])]
        sets.append(one)
    return complement(union(*sets)) if negative else union(*sets)


def _atom(c: Cursor) -> dict:
    if c.accept("("):
        for mark, make in (("?:", lambda x: x), ("?=", lambda x: {"type": "assertion", "negative": False, "inner": x}), ("?!", lambda x: {"type": "assertion", "negative": True, "inner": x})):
            if c.accept(mark):
                out = make(alternation(c))
                break
        else:
            name = c.until(">") if c.accept("?<") else None
            out = {"type": "capture-group", "name": name, "inner": alternation(c)}
        c.expect(")")
        return out
    if c.accept("["):
        return {"type": "literal", "charset": _class(c)}
    if c.accept("."):
        return {"type": "literal", "charset": complement(NEWLINES)}
    if c.accept("\\"):
        return {"type": "literal", "charset": _escape(c)}
    if c.accept("^"):
        return {"type": "start-anchor"}
    if c.accept("$"):
        return {"type": "end-anchor"}
    x = c.take(1)
    if x in "*+?)|{":
        c.at -= 1
        raise c.fail("Unexpected", f"{x!r}")
    return {"type": "literal", "charset": [(ord(x), ord(x))]}


def _quantified(c: Cursor) -> dict:
    out = _atom(c)
    for mark, kind in (("*", "star"), ("+", "plus"), ("?", "optional")):
        if c.accept(mark):
            return {"type": kind, "inner": out}
    if m := c.match(COUNT):
        low = int(m[1])
        return {"type": "repeat", "min": low, "max": low if m[2] is None else int(m[3]) if m[3] else None, "inner": out}
    return out


def alternation(c: Cursor) -> dict:
    """Alternatives of sequences, both nested to the right."""
    items = []
    while not c.done() and c.peek() not in "|)":
        items.append(_quantified(c))
    out = items.pop() if items else {"type": "epsilon"}
    while items:
        out = {"type": "concat", "left": items.pop(), "right": out}
    return {"type": "union", "left": out, "right": alternation(c)} if c.accept("|") else out
