"""Symbolic expressions: atoms, strings, lists and the four kinds of quotation."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor

SPACE = re.compile(r"\s*")
MARKS = (("'", "quote"), ("`", "quasiquote"), (",@", "unquote-splicing"), (",", "unquote"))
#: What a letter stands for behind a backslash in a string; any other character stands for itself.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "b": "\b"}
LETTERS = {v: k for k, v in ESCAPES.items()}
#: What ends an atom, unless a backslash stands before it.
ENDS = set("()\"'`,;")


def _string(c: Cursor) -> str:
    out = []
    while (x := c.take(1)) != '"':
        if x == "\\":
            x = c.take(1)
            x = ESCAPES.get(x, x)
        out.append(x)
    return "".join(out)


def _atom(c: Cursor) -> str:
    """Up to an end; a backslash makes its character part of the atom (but for a line's end), one at the very end is dropped."""
    out: list[str] = []
    while (x := c.peek()) and x not in ENDS and not x.isspace():
        if x == "\\":
            two = c.peek(2)
            if len(two) < 2 or two[1] in "\n\r  ":
                if out:
                    c.take(1)
                break
            c.take(1)
        out.append(c.take(1))
    return "".join(out)


def expression(c: Cursor) -> dict:
    if c.accept('"'):
        return {"type": "string", "value": _string(c)}
    for mark, kind in MARKS:
        if c.accept(mark):
            c.match(SPACE)
            return {"type": kind, "expression": expression(c)}
    if c.accept("("):
        out = []
        c.match(SPACE)
        while not c.accept(")"):
            out.append(expression(c))
            c.match(SPACE)
        return {"type": "list", "expressions": out}
    if value := _atom(c):
        return {"type": "atom", "value": value}
    raise c.fail("Unexpected", "an expression wanted")


def document(c: Cursor) -> dict:
    c.match(SPACE)
    out = expression(c)
    c.match(SPACE)
    return out


def write(e: dict) -> str:
    kind = e["type"]
    if kind == "atom":
        return "".join("\\" + x if x in ENDS or x == "\\" or x.isspace() else x for x in e["value"])
    if kind == "string":
        return '"' + "".join("\\" + (LETTERS.get(x) or x) if x in LETTERS or x in '"\\' else x for x in e["value"]) + '"'
    if kind == "list":
        return "(" + " ".join(map(write, e["expressions"])) + ")"
    return next(m for m, k in MARKS if k == kind) + write(e["expression"])
