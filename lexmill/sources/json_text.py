"""Lenient JSON: separators of object entries may be missing or trail, unknown escapes stand for their character."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor

SPACE = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
HEX = re.compile("[0-9a-fA-F]{4}")


def string(c: Cursor) -> str:
    c.expect('"')
    out = []
    while not c.accept('"'):
        x = c.take(1)
        if x != "\\":
            out.append(x)
        elif c.accept("u"):
            m = c.match(HEX)
            if m is None:
                raise c.fail("Unexpected", "four hexadecimal digits wanted")
            out.append(chr(int(m[0], 16)))
        else:
            x = c.take(1)
            out.append(ESCAPES.get(x, x))
    text = "".join(out)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= x <= "\udfff" for x in out) else text


def number(c: Cursor) -> float:
    m = c.match(NUMBER)
    if m is None:
        raise c.fail("Unexpected", "a number wanted")
    return float(m[0])


def _object(c: Cursor) -> dict:
    c.expect("{")
    out: dict = {}
    c.match(SPACE)
    while not c.accept("}"):
        key = string(c)
        c.match(SPACE)
        c.expect(":")
        c.match(SPACE)
        out[key] = value(c)
        c.match(SPACE)
        if c.accept(","):
            c.match(SPACE)
    return out


def _array(c: Cursor) -> list:
    c.expect("[")
    out: list = []
    c.match(SPACE)
    if not c.accept("]"):
        while True:
            out.append(value(c))
            c.match(SPACE)
            if c.accept("]"):
                break
            c.expect(",")
            c.match(SPACE)
    c.match(SPACE)
    return out


def value(c: Cursor):  # noqa: ANN201
    """Any JSON value. Numbers are doubles; of a repeated key the last value stays."""
    x = c.peek()
    if x == "{":
        return _object(c)
    if x == "[":
        return _array(c)
    if x == '"':
        return string(c)
    for word, what in (("true", True), ("false", False), ("null", None)):
        if c.accept(word):
            return what
    return number(c)
