"""Shell scripts: lists, pipelines, subshells, groups, simple commands with assignments and redirects, and words."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor

BLANK = re.compile(r"(?:[ \t]|\\\n)*")
GAP = re.compile(r"(?:[ \t\n]|\\\n|#[^\n]*)*")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
ASSIGN = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)=")
PARAMETER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9@*#?$!-]")
OPERATION = re.compile(r":-|:=|:\?|:\+|##|%%|//|-|=|\?|\+|#|%|/")
REDIRECT = re.compile(r"([0-9]*)(<<<|<<-|<<|>>|>&|<&|>\||&>|<|>)")
PLAIN = re.compile(r"""[^\s'"\\$`;&|<>()#]+|#(?<=[^\s;&|(]#)""")


def _parameter(c: Cursor, quoted: bool) -> dict:
    if c.accept("(("):
        return {"type": "arithmetic", "text": c.until("))")}
    if c.accept("("):
        out = {"type": "command-substitution", "command": script(c)}
        c.expect(")")
        return out
    if c.accept("{"):
        length = c.starts("#") and not c.starts("#}") and c.accept("#")
        m = c.match(PARAMETER)
        if m is None:
            raise c.fail("Unexpected", "a parameter wanted")
        op = c.match(OPERATION)
        out = {"type": "parameter", "name": m[0], "length": bool(length), "operation": op and op[0], "argument": _parts(c, "}") if op else None}
        c.expect("}")
        return out
    m = c.match(PARAMETER)
    return {"type": "parameter", "name": m[0], "length": False, "operation": None, "argument": None} if m else {"type": "literal", "value": "$"}


def _double(c: Cursor) -> dict:
    parts: list[dict] = []
    while not c.accept('"'):
        parts.append(_special(c, True) or {"type": "literal", "value": c.take(1)})
    return {"type": "double-quoted", "parts": _merged(parts)}


def _special(c: Cursor, quoted: bool) -> dict | None:
    if c.accept("$"):
        return _parameter(c, quoted)
    if c.accept("`"):
        return {"type": "backtick", "text": c.until("`")}
    if c.accept("\\"):
        x = c.take(1)
        return {"type": "literal", "value": x if not quoted or x in '$`"\\\n' else "\\" + x}
    if not quoted and c.accept("'"):
        return {"type": "single-quoted", "value": c.until("'")}
    if not quoted and c.accept('"'):
        return _double(c)
    return None


def _merged(parts: list[dict]) -> list[dict]:
    out: list[dict] = []
    for p in parts:
        if out and p["type"] == "literal" == out[-1]["type"]:
            out[-1] = {"type": "literal", "value": out[-1]["value"] + p["value"]}
        else:
            out.append(p)
    return out


def _parts(c: Cursor, stop: str) -> list[dict]:
    parts = []
    while not c.starts(stop):
        parts.append(_special(c, False) or {"type": "literal", "value": c.take(1)})
    return _merged(parts)


def word(c: Cursor) -> dict:
    parts: list[dict] = []
    while True:
        if (m := c.match(PLAIN)) is not None:
            parts.append({"type": "literal", "value": m[0]})
        elif (p := _special(c, False)) is not None:
            parts.append(p)
        else:
            break
    if not parts:
        raise c.fail("Unexpected", "a word wanted")
    return {"type": "word", "parts": _merged(parts)}


def _redirect(c: Cursor) -> dict:
    m = c.match(REDIRECT)
    if m is None:
        raise c.fail("Unexpected", "a redirect wanted")
    c.match(BLANK)
    out = {"type": "redirect", "descriptor": int(m[1]) if m[1] else None, "operator": m[2], "target": word(c)}
    if m[2] in ("<<", "<<-"):
        end = "".join(p.get("value", "") for p in out["target"]["parts"])
        i = c.data.find("\n", c.at, c.end)
        lines, at = [], i + 1
        while True:
            j = c.data.find("\n", at, c.end) if 0 < at <= c.end else -1
            line = c.data[at : c.end if j < 0 else j] if 0 < at <= c.end else ""
            if (line.lstrip("\t") if m[2] == "<<-" else line) == end:
                break
            if j < 0:
                raise c.fail("Unterminated", "no end of the here document")
            lines.append(line)
            at = j + 1
        out["body"] = "".join(x + "\n" for x in lines)
        c.data = c.data[: i + 1] + c.data[c.end if j < 0 else j + 1 :]  # the body is used up where its line ends
        c.end = len(c.data)
    return out


def simple(c: Cursor) -> dict:
    out: dict = {"type": "simple", "assignments": [], "words": [], "redirects": []}
    while True:
        c.match(BLANK)
        ok, got = c.attempt(_redirect)
        if ok:
            out["redirects"].append(got)
        elif not out["words"] and (m := c.match(ASSIGN)):
            ok, value = c.attempt(word)
            out["assignments"].append({"type": "assignment", "name": m[1], "value": value if ok else None})
        else:
            ok, got = c.attempt(word)
            if not ok:
                break
            out["words"].append(got)
    if not any(out[k] for k in ("assignments", "words", "redirects")):
        raise c.fail("Unexpected", "a command wanted")
    return out


def _unit(c: Cursor) -> dict:
    c.match(BLANK)
    if c.accept("("):
        out = {"type": "subshell", "body": script(c)}
        c.expect(")")
        return out
    if re.compile(r"\{\s").match(c.data, c.at, c.end):
        c.take(1)
        out = {"type": "group", "body": script(c)}
        c.expect("}")
        return out
    if c.starts("}"):
        raise c.fail("Unexpected", "'}'")
    return simple(c)


def pipeline(c: Cursor) -> dict:
    c.match(BLANK)
    negated = bool(c.match(re.compile(r"!\s+")))
    units = [_unit(c)]
    while True:
        c.match(BLANK)
        if c.starts("||") or not c.accept("|"):
            return {"type": "pipeline", "negated": negated, "commands": units}
        c.accept("&")
        c.match(GAP)
        units.append(_unit(c))


def script(c: Cursor) -> dict:
    """A list of pipelines, each with the separator that follows it."""
    entries = []
    c.match(GAP)
    while not c.done() and c.peek() not in (")", "}"):
        command = pipeline(c)
        c.match(BLANK)
        c.match(re.compile("#[^\n]*"))
        separator = next((x for x in ("&&", "||", ";", "&", "\n") if c.accept(x)), None)
        entries.append({"type": "entry", "command": command, "separator": separator})
        c.match(GAP)
        if separator is None:
            break
    return {"type": "list", "entries": entries}
