"""Shell syntax trees as text: what the rule reads back to the same tree."""

from __future__ import annotations

import re


def _part(p: dict, quoted: bool = False) -> str:
    kind = p["type"]
    if kind == "literal":
        return re.sub(r'([$`"\\])', r"\\\1", p["value"]) if quoted else re.sub(r"""([\s'"\\$`;&|<>()#{}!])""", r"\\\1", p["value"])
    if kind == "single-quoted":
        return f"'{p['value']}'"
    if kind == "double-quoted":
        return '"' + "".join(_part(x, True) for x in p["parts"]) + '"'
    if kind == "backtick":
        return f"`{p['text']}`"
    if kind == "arithmetic":
        return f"$(({p['text']}))"
    if kind == "command-substitution":
        return f"$({script(p['command'])})"
    argument = "".join(_part(x) for x in p["argument"] or [])
    return "${" + ("#" if p["length"] else "") + p["name"] + (p["operation"] or "") + argument + "}"


def word(w: dict) -> str:
    return "".join(map(_part, w["parts"]))


def _command(c: dict) -> str:
    if c["type"] == "subshell":
        return f"({script(c['body'])})"
    if c["type"] == "group":
        return "{ " + script(c["body"]) + "\n}"
    parts = [f"{a['name']}={word(a['value']) if a['value'] else ''}" for a in c["assignments"]] + [word(w) for w in c["words"]]
    parts += [f"{'' if r['descriptor'] is None else r['descriptor']}{r['operator']}{word(r['target'])}" for r in c["redirects"]]
    return " ".join(parts)


def _bodies(c: dict) -> str:
    return "".join("\n" + r["body"] + "".join(p.get("value", "") for p in r["target"]["parts"]) for r in c.get("redirects", []) if r["operator"] in ("<<", "<<-"))


def script(s: dict) -> str:
    """A list with its separators; bodies of here documents stand after the line that opens them."""
    out = ""
    for i, e in enumerate(s["entries"]):
        p = e["command"]
        out += ("! " if p["negated"] else "") + " | ".join(map(_command, p["commands"]))
        bodies = "".join(map(_bodies, p["commands"]))
        mark = e["separator"] or ""
        out += mark.rstrip("\n") + bodies + ("\n" if mark == "\n" or bodies and i + 1 < len(s["entries"]) else " " if mark and i + 1 < len(s["entries"]) else "")
    return out
