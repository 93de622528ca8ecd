"""Classes in smali text: members, values, annotations, and code whose labels become instruction indices."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor
from ..operators.tokens import Tokens
from .dalvik_bytecode import CODES

TOKEN = re.compile(r"""(?P<skip>[ \t\r]+|#[^\n]*)|(?P<line>\n)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\.)')|(?P<mark>\.\.|[{},=])|(?P<directive>\.[a-z]+(?:-[a-z]+)*)|(?P<label>:[^\s,{}="']+)|(?P<word>[^\s,{}="']+)""")
#: Words for access, shorty letters, escapes, visibilities.
FLAGS = ("public", "protected", "private", "final", "bridge", "synthetic", "varargs", "static", "constructor", "abstract", "native", "volatile", "transient", "synchronized", "declared-synchronized", "strict", "interface", "annotation", "enum")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
VISIBILITIES = ("build", "runtime", "system")
SUFFIXES = {"t": "byte", "s": "short", "L": "long", "l": "long"}

REGISTER = re.compile(r"[vp]\d+")
NUMBER = re.compile(r"(-?)(0[xX][0-9a-fA-F]+|\d+)([tslL]?)")
REAL = re.compile(r"-?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|Infinity|NaN)([fFdD]?)")
TYPE = re.compile(r"\[*(?:[ZBSCIJFDV]|L[^;:()]+;)")
METHOD = re.compile(r"([^\s()]+)\(((?:\[*(?:[ZBSCIJFD]|L[^;]+;))*)\)(.+)")


def unescape(text: str) -> str:
    plain = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def types(text: str) -> list[str]:
    return TYPE.findall(text)


def prototype(parameters: str, returns: str) -> dict:
    kinds = types(parameters)
    return {"shorty": "".join("L" if k[0] in "L[" else k for k in [returns, *kinds]), "returns": returns, "parameters": kinds}


def words(kinds: list[str]) -> int:
    """Registers that values of these types take."""
    return sum(2 if k in ("J", "D") else 1 for k in kinds)


class Reader(Tokens):
    def __init__(self, c: Cursor) -> None:
        super().__init__(c, TOKEN)

    def newlines(self) -> None:
        while self.kind == "line":
            self.at += 1

    def end_line(self) -> None:
        if self.kind != "end":
            self.take("line")
            self.newlines()

    def directive(self, name: str) -> bool:
        """Whether a line begins with this directive, which is used up."""
        if self.kind == "directive" and self.text == name:
            self.at += 1
            return True
        return False

    def closes(self, what: str) -> bool:
        if self.kind == "directive" and self.text == ".end" and self.ahead() == what:
            self.at += 2
            return True
        return False

    def number(self) -> int:
        m = NUMBER.fullmatch(self.text) if self.kind == "word" else None
        if m is None:
            raise self.fail("a number")
        self.at += 1
        return int(m[1] + m[2], 0 if m[2][:2] in ("0x", "0X") else 10)

    def type(self) -> str:
        if self.kind != "word" or not TYPE.fullmatch(self.text):
            raise self.fail("a type")
        return self.take("word")

    def flags(self) -> list[str]:
        out = []
        while self.kind == "word" and self.text in FLAGS:
            out.append(self.take("word"))
        return out

    def member(self, owner: str | None = None) -> dict:
        """class->name:type or class->name(parameters)returns; without class it is of the owner."""
        text = self.text
        start, arrow, rest = text.partition("->")
        holder = start if arrow else owner
        rest = rest if arrow else text
        if holder is None or self.kind != "word":
            raise self.fail("a member")
        if m := METHOD.fullmatch(rest):
            if not TYPE.fullmatch(m[3]):
                raise self.fail("a method")
            self.at += 1
            return {"type": "method", "class": holder, "name": m[1], "prototype": prototype(m[2], m[3])}
        name, colon, kind = rest.partition(":")
        if not colon or not name or not TYPE.fullmatch(kind):
            raise self.fail("a field")
        self.at += 1
        return {"type": "field", "class": holder, "name": name, "field_type": kind}

    # values and annotations
    def value(self) -> dict:
        with self.nested():
            self.newlines()
            text = self.text
            if self.kind == "string":
                return {"type": "string", "value": unescape(self.take("string")[1:-1])}
            if self.kind == "char":
                return {"type": "char", "value": ord(unescape(self.take("char")[1:-1])[0])}
            if self.accept("{"):
                out = []
                self.newlines()
                while not self.accept("}"):
                    out.append(self.value())
                    self.newlines()
                    if not self.accept(","):
                        self.expect("}")
                        break
                    self.newlines()
                return {"type": "array", "value": out}
            if self.directive(".enum"):
                return {"type": "enum", "value": self.member()}
            if self.directive(".subannotation"):
                return {"type": "annotation", "value": {"type": self.type(), "elements": self.elements("subannotation")}}
            if self.kind != "word":
                raise self.fail("a value")
            if text in ("true", "false"):
                self.at += 1
                return {"type": "boolean", "value": text == "true"}
            if text == "null":
                self.at += 1
                return {"type": "null", "value": None}
            if m := NUMBER.fullmatch(text):
                return {"type": SUFFIXES.get(m[3], "int"), "value": self.number()}
            if m := REAL.fullmatch(text):
                self.at += 1
                return {"type": "float" if m[1] in ("f", "F") and m[1] else "double", "value": float(text.rstrip("fFdD"))}
            if "->" in text:
                found = self.member()
                return {"type": found["type"], "value": found}
            if m := re.fullmatch(r"\((.*)\)(.+)", text):
                self.at += 1
                return {"type": "method_type", "value": prototype(m[1], m[2])}
            return {"type": "type", "value": self.type()}

    def elements(self, what: str) -> list[dict]:
        out = []
        self.end_line()
        while not self.closes(what):
            name = self.take("word")
            self.expect("=")
            out.append({"name": name, "value": self.value()})
            self.end_line()
        return out

    def annotations(self) -> list[dict]:
        out = []
        while self.directive(".annotation"):
            visibility = self.take("word")
            if visibility not in VISIBILITIES:
                self.at -= 1
                raise self.fail("a visibility")
            out.append({"visibility": visibility, "type": self.type(), "elements": self.elements("annotation")})
            self.end_line()
        return out

    # members
    def field(self, owner: str) -> dict:
        flags = self.flags()
        out = self.member(owner)
        if out["type"] != "field":
            raise self.fail("a field")
        out |= {"access_flags": flags, "kind": "static" if "static" in flags else "instance", "value": self.value() if self.accept("=") else None, "annotations": []}
        self.end_line()
        at = self.at
        notes = self.annotations()
        if self.closes("field"):
            self.end_line()
            out["annotations"] = notes
        else:
            self.at = at
        return out

    def method(self, owner: str) -> dict:
        flags = self.flags()
        out = self.member(owner)
        if out["type"] != "method":
            raise self.fail("a method")
        kind = "direct" if {"static", "private", "constructor"} & set(flags) else "virtual"
        self.end_line()
        ins = words(out["prototype"]["parameters"]) + ("static" not in flags)
        code = Code(self, ins)
        out |= {"access_flags": flags, "kind": kind} | code.read()
        return out

    def class_(self) -> dict:
        self.newlines()
        out: dict = {"type": "class", "class": None, "access_flags": [], "superclass": None, "interfaces": [], "source_file": None, "annotations": [], "fields": [], "methods": []}
        if not self.directive(".class"):
            raise self.fail("'.class'")
        out["access_flags"], out["class"] = self.flags(), self.type()
        self.end_line()
        while self.kind != "end":
            if self.directive(".super"):
                out["superclass"] = self.type()
                self.end_line()
            elif self.directive(".implements"):
                out["interfaces"].append(self.type())
                self.end_line()
            elif self.directive(".source"):
                out["source_file"] = unescape(self.take("string")[1:-1])
                self.end_line()
            elif self.directive(".field"):
                out["fields"].append(self.field(out["class"]))
            elif self.directive(".method"):
                out["methods"].append(self.method(out["class"]))
            elif self.text == ".annotation":
                out["annotations"] += self.annotations()
            else:
                raise self.fail("a directive")
        return out


class Code:
    """A method's body. Labels may stand before what they name, so they are looked up at its end."""

    def __init__(self, t: Reader, ins: int) -> None:
        self.t, self.ins, self.registers = t, ins, None
        self.locals: int | None = None
        self.labels: dict[str, int] = {}
        self.code: list[dict] = []
        self.debug: list[dict] = []
        self.tries: list[dict] = []
        self.parameters: list[dict] = []

    def label(self) -> str:
        return self.t.take("label")

    def index(self, label: str) -> int:
        if label not in self.labels:
            raise self.t.fail(f"the label {label}")
        return self.labels[label]

    def read(self) -> dict:
        t, notes = self.t, []
        while not t.closes("method"):
            if t.kind == "label":
                name = self.label()
                if name in self.labels:
                    raise t.fail("a new label")
                self.labels[name] = len(self.code)
            elif t.text == ".annotation":
                notes += t.annotations()
                continue
            elif t.kind == "directive":
                self.directive()
            elif t.kind == "word" and t.text in CODES:
                self.code.append(self.operation())
            else:
                raise t.fail("an instruction")
            t.end_line()
        t.end_line()
        total = self.registers if self.registers is not None else (self.locals or 0) + self.ins
        return {"annotations": notes, "parameters": [self.numbered(p, total) for p in self.parameters], "code": self.finished(total) if self.code else None}

    def numbered(self, x: dict, total: int) -> dict:
        """x with registers as numbers: parameters' registers are the last ones."""

        def number(name: str) -> int:
            n = int(name[1:]) + (total - self.ins if name[0] == "p" else 0)
            if n >= total:
                raise self.t.fail(f"a register below {total} instead of {name}")
            return n

        return x | ({"registers": [number(r) for r in x["registers"]]} if "registers" in x else {}) | ({"register": number(x["register"])} if "register" in x else {})

    def finished(self, total: int) -> dict:
        code = [self.numbered(x, total) for x in self.code]
        owners: dict[int, int] = {}
        for i, x in enumerate(code):
            if "target" in x:
                x["target_index"] = self.index(x.pop("target"))
                owners.setdefault(x["target_index"], i)
            if "targets" in x:
                x["target_indices"] = [self.index(n) for n in x.pop("targets")]
        for i, x in enumerate(code):
            if x["operation"] in ("packed-switch-payload", "sparse-switch-payload", "fill-array-data-payload"):
                if i not in owners:
                    raise self.t.fail("an instruction that uses each payload")
                x["owner_index"] = owners[i]
        tries = [{"start_index": self.index(x["from"]), "end_index": self.index(x["to"]), "exception": x["exception"], "handler_index": self.index(x["handler"])} for x in self.tries]
        outs = max((len(x["registers"]) for x in code if x["operation"].startswith("invoke-")), default=0)
        return {"registers": total, "ins": self.ins, "outs": outs, "instructions": code, "tries": tries, "debug": [self.numbered(x, total) for x in self.debug]}

    def directive(self) -> None:
        t = self.t
        name, here = t.take("directive"), len(self.code)
        if name == ".registers":
            self.registers = t.number()
        elif name == ".locals":
            self.locals = t.number()
        elif name == ".line":
            self.debug.append({"index": here, "op": "line", "value": t.number()})
        elif name == ".prologue":
            self.debug.append({"index": here, "op": "set_prologue_end"})
        elif name == ".epilogue":
            self.debug.append({"index": here, "op": "set_epilogue_begin"})
        elif name == ".source":
            self.debug.append({"index": here, "op": "set_file", "name": unescape(t.take("string")[1:-1])})
        elif name in (".restart", ".end"):
            if t.take("word") != "local":
                t.at -= 1
                raise t.fail("'local'")
            self.debug.append({"index": here, "op": f"{name[1:]}_local", "register": self.register()})
        elif name == ".local":
            found = {"index": here, "op": "start_local", "register": self.register()}
            if t.accept(","):
                if t.kind == "word" and t.text.startswith("null:"):
                    found |= {"name": None, "type": t.take("word")[5:]}
                else:
                    found |= {"name": unescape(t.take("string")[1:-1]), "type": self.label()[1:]}
                if not TYPE.fullmatch(found["type"]):
                    raise t.fail("a type of the local")
                if t.accept(","):
                    found |= {"op": "start_local_extended", "signature": unescape(t.take("string")[1:-1])}
            self.debug.append(found)
        elif name in (".param", ".parameter"):
            found = {"register": self.register(), "name": unescape(t.take("string")[1:-1]) if t.accept(",") else None, "annotations": []}
            at = t.at
            t.end_line()
            notes = t.annotations()
            if t.closes("param") or t.closes("parameter"):
                found["annotations"] = notes
            else:
                t.at = at
            self.parameters.append(found)
        elif name in (".catch", ".catchall"):
            kind = t.type() if name == ".catch" else None
            t.expect("{")
            first = self.label()
            t.expect("..")
            last = self.label()
            t.expect("}")
            self.tries.append({"exception": kind, "from": first, "to": last, "handler": self.label()})
        elif name == ".packed-switch":
            first = t.number()
            self.code.append({"operation": "packed-switch-payload", "first": first, "targets": self.lines("packed-switch", self.label)})
        elif name == ".sparse-switch":
            rows = self.lines("sparse-switch", self.case)
            self.code.append({"operation": "sparse-switch-payload", "keys": [k for k, _ in rows], "targets": [v for _, v in rows]})
        elif name == ".array-data":
            width = t.number()
            self.code.append({"operation": "fill-array-data-payload", "width": width, "data": self.lines("array-data", t.number)})
        else:
            t.at -= 1
            raise t.fail("a directive of code")

    def lines(self, what: str, item) -> list:  # noqa: ANN001
        out = []
        self.t.end_line()
        while not self.t.closes(what):
            out.append(item())
            self.t.end_line()
        return out

    def case(self) -> tuple[int, str]:
        key = self.t.number()
        self.t.expect("->")
        return key, self.label()

    def register(self) -> str:
        if self.t.kind != "word" or not REGISTER.fullmatch(self.t.text):
            raise self.t.fail("a register")
        return self.t.take("word")

    def registers_in_braces(self) -> list[str]:
        t = self.t
        if t.accept("}"):
            return []
        out = [self.register()]
        if t.accept(".."):
            last = self.register()
            if last[0] != out[0][0] or int(last[1:]) < int(out[0][1:]):
                raise t.fail("a range of registers")
            out = [f"{last[0]}{n}" for n in range(int(out[0][1:]), int(last[1:]) + 1)]
        while t.accept(","):
            out.append(self.register())
        t.expect("}")
        return out

    def operation(self) -> dict:
        """An operation with its operands, told apart by how they are written."""
        t = self.t
        out: dict = {"operation": t.take("word"), "registers": []}
        while t.kind not in ("line", "end"):
            text = t.text
            if t.accept("{"):
                out["registers"] += self.registers_in_braces()
            elif t.kind == "label":
                out["target"] = self.label()
            elif t.kind == "string":
                out["string"] = unescape(t.take("string")[1:-1])
            elif REGISTER.fullmatch(text):
                out["registers"].append(self.register())
            elif NUMBER.fullmatch(text):
                out["literal"] = t.number()
            elif "->" in text:
                found = t.member()
                out[found["type"]] = found
            elif m := re.fullmatch(r"\((.*)\)(.+)", text):
                t.at += 1
                out["prototype"] = prototype(m[1], m[2])
            else:
                out["type"] = t.type()
            if not t.accept(","):
                break
        return out


def class_definition(c: Cursor) -> dict:
    """The class of a file. Fields and methods keep their order; code's labels are instruction indices, registers numbers."""
    t = Reader(c)
    return t.whole(t.class_)
