"""Zig source files as trees."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor
from ..operators.tokens import Tokens

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)|(?P<lines>\\\\[^\n]*(?:\n[ \t]*\\\\[^\n]*)*)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.)+')"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<quoted>@"(?:[^"\\\n]|\\.)*")|(?P<builtin>@[A-Za-z_]\w*)"""
    r"""|(?P<number>0[xob][0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]+)?(?:[pP][+-]?\d+)?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)"""
    r"""|(?P<mark>\.\.\.|<<\|?=|>>=|[-+*]%=|\+\+|\*\*|=>|==|!=|<=|>=|<<|>>|[-+*]%|[-+*/%&|^]=|\|\||\.\.|\.\*|\.\?|[-+*/%&|^~!=<>(){}\[\],;:.?])"""
)
#: The language's words that are no names, and operators from what binds least to what binds most.
KEYWORDS = set("addrspace align allowzero and anyframe anytype asm break callconv catch comptime const continue defer else enum errdefer error export extern fn for if inline linksection noalias noinline nosuspend opaque or orelse packed pub resume return struct suspend switch test threadlocal try union unreachable usingnamespace var volatile while".split())
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("orelse", "catch"), ("&", "|", "^"), ("<<", ">>"), ("+", "-", "++", "+%", "-%"), ("*", "/", "%", "**", "*%", "||"))
BINDING = {op: i for i, level in enumerate(LEVELS) for op in level}
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "+%=", "-%=", "*%=")
CONTAINERS = ("struct", "enum", "union", "opaque")
PREFIX = ("-", "~", "!", "&", "-%")


class Reader(Tokens):
    def __init__(self, c: Cursor) -> None:
        super().__init__(c, TOKEN)

    def name(self) -> str:
        if self.kind == "quoted":
            return self.take("quoted")
        if self.kind == "word" and self.text in KEYWORDS:
            raise self.fail("a name")
        return self.take("word")

    # expressions
    def expression(self, least: int = 0, braces: bool = True) -> dict:
        """Binary operators by how strongly they bind, all to the left. braces: whether { after a type begins its value."""
        with self.nested():
            left = self.prefix(braces)
            while (op := self.text) in BINDING and BINDING[op] >= least and self.kind in ("word", "mark"):
                self.at += 1
                found = {"type": "BinaryExpr", "operator": op, "left": left}
                if op == "catch" and (capture := self.capture()) is not None:
                    found["capture"] = capture[0]
                right = self.jump() or self.expression(BINDING[op] + 1, braces)
                left = found | {"right": right}
            return left

    def jump(self) -> dict | None:
        if self.text in ("return", "break", "continue") and self.kind == "word":
            return self.leave()
        return None

    def prefix(self, braces: bool) -> dict:
        if op := self.accept(*PREFIX):
            return {"type": "UnaryExpr", "operator": op, "operand": self.prefix(braces)}
        if word := self.accept("try", "comptime"):
            return {"type": f"{word.capitalize()}Expr", "operand": self.prefix(braces) if word == "try" else self.expression(0, braces)}
        left = self.type(braces)
        if self.accept("!"):
            return {"type": "ErrorUnionType", "error": left, "payload": self.prefix(braces)}
        return left

    def type(self, braces: bool = True) -> dict:
        """Prefixes of types, then a primary expression with its suffixes."""
        if self.accept("?"):
            return {"type": "OptionalType", "child": self.type(braces)}
        if star := self.accept("*", "**"):
            inner = self.pointer("one", braces)
            return {"type": "PointerType", "size": "one", "isConst": False, "child": inner} if star == "**" else inner
        if self.text == "[" and self.kind == "mark":
            self.at += 1
            if self.accept("*"):
                sentinel = self.expression() if self.accept(":") else None
                self.expect("]")
                return self.pointer("many", braces, sentinel)
            if self.text in ("]", ":"):
                sentinel = self.expression() if self.accept(":") else None
                self.expect("]")
                return self.pointer("slice", braces, sentinel)
            length = self.expression()
            sentinel = {"sentinel": self.expression()} if self.accept(":") else {}
            self.expect("]")
            return self.suffixes({"type": "ArrayType", "length": length} | sentinel | {"child": self.type(False)}, braces)
        return self.suffixes(self.primary(), braces)

    def pointer(self, size: str, braces: bool, sentinel: dict | None = None) -> dict:
        const = False
        while word := self.accept("const", "volatile", "allowzero", "align"):
            const = const or word == "const"
            if word == "align":
                self.expect("(")
                self.expression()
                self.expect(")")
        return {"type": "PointerType", "size": size, "isConst": const} | ({"sentinel": sentinel} if sentinel else {}) | {"child": self.type(braces)}

    def suffixes(self, x: dict, braces: bool) -> dict:
        while self.kind == "mark":
            if self.accept(".*"):
                x = {"type": "FieldAccessExpr", "operand": x, "member": "*"}
            elif self.accept(".?"):
                x = {"type": "FieldAccessExpr", "operand": x, "member": "?"}
            elif self.text == "." and (self.kinds[self.at + 1] in ("word", "quoted")):
                self.at += 2
                x = {"type": "FieldAccessExpr", "operand": x, "member": self.texts[self.at - 1]}
            elif self.accept("("):
                x = {"type": "CallExpr", "callee": x, "args": self.separated(self.expression, ")")}
            elif self.accept("["):
                first = self.expression()
                if self.accept(".."):
                    x = {"type": "SliceExpr", "operand": x, "start": first} | ({"end": self.expression()} if self.text not in ("]", ":") else {}) | ({"sentinel": self.expression()} if self.accept(":") else {})
                else:
                    x = {"type": "IndexExpr", "operand": x, "index": first}
                self.expect("]")
            elif braces and self.text == "{" and x["type"] in ("Identifier", "FieldAccessExpr", "CallExpr", "ArrayType", "BuiltinCallExpr"):
                found = self.attempt(self.values)
                if found is None:
                    return x
                x = found | {"operand": x}
            else:
                return x
        return x

    def values(self) -> dict:
        """{.a = 1} or {1, 2}."""
        self.expect("{")
        if self.text == "." and self.ahead(2) == "=":
            return {"type": "StructInitExpr", "fields": self.separated(self.field_value, "}")}
        found = self.separated(self.expression, "}")
        return {"type": "ArrayInitExpr", "elements": found} if found else {"type": "StructInitExpr", "fields": []}

    def field_value(self) -> dict:
        self.expect(".")
        name = self.take("quoted" if self.kind == "quoted" else "word")
        self.expect("=")
        return {"type": "StructInitField", "name": name, "value": self.expression()}

    def primary(self) -> dict:
        kind, text = self.kind, self.text
        if kind == "number":
            self.at += 1
            float_ = "." in text or not text.startswith("0x") and re.search("[eE]", text) or "p" in text.lower()
            return {"type": "FloatLiteral" if float_ else "IntegerLiteral", "value": text}
        if kind == "string":
            self.at += 1
            return {"type": "StringLiteral", "value": text[1:-1]}
        if kind == "lines":
            self.at += 1
            return {"type": "MultilineStringLiteral", "value": "\n".join(re.sub(r"^[ \t]*\\\\", "", x) for x in text.split("\n"))}
        if kind == "char":
            self.at += 1
            return {"type": "CharLiteral", "value": text[1:-1]}
        if kind == "builtin":
            self.at += 1
            self.expect("(")
            return {"type": "BuiltinCallExpr", "name": text[1:], "args": self.separated(self.expression, ")")}
        if kind == "quoted":
            return {"type": "Identifier", "name": self.name()}
        if kind == "mark":
            if self.accept("("):
                inner = self.expression()
                self.expect(")")
                return {"type": "GroupedExpr", "inner": inner}
            if text == "{":
                return self.block()
            if self.accept("."):
                if self.text == "{":
                    return self.values()
                return {"type": "EnumLiteral", "name": self.take("quoted" if self.kind == "quoted" else "word")}
            raise self.fail("an expression")
        if text in ("true", "false", "null", "undefined"):
            self.at += 1
            return {"type": "BoolLiteral", "value": text == "true"} if text in ("true", "false") else {"type": f"{text.capitalize()}Literal"}
        if text == "if":
            return self.branch(self.expression)
        if text in ("while", "for", "inline"):
            return self.loop()
        if text == "switch":
            return self.switch()
        if text == "fn":
            self.at += 1
            self.expect("(")
            params = self.separated(self.parameter, ")")
            self.conventions()
            return {"type": "FnProtoType", "params": params, "returnType": self.prefix(False)}
        if text == "error":
            self.at += 1
            if self.accept("{"):
                return {"type": "ErrorSetExpr", "names": self.separated(self.name, "}")}
            return {"type": "Identifier", "name": "error"}
        if text in CONTAINERS or text in ("packed", "extern"):
            return self.container()
        if text in ("unreachable", "anytype"):
            self.at += 1
            return {"type": "Identifier", "name": text}
        if self.ahead() == ":" and self.ahead(2) in ("{", "while", "for", "inline", "switch"):
            return self.labelled()
        return {"type": "Identifier", "name": self.name()}

    def labelled(self) -> dict:
        label = self.name()
        self.expect(":")
        return (self.block() if self.text == "{" else self.switch() if self.text == "switch" else self.loop()) | {"label": label}

    def container(self) -> dict:
        layout = self.accept("packed", "extern")
        kind = self.accept(*CONTAINERS)
        if not kind:
            raise self.fail("a container")
        argument = None
        if self.accept("("):
            argument = {"type": "Identifier", "name": "enum"} if self.accept("enum") else self.expression()
            self.expect(")")
        self.expect("{")
        found = {"type": "StructExpr", "members": self.members("}")}
        extra = {"kind": kind} if kind != "struct" else {}
        return found | extra | ({"layout": layout} if layout else {}) | ({"argument": argument} if argument else {})

    def capture(self) -> list[str] | None:
        if not self.accept("|"):
            return None
        out = [self.accept("*") + self.name()]
        while self.accept(","):
            out.append(self.accept("*") + self.name())
        self.expect("|")
        return out

    def branch(self, body) -> dict:  # noqa: ANN001
        """if as an expression or statement: what its branches are is the caller's choice."""
        self.expect("if")
        self.expect("(")
        out: dict = {"type": "IfExpr", "condition": self.expression()}
        self.expect(")")
        if (capture := self.capture()) is not None:
            out["capture"] = ", ".join(capture)
        out["body"] = self.jump() or body()
        if self.accept("else"):
            if (capture := self.capture()) is not None:
                out["elseCapture"] = ", ".join(capture)
            out["elseBody"] = self.jump() or body()
        return out

    def switch(self) -> dict:
        self.expect("switch")
        self.expect("(")
        operand = self.expression()
        self.expect(")")
        self.expect("{")
        return {"type": "SwitchExpr", "operand": operand, "prongs": self.separated(self.prong, "}")}

    def prong(self) -> dict:
        self.accept("inline")
        out: dict = {"type": "SwitchProng", "cases": [], "isElse": bool(self.accept("else"))}
        while not out["isElse"] and self.text != "=>":
            case = self.expression()
            if self.accept("..."):
                case = {"type": "BinaryExpr", "operator": "...", "left": case, "right": self.expression()}
            out["cases"].append(case)
            if not self.accept(","):
                break
        self.expect("=>")
        if (capture := self.capture()) is not None:
            out["capture"] = ", ".join(capture)
        return out | {"body": self.jump() or self.assignment()}

    def loop(self, body=None) -> dict:  # noqa: ANN001
        inline, word = bool(self.accept("inline")), self.accept("while", "for")
        if not word:
            raise self.fail("a loop")
        body = body or self.expression
        self.expect("(")
        if word == "while":
            out: dict = {"type": "WhileStmt", "isInline": inline, "condition": self.expression()}
            self.expect(")")
            if (capture := self.capture()) is not None:
                out["capture"] = ", ".join(capture)
            if self.accept(":"):
                self.expect("(")
                out["continuation"] = self.assignment()
                self.expect(")")
        else:
            out = {"type": "ForStmt", "isInline": inline, "inputs": self.separated(self.range, ")"), "captures": self.capture() or []}
        out["body"] = self.jump() or body()
        if self.accept("else"):
            if (capture := self.capture()) is not None:
                out["elseCapture"] = ", ".join(capture)
            out["elseBody"] = self.jump() or body()
        return out

    def range(self) -> dict:
        first = self.expression()
        if self.accept(".."):
            return {"type": "BinaryExpr", "operator": "..", "left": first} | ({"right": self.expression()} if self.text not in (",", ")") else {})
        return first

    # statements
    def block(self) -> dict:
        self.expect("{")
        out = []
        while not self.accept("}"):
            out.append(self.statement())
        return {"type": "BlockExpr", "statements": out}

    def leave(self) -> dict:
        word = self.take("word")
        out: dict = {"type": f"{word.capitalize()}Stmt"}
        if word != "return" and self.accept(":"):
            out["label"] = self.name()
        if word != "continue" and self.text not in (";", ",", ")", "}", "else"):
            out["value"] = self.expression()
        return out

    def assignment(self) -> dict:
        target = self.expression()
        if op := self.accept(*ASSIGN):
            return {"type": "AssignStmt", "target": target, "operator": op, "value": self.jump() or self.expression()}
        return target

    def statement(self) -> dict:
        with self.nested():
            text = self.text
            if self.kind == "word":
                if text in ("const", "var") or text == "comptime" and self.ahead() in ("const", "var"):
                    return self.variable({"isPub": False, "isExtern": False, "isComptime": bool(self.accept("comptime")), "isThreadlocal": False})
                if text in ("return", "break", "continue"):
                    out = self.leave()
                    self.expect(";")
                    return out
                if text in ("defer", "errdefer"):
                    self.at += 1
                    out = {"type": "DeferStmt", "isErrdefer": text == "errdefer"}
                    if (capture := self.capture()) is not None:
                        out["capture"] = capture[0]
                    return out | {"body": self.statement()}
                if text == "if":
                    return self.closed(self.branch(self.part))
                if text in ("while", "for") or text == "inline" and self.ahead() in ("while", "for"):
                    return self.closed(self.loop(self.part))
                if self.ahead() == ":" and self.ahead(2) in ("while", "for", "inline"):
                    label = self.name()
                    self.expect(":")
                    return self.closed(self.loop(self.part) | {"label": label})
            out = self.assignment()
            return self.closed(out)

    def part(self) -> dict:
        """The body of a branch or loop that is a statement: a block, or an assignment whose ; ends the whole."""
        if self.kind == "word" and self.text == "if":
            return self.branch(self.part)
        if self.kind == "word" and self.text in ("while", "for"):
            return self.loop(self.part)
        return self.assignment()

    def closed(self, out: dict) -> dict:
        """A statement's ;, which may be missing only after a closing brace."""
        if not self.accept(";") and self.texts[self.at - 1] != "}":
            raise self.fail("';'")
        return out

    # declarations
    def variable(self, flags: dict) -> dict:
        out: dict = {"type": "VarDecl", "isConst": self.accept("const", "var") == "const"} | flags | {"name": self.name()}
        if self.accept(":"):
            out["typeExpr"] = self.prefix(False)
        out |= self.aligned()
        if self.accept("="):
            out["initExpr"] = self.expression()
        self.expect(";")
        return out

    def aligned(self) -> dict:
        if not self.accept("align"):
            return {}
        self.expect("(")
        out = {"alignExpr": self.expression()}
        self.expect(")")
        return out

    def conventions(self) -> None:
        while self.accept("align", "callconv", "linksection", "addrspace"):
            self.expect("(")
            self.expression()
            self.expect(")")

    def parameter(self) -> dict:
        out: dict = {"type": "FnParam", "isComptime": False, "isNoalias": False}
        while word := self.accept("comptime", "noalias"):
            out["isComptime" if word == "comptime" else "isNoalias"] = True
        if self.accept("..."):
            return out | {"name": "..."}
        if self.ahead() == ":" and self.kind in ("word", "quoted"):
            out["name"] = self.name()
            self.expect(":")
        return out | {"typeExpr": self.prefix(False)}

    def function(self, flags: dict) -> dict:
        self.expect("fn")
        out = {"type": "FnDecl"} | {k: v for k, v in flags.items() if k != "isThreadlocal"} | {"name": self.name()}
        self.expect("(")
        out["params"] = self.separated(self.parameter, ")")
        self.conventions()
        out["returnType"] = self.prefix(False)
        if not self.accept(";"):
            out["body"] = self.block()
        return out

    def member(self) -> dict:
        with self.nested():
            if self.kind == "word" and self.text == "test" and self.ahead() != ":":
                self.at += 1
                name = {"name": self.take("string")[1:-1]} if self.kind == "string" else {"name": self.name()} if self.text != "{" else {}
                return {"type": "TestDecl"} | name | {"body": self.block()}
            start, words = self.at, set()
            while word := self.accept("pub", "extern", "export", "inline", "noinline", "comptime", "threadlocal"):
                words.add(word)
                if word == "extern" and self.kind == "string":
                    self.at += 1
            flags = {f"is{w.capitalize()}": w in words for w in ("pub", "extern", "export", "inline", "comptime", "threadlocal")}
            if self.text == "fn" and self.kind == "word":
                return self.function(flags)
            if self.text in ("const", "var") and self.kind == "word":
                return self.variable({k: flags[k] for k in ("isPub", "isExtern", "isComptime", "isThreadlocal")})
            if self.accept("usingnamespace"):
                out = {"type": "UsingnamespaceDecl", "isPub": flags["isPub"], "expression": self.expression()}
                self.expect(";")
                return out
            self.at = start
            if self.text == "comptime" and self.ahead() == "{":
                self.at += 1
                return {"type": "ComptimeExpr", "operand": self.block()}
            self.accept("comptime")
            out = {"type": "ContainerField", "name": self.name()}
            if self.accept(":"):
                out["typeExpr"] = self.prefix(False)
            out |= self.aligned()
            if self.accept("="):
                out["defaultValue"] = self.expression()
            if not self.accept(",") and self.text != "}" and self.kind != "end":
                raise self.fail("','")
            return out

    def members(self, close: str) -> list[dict]:
        out = []
        while not (self.kind == "end" if not close else self.accept(close)):
            out.append(self.member())
        return out


def source_file(c: Cursor) -> dict:
    """The tree of a file; comments are left out, literals keep their escapes."""
    t = Reader(c)
    return t.whole(lambda: {"type": "Root", "members": t.members("")})
