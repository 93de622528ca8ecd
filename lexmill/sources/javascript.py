"""JavaScript programs as trees of the common syntax-tree format, without positions."""

from __future__ import annotations

import re

from ..operators.cursor import Cursor, ParseFailure
from ..operators.tokens import Tokens

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/|\#![^\n]*)|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<word>(?:[^\W\d]|[$])[\w$]*)|(?P<private>\#(?:[^\W\d]|[$])[\w$]*)"""
    r"""|(?P<number>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<mark>\.\.\.|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\*\*|\?\?|\?\.(?!\d)|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%&|^]=|[-+*/%&|^~!=<>?:;,.(){}\[\]])"""
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Reserved words, operators from what binds least to what binds most, escapes.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
LEVELS = (("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "in", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
BINDING = {op: i for i, level in enumerate(LEVELS) for op in level}
LOGICAL = ("??", "||", "&&")
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
UNARY = ("-", "+", "!", "~", "typeof", "void", "delete")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def cooked(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "ux" and len(e) > 1:
            return chr(int(e[1:].strip("{}"), 16))
        return ESCAPES.get(e, e)

    plain = re.sub(r"\\(u\{[\da-fA-F]{1,5}\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|[\s\S])", one, text)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def prologue(body: list[dict]) -> list[dict]:
    """A function's or program's statements, where strings that come first are directives."""
    n = 0
    while n < len(body) and body[n]["type"] == "ExpressionStatement" and body[n]["expression"].get("raw", " ")[0] in "'\"":
        n += 1
    return [x | {"directive": x["expression"]["raw"][1:-1]} for x in body[:n]] + body[n:]


class Reader(Tokens):
    def __init__(self, c: Cursor) -> None:
        self.awaits = self.yields = False
        super().__init__(c, TOKEN)

    def token(self, pattern: re.Pattern, i: int) -> tuple[str, int]:
        """A slash begins a regular expression where no operand has just ended; templates are one token."""
        data = self.cursor.data
        if data[i] == "`":
            return "template", self.template_end(i)
        if data[i] == "/" and data[i + 1 : i + 2] not in ("/", "*"):
            kind, text = (self.kinds[-1], self.texts[-1]) if self.kinds else ("mark", "")
            operand = kind in ("number", "string", "template", "regex", "private") or kind == "word" and (text not in RESERVED or text in ("this", "super", "null", "true", "false")) or text in (")", "]")
            if not operand and (m := REGEX.match(data, i, self.cursor.end)):
                return "regex", m.end()
        return super().token(pattern, i)

    def template_end(self, i: int) -> int:
        data, depth, i = self.cursor.data, [], i + 1
        while i < self.cursor.end:
            x = data[i]
            if x == "\\":
                i += 1
            elif x == "`":
                if not depth:
                    return i + 1
                if depth[-1] == "`":
                    depth.pop()
                else:
                    depth.append("`")
            elif data.startswith("${", i) and (not depth or depth[-1] == "`"):
                depth.append("{")
                i += 1
            elif depth and depth[-1] == "{" and x in "'\"" and (m := TOKEN.match(data, i)):
                i = m.end() - 1
            elif x == "{" and depth and depth[-1] == "{":
                depth.append("{")
            elif x == "}" and depth and depth[-1] == "{":
                depth.pop()
            i += 1
        raise ParseFailure("Unterminated", "a template doesn't end", i)

    def line_before(self) -> bool:
        """Whether a line ends between the last token and this one."""
        end = self.places[self.at - 1] + len(self.texts[self.at - 1]) if self.at else 0
        return "\n" in self.cursor.data[end : self.places[self.at]]

    def semicolon(self) -> None:
        if not self.accept(";") and self.text != "}" and self.kind != "end" and not self.line_before():
            raise self.fail("';'")

    def name(self) -> dict:
        if self.kind == "word" and self.text in RESERVED:
            raise self.fail("a name")
        return {"type": "Identifier", "name": self.take("word")}

    # functions and patterns
    def function_rest(self, is_async: bool, generator: bool) -> dict:
        """Parameters and body of a function that isn't an arrow."""
        before, (self.awaits, self.yields) = (self.awaits, self.yields), (is_async, generator)
        try:
            self.expect("(")
            return {"params": self.separated(self.parameter, ")"), "body": self.body()}
        finally:
            self.awaits, self.yields = before

    def parameter(self) -> dict:
        if self.accept("..."):
            return {"type": "RestElement", "argument": self.target()}
        return self.defaulted(self.target())

    def defaulted(self, left: dict) -> dict:
        return {"type": "AssignmentPattern", "left": left, "right": self.assignment()} if self.accept("=") else left

    def target(self) -> dict:
        if self.text in ("[", "{") and self.kind == "mark":
            return self.pattern(self.primary())
        return self.name()

    def pattern(self, x: dict) -> dict:
        """An expression as what is assigned to."""
        kind = x["type"]
        if kind == "ArrayExpression":
            return {"type": "ArrayPattern", "elements": [e and self.pattern(e) for e in x["elements"]]}
        if kind == "ObjectExpression":
            return {"type": "ObjectPattern", "properties": [self.pattern(p) if p["type"] == "SpreadElement" else p | {"value": self.pattern(p["value"])} for p in x["properties"]]}
        if kind == "SpreadElement":
            return {"type": "RestElement", "argument": self.pattern(x["argument"])}
        if kind == "AssignmentExpression" and x["operator"] == "=":
            return {"type": "AssignmentPattern", "left": x["left"], "right": x["right"]}
        if kind in ("Identifier", "MemberExpression", "AssignmentPattern", "ArrayPattern", "ObjectPattern"):
            return x
        raise self.fail("something to assign to")

    # expressions
    def expression(self, no_in: bool = False) -> dict:
        first = self.assignment(no_in)
        if self.text != "," or self.kind != "mark":
            return first
        out = [first]
        while self.accept(","):
            out.append(self.assignment(no_in))
        return {"type": "SequenceExpression", "expressions": out}

    def assignment(self, no_in: bool = False) -> dict:
        with self.nested():
            if (arrow := self.arrow(no_in)) is not None:
                return arrow
            if self.yields and self.accept("yield"):
                many = bool(self.accept("*"))
                ends = self.line_before() or self.kind == "end" or self.text in (")", "]", "}", ",", ";", ":")
                return {"type": "YieldExpression", "delegate": many, "argument": None if ends and not many else self.assignment(no_in)}
            left = self.conditional(no_in)
            if op := self.accept(*ASSIGN):
                left = self.pattern(left) if op == "=" else left
                return {"type": "AssignmentExpression", "operator": op, "left": left, "right": self.assignment(no_in)}
            return left

    def arrow(self, no_in: bool) -> dict | None:
        at, is_async = self.at, False
        if self.text == "async" and self.kind == "word" and (self.kinds[self.at + 1] == "word" and self.ahead() not in RESERVED or self.ahead() == "("):
            self.at, is_async = at + 1, True
        if self.kind == "word" and self.text not in RESERVED and self.ahead() == "=>":
            parameters = [self.name()]
        elif self.text == "(" and self.kind == "mark" and self.after_parenthesis() == "=>":
            self.at += 1
            parameters = self.separated(self.parameter, ")")
        else:
            self.at = at
            return None
        self.expect("=>")
        before, (self.awaits, self.yields) = (self.awaits, self.yields), (is_async, False)
        try:
            body = self.body() if self.text == "{" else self.assignment(no_in)
        finally:
            self.awaits, self.yields = before
        return {"type": "ArrowFunctionExpression", "id": None, "expression": body["type"] != "BlockStatement", "generator": False, "async": is_async, "params": parameters, "body": body}

    def after_parenthesis(self) -> str:
        open_ = 0
        for i in range(self.at, len(self.texts)):
            if self.kinds[i] == "mark":
                open_ += {"(": 1, ")": -1}.get(self.texts[i], 0)
                if not open_:
                    return self.texts[i + 1]
        return ""

    def conditional(self, no_in: bool) -> dict:
        test = self.binary(0, no_in)
        if not self.accept("?"):
            return test
        first = self.assignment()
        self.expect(":")
        return {"type": "ConditionalExpression", "test": test, "consequent": first, "alternate": self.assignment(no_in)}

    def binary(self, least: int, no_in: bool) -> dict:
        left = {"type": "PrivateIdentifier", "name": self.take("private")[1:]} if self.kind == "private" else self.unary()
        while (op := self.text) in BINDING and BINDING[op] >= least and self.kind in ("word", "mark") and not (no_in and op == "in"):
            self.at += 1
            right = self.binary(BINDING[op] + (op != "**"), no_in)
            left = {"type": "LogicalExpression" if op in LOGICAL else "BinaryExpression", "left": left, "operator": op, "right": right}
        return left

    def unary(self) -> dict:
        with self.nested():
            if op := self.accept("++", "--"):
                return {"type": "UpdateExpression", "operator": op, "prefix": True, "argument": self.unary()}
            if op := self.accept(*UNARY):
                return {"type": "UnaryExpression", "operator": op, "prefix": True, "argument": self.unary()}
            if self.awaits and self.accept("await"):
                return {"type": "AwaitExpression", "argument": self.unary()}
            x = self.postfix(self.primary())
            if self.text in ("++", "--") and self.kind == "mark" and not self.line_before():
                self.at += 1
                x = {"type": "UpdateExpression", "operator": self.texts[self.at - 1], "prefix": False, "argument": x}
            return x

    def argument(self) -> dict:
        return {"type": "SpreadElement", "argument": self.assignment()} if self.accept("...") else self.assignment()

    def property_name(self) -> dict:
        if self.kind == "private":
            return {"type": "PrivateIdentifier", "name": self.take("private")[1:]}
        return {"type": "Identifier", "name": self.take("word")}

    def postfix(self, x: dict, calls: bool = True) -> dict:
        chain = False
        while True:
            optional = False
            if calls and self.accept("?."):
                chain = optional = True
                if self.text not in ("(", "["):
                    x = {"type": "MemberExpression", "object": x, "property": self.property_name(), "computed": False, "optional": True}
                    continue
            if self.accept("."):
                x = {"type": "MemberExpression", "object": x, "property": self.property_name(), "computed": False, "optional": False}
            elif self.accept("["):
                x = {"type": "MemberExpression", "object": x, "property": self.expression(), "computed": True, "optional": optional}
                self.expect("]")
            elif calls and self.accept("("):
                x = {"type": "CallExpression", "callee": x, "arguments": self.separated(self.argument, ")"), "optional": optional}
            elif self.kind == "template" and not chain:
                x = {"type": "TaggedTemplateExpression", "tag": x, "quasi": self.template()}
            else:
                return {"type": "ChainExpression", "expression": x} if chain else x

    def number(self) -> dict:
        raw = self.take("number")
        digits = raw.replace("_", "")
        if digits.endswith("n"):
            return {"type": "Literal", "value": None, "raw": raw, "bigint": str(int(digits[:-1], 0))}
        if re.fullmatch(r"0[0-7]+", digits):
            value: float = int(digits, 8)
        else:
            value = float(int(digits, 0)) if re.match(r"0[xXoObB]", digits) else float(digits)
        return {"type": "Literal", "value": int(value) if abs(value) < 1e21 and value == int(value) else value, "raw": raw}

    def template(self) -> dict:
        """Parts between substitutions, which are read by readers of their own."""
        at, end = self.places[self.at], self.places[self.at] + len(self.text)
        self.take("template")
        data, quasis, found, i, start = self.cursor.data, [], [], at + 1, at + 1

        def quasi(stop: int, tail: bool) -> None:
            raw = data[start:stop].replace("\r\n", "\n")
            quasis.append({"type": "TemplateElement", "value": {"raw": raw, "cooked": cooked(raw)}, "tail": tail})

        while i < end - 1:
            if data[i] == "\\":
                i += 2
            elif data.startswith("${", i):
                quasi(i, False)
                stop = self.substitution_end(i + 2)
                inner = Reader(Cursor(data, i + 2, stop))
                inner.awaits, inner.yields, inner.depth = self.awaits, self.yields, self.depth
                found.append(inner.whole(inner.expression))
                i = start = stop + 1
            else:
                i += 1
        quasi(end - 1, True)
        return {"type": "TemplateLiteral", "expressions": found, "quasis": quasis}

    def substitution_end(self, i: int) -> int:
        data, depth = self.cursor.data, 0
        while True:
            x = data[i]
            if x == "`":
                i = self.template_end(i) - 1
            elif x in "'\"" and (m := TOKEN.match(data, i)):
                i = m.end() - 1
            elif x == "{":
                depth += 1
            elif x == "}":
                if not depth:
                    return i
                depth -= 1
            i += 1

    def primary(self) -> dict:
        kind, text = self.kind, self.text
        if kind == "number":
            return self.number()
        if kind == "string":
            self.at += 1
            return {"type": "Literal", "value": cooked(text[1:-1]), "raw": text}
        if kind == "template":
            return self.template()
        if kind == "regex":
            self.at += 1
            body, _, flags = text[1:].rpartition("/")
            return {"type": "Literal", "value": None, "raw": text, "regex": {"pattern": body, "flags": flags}}
        if kind == "mark":
            if self.accept("("):
                x = self.expression()
                self.expect(")")
                return x
            if self.accept("["):
                return self.array()
            if self.accept("{"):
                return {"type": "ObjectExpression", "properties": self.separated(self.property, "}")}
            raise self.fail("an expression")
        if text in ("true", "false", "null"):
            self.at += 1
            return {"type": "Literal", "value": {"true": True, "false": False, "null": None}[text], "raw": text}
        if text in ("this", "super"):
            self.at += 1
            return {"type": "ThisExpression" if text == "this" else "Super"}
        if text == "function" or text == "async" and self.ahead() == "function":
            return self.function("FunctionExpression")
        if text == "class":
            return self.class_("ClassExpression")
        if text == "new":
            return self.creation()
        if text == "import" and self.ahead() == "(":
            self.at += 2
            out = {"type": "ImportExpression", "source": self.assignment(), "options": None}
            self.expect(")")
            return out
        return self.name()

    def creation(self) -> dict:
        self.expect("new")
        if self.accept("."):
            return {"type": "MetaProperty", "meta": {"type": "Identifier", "name": "new"}, "property": {"type": "Identifier", "name": self.take("word")}}
        callee = self.postfix(self.creation() if self.text == "new" else self.primary(), calls=False)
        return {"type": "NewExpression", "callee": callee, "arguments": self.separated(self.argument, ")") if self.accept("(") else []}

    def array(self) -> dict:
        out: list = []
        while not self.accept("]"):
            if self.accept(","):
                out.append(None)
                continue
            out.append(self.argument())
            if not self.accept(","):
                self.expect("]")
                break
        return {"type": "ArrayExpression", "elements": out}

    def key(self) -> tuple[dict, bool]:
        if self.accept("["):
            x = self.assignment()
            self.expect("]")
            return x, True
        if self.kind in ("string", "number"):
            return self.primary(), False
        return self.property_name(), False

    def head(self) -> tuple[bool, bool, str]:
        """(async, generator, kind) before the name of a property or member."""
        is_async = generator = False
        kind = ""
        stops = ("(", ",", "}", ":", "=", ";")
        if self.text == "async" and self.ahead() not in stops:
            self.at, is_async = self.at + 1, True
        if self.accept("*"):
            generator = True
        if self.text in ("get", "set") and self.kind == "word" and self.ahead() not in stops and not is_async and not generator:
            kind = self.take("word")
        return is_async, generator, kind

    def method(self, is_async: bool, generator: bool) -> dict:
        return {"type": "FunctionExpression", "id": None, "expression": False, "generator": generator, "async": is_async} | self.function_rest(is_async, generator)

    def property(self) -> dict:
        if self.accept("..."):
            return {"type": "SpreadElement", "argument": self.assignment()}
        is_async, generator, kind = self.head()
        plain = self.kind == "word"
        key, computed = self.key()
        out = {"type": "Property", "method": False, "shorthand": False, "computed": computed, "key": key, "kind": kind or "init"}
        if self.text == "(" or kind:
            return out | {"method": not kind, "value": self.method(is_async, generator)}
        if self.accept(":"):
            return out | {"value": self.assignment()}
        if not plain or computed or key["name"] in RESERVED:
            raise self.fail("':'")
        return out | {"shorthand": True, "value": self.defaulted(dict(key))}

    def function(self, kind: str) -> dict:
        is_async = bool(self.accept("async"))
        self.expect("function")
        generator = bool(self.accept("*"))
        named = self.name() if self.text != "(" or kind == "FunctionDeclaration" else None
        return {"type": kind, "id": named, "expression": False, "generator": generator, "async": is_async} | self.function_rest(is_async, generator)

    def class_(self, kind: str) -> dict:
        self.expect("class")
        out = {"type": kind, "id": self.name() if self.text not in ("{", "extends") or kind == "ClassDeclaration" else None}
        out["superClass"] = self.postfix(self.primary()) if self.accept("extends") else None
        self.expect("{")
        members = []
        while not self.accept("}"):
            if not self.accept(";"):
                members.append(self.member())
        return out | {"body": {"type": "ClassBody", "body": members}}

    def member(self) -> dict:
        static = False
        if self.text == "static" and self.ahead() not in ("(", "=", ";", "}"):
            self.at, static = self.at + 1, True
            if self.text == "{":
                return {"type": "StaticBlock", "body": self.block()["body"]}
        is_async, generator, kind = self.head()
        key, computed = self.key()
        out = {"static": static, "computed": computed, "key": key}
        if self.text == "(":
            first = not static and not computed and key.get("name", key.get("value")) == "constructor" and key["type"] != "PrivateIdentifier"
            return {"type": "MethodDefinition"} | out | {"kind": kind or ("constructor" if first else "method"), "value": self.method(is_async, generator)}
        value = self.assignment() if self.accept("=") else None
        self.semicolon()
        return {"type": "PropertyDefinition"} | out | {"value": value}

    # statements
    def block(self) -> dict:
        self.expect("{")
        out = []
        while not self.accept("}"):
            out.append(self.statement())
        return {"type": "BlockStatement", "body": out}

    def body(self) -> dict:
        out = self.block()
        return out | {"body": prologue(out["body"])}

    def test(self) -> dict:
        self.expect("(")
        x = self.expression()
        self.expect(")")
        return x

    def declaration(self, no_in: bool = False) -> dict:
        kind = self.take("word")
        out = []
        while True:
            target = self.target()
            out.append({"type": "VariableDeclarator", "id": target, "init": self.assignment(no_in) if self.accept("=") else None})
            if not self.accept(","):
                return {"type": "VariableDeclaration", "declarations": out, "kind": kind}

    def declares(self) -> bool:
        return self.kind == "word" and (self.text in ("var", "const") or self.text == "let" and (self.kinds[self.at + 1] == "word" and self.ahead() not in ("in", "instanceof", "of") or self.ahead() in ("[", "{")))

    def statement(self) -> dict:
        with self.nested():
            return self.statement_here()

    def statement_here(self) -> dict:
        text = self.text if self.kind in ("word", "mark") else ""
        if text == "{":
            return self.block()
        if self.accept(";"):
            return {"type": "EmptyStatement"}
        if self.declares():
            out = self.declaration()
            self.semicolon()
            return out
        if text == "function" or text == "async" and self.ahead() == "function":
            return self.function("FunctionDeclaration")
        if text == "class":
            return self.class_("ClassDeclaration")
        if self.accept("if"):
            return {"type": "IfStatement", "test": self.test(), "consequent": self.statement(), "alternate": self.statement() if self.accept("else") else None}
        if self.accept("while"):
            return {"type": "WhileStatement", "test": self.test(), "body": self.statement()}
        if self.accept("with"):
            return {"type": "WithStatement", "object": self.test(), "body": self.statement()}
        if self.accept("do"):
            body = self.statement()
            self.expect("while")
            out = {"type": "DoWhileStatement", "body": body, "test": self.test()}
            self.accept(";")
            return out
        if self.accept("for"):
            return self.loop()
        if self.accept("switch"):
            return self.switch()
        if self.accept("try"):
            return self.try_()
        if text in ("return", "throw"):
            self.at += 1
            ends = self.line_before() or self.kind == "end" or self.text in (";", "}")
            if ends and text == "throw":
                raise self.fail("an expression")
            out = {"type": f"{text.capitalize()}Statement", "argument": None if ends else self.expression()}
            self.semicolon()
            return out
        if text in ("break", "continue"):
            self.at += 1
            out = {"type": f"{text.capitalize()}Statement", "label": self.name() if self.kind == "word" and not self.line_before() else None}
            self.semicolon()
            return out
        if self.accept("debugger"):
            self.semicolon()
            return {"type": "DebuggerStatement"}
        if self.kind == "word" and self.ahead() == ":" and text not in RESERVED:
            label = self.name()
            self.at += 1
            return {"type": "LabeledStatement", "body": self.statement(), "label": label}
        out = {"type": "ExpressionStatement", "expression": self.expression()}
        self.semicolon()
        return out

    def loop(self) -> dict:
        wait = bool(self.awaits and self.accept("await"))
        self.expect("(")
        first = None if self.text == ";" else self.declaration(True) if self.declares() else self.expression(True)
        if first and (word := self.accept("of", "in")):
            left = first if first["type"] == "VariableDeclaration" else self.pattern(first)
            right = self.assignment() if word == "of" else self.expression()
            self.expect(")")
            return {"type": f"For{word.capitalize()}Statement"} | ({"await": wait} if word == "of" else {}) | {"left": left, "right": right, "body": self.statement()}
        self.expect(";")
        test = None if self.text == ";" else self.expression()
        self.expect(";")
        update = None if self.text == ")" else self.expression()
        self.expect(")")
        return {"type": "ForStatement", "init": first, "test": test, "update": update, "body": self.statement()}

    def switch(self) -> dict:
        out: dict = {"type": "SwitchStatement", "discriminant": self.test(), "cases": []}
        self.expect("{")
        while not self.accept("}"):
            word = self.accept("case", "default")
            if not word:
                raise self.fail("'case'")
            test = self.expression() if word == "case" else None
            self.expect(":")
            body = []
            while self.text not in ("case", "default", "}") or self.kind not in ("word", "mark"):
                body.append(self.statement())
            out["cases"].append({"type": "SwitchCase", "consequent": body, "test": test})
        return out

    def try_(self) -> dict:
        out: dict = {"type": "TryStatement", "block": self.block(), "handler": None, "finalizer": None}
        if self.accept("catch"):
            param = None
            if self.accept("("):
                param = self.target()
                self.expect(")")
            out["handler"] = {"type": "CatchClause", "param": param, "body": self.block()}
        if self.accept("finally"):
            out["finalizer"] = self.block()
        if not out["handler"] and not out["finalizer"]:
            raise self.fail("'catch'")
        return out

    def program(self) -> dict:
        out = []
        while self.kind != "end":
            out.append(self.statement())
        return {"type": "Program", "body": prologue(out), "sourceType": "script"}


def program(c: Cursor) -> dict:
    """The tree of a script; comments are left out, parentheses show only in the tree's shape."""
    t = Reader(c)
    return t.whole(t.program)
