"""Java compilation units as trees."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..operators.cursor import Cursor
from ..operators.tokens import Tokens

TOKEN = re.compile(
    r'''(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<lines>"""[ \t\f]*\n(?:[^\\"]|\\[\s\S]|"(?!""))*""")|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.[0-9a-fA-F]*)')'''
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"""
    r"""|(?P<mark>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^~!=<>?:;,.@(){}\[\]])"""
)  # > is always one token, so that >> may close two lists of type arguments
#: The language's keywords, primitive types, modifiers, and operators from what binds least to what binds most.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed")
KEYWORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
BINDING = {op: i for i, level in enumerate(LEVELS) for op in level}
ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")


def name_node(parts: list[str]) -> dict:
    """A qualified name, nested to the left."""
    out: dict = {"type": "Name", "identifier": parts[0]}
    for p in parts[1:]:
        out = {"type": "Name", "identifier": p, "qualifier": out}
    return out


class Reader(Tokens):
    def __init__(self, c: Cursor) -> None:
        super().__init__(c, TOKEN)

    def separated(self, item: Callable[[], object], close: str, mark: str = ",", trailing: bool = False) -> list:
        return super().separated(item, close, mark, trailing)

    def word(self) -> str:
        if self.kind == "word" and self.text in KEYWORDS:
            raise self.fail("a name")
        return self.take("word")

    def simple(self) -> dict:
        return {"type": "SimpleName", "identifier": self.word()}

    def name(self) -> dict:
        parts = [self.word()]
        while self.text == "." and self.kinds[self.at + 1] == "word" and self.ahead() not in KEYWORDS:
            self.at += 1
            parts.append(self.word())
        return name_node(parts)

    def operator(self) -> tuple[str, int]:
        """The operator here and its tokens; several > without space are one."""
        text, n = self.text, 1
        if self.kind not in ("word", "mark"):
            return "", 0
        if text == ">":
            while n < 4 and self.joined(n) and self.ahead(n) in (">", "=", "==") and not text.endswith("="):
                text, n = text + self.ahead(n), n + 1
            if text.endswith("=="):  # a >== b isn't Java
                text, n = text[:-2], n - 1
        return text, n

    # annotations, modifiers, types
    def annotation(self) -> dict:
        self.expect("@")
        name = self.name()
        if not self.accept("("):
            return {"type": "MarkerAnnotationExpr", "name": name}
        if self.text == ")" or self.kind == "word" and self.ahead() == "=":
            return {"type": "NormalAnnotationExpr", "name": name, "pairs": self.separated(self.pair, ")")}
        value = self.value()
        self.expect(")")
        return {"type": "SingleMemberAnnotationExpr", "name": name, "memberValue": value}

    def pair(self) -> dict:
        name = self.simple()
        self.expect("=")
        return {"type": "MemberValuePair", "name": name, "value": self.value()}

    def value(self) -> dict:
        if self.text == "@":
            return self.annotation()
        return self.initializer() if self.text == "{" else self.expression()

    def annotations(self) -> list[dict]:
        out = []
        while self.text == "@" and self.kind == "mark" and self.ahead() != "interface":
            out.append(self.annotation())
        return out

    def modifiers(self) -> dict:
        out: dict = {"modifiers": [], "annotations": []}
        while True:
            out["annotations"] += self.annotations()
            if self.text == "non" and self.ahead() == "-" and self.ahead(2) == "sealed":
                self.at += 3
                out["modifiers"].append({"type": "Modifier", "keyword": "NON_SEALED"})
            elif self.kind == "word" and self.text in MODIFIERS and not (self.text == "default" and self.ahead() in (":", "->")) and not (self.text == "sealed" and self.ahead() in ("=", ".", ";", ",", "(")):
                out["modifiers"].append({"type": "Modifier", "keyword": self.take("word").upper()})
            else:
                return out

    def arguments(self) -> list[dict]:
        """Type arguments after <, which is used up."""
        out = []
        while not self.accept(">"):
            notes = self.annotations()
            if self.accept("?"):
                bound = self.accept("extends", "super")
                out.append({"type": "WildcardType"} | ({("extendedType" if bound == "extends" else "superType"): self.kind_of()} if bound else {}) | {"annotations": notes})
            else:
                out.append(self.kind_of(notes))
            if not self.accept(",") and self.text != ">":
                raise self.fail("'>'")
        return out

    def class_type(self, notes: list[dict] | None = None) -> dict:
        out: dict | None = None
        while True:
            notes = (notes or []) + self.annotations()
            found: dict = {"type": "ClassOrInterfaceType", "name": self.simple()}
            if out:
                found["scope"] = out
            if self.accept("<"):
                found["typeArguments"] = self.arguments()
            out, notes = found | {"annotations": notes}, None
            if self.text != "." or self.kinds[self.at + 1] != "word" and self.ahead() != "@" or self.ahead() in KEYWORDS:
                return out
            self.at += 1

    def kind_of(self, notes: list[dict] | None = None) -> dict:
        with self.nested():
            notes = (notes or []) + self.annotations()
            if self.kind == "word" and self.text in PRIMITIVES:
                out: dict = {"type": "PrimitiveType", "type_": self.take("word").upper(), "annotations": notes}
            elif self.accept("void"):
                out = {"type": "VoidType", "annotations": notes}
            elif self.text == "var" and self.kinds[self.at + 1] == "word":
                self.at += 1
                out = {"type": "VarType", "annotations": notes}
            else:
                out = self.class_type(notes)
            return self.brackets(out, "TYPE")

    def brackets(self, x: dict, origin: str) -> dict:
        while self.text == "[" and self.ahead() == "]":
            self.at += 2
            x = {"type": "ArrayType", "componentType": x, "origin": origin, "annotations": []}
        return x

    def type_parameters(self) -> list[dict]:
        if not self.accept("<"):
            return []
        return self.separated(self.type_parameter, ">")

    def type_parameter(self) -> dict:
        notes = self.annotations()
        out = {"type": "TypeParameter", "name": self.simple(), "typeBound": [], "annotations": notes}
        if self.accept("extends"):
            out["typeBound"].append(self.class_type())
            while self.accept("&"):
                out["typeBound"].append(self.class_type())
        return out

    # expressions
    def expression(self) -> dict:
        with self.nested():
            if (found := self.lambda_()) is not None:
                return found
            target = self.ternary()
            op, n = self.operator()
            if op in ASSIGN:
                self.at += n
                return {"type": "AssignExpr", "target": target, "value": self.expression(), "operator": op}
            return target

    def lambda_(self) -> dict | None:
        at = self.at
        if self.kind == "word" and self.ahead() == "->" and self.text not in KEYWORDS:
            parameters, enclosed = [self.untyped()], False
        elif self.text == "(" and self.after_parenthesis() == "->":
            self.at += 1
            parameters, enclosed = self.separated(lambda: self.untyped() if self.ahead() in (",", ")") else self.parameter(), ")"), True
        else:
            return None
        if not self.accept("->"):
            self.at = at
            return None
        body = self.block() if self.text == "{" else {"type": "ExpressionStmt", "expression": self.expression()}
        return {"type": "LambdaExpr", "parameters": parameters, "body": body, "isEnclosingParameters": enclosed}

    def after_parenthesis(self) -> str:
        """The token after the parenthesis that closes the one here."""
        open_, i = 0, self.at
        while i < len(self.texts):
            if self.kinds[i] == "mark":
                open_ += {"(": 1, ")": -1}.get(self.texts[i], 0)
                if not open_:
                    return self.texts[i + 1]
            i += 1
        return ""

    def untyped(self) -> dict:
        return {"type": "Parameter", "modifiers": [], "annotations": [], "type_": {"type": "UnknownType"}, "isVarArgs": False, "varArgsAnnotations": [], "name": self.simple()}

    def ternary(self) -> dict:
        condition = self.binary(0)
        if not self.accept("?"):
            return condition
        first = self.expression()
        self.expect(":")
        return {"type": "ConditionalExpr", "condition": condition, "thenExpr": first, "elseExpr": self.lambda_() or self.ternary()}

    def binary(self, least: int) -> dict:
        left = self.unary()
        while (found := self.operator())[0] in BINDING and BINDING[found[0]] >= least:
            op, n = found
            self.at += n
            if op == "instanceof":
                left = {"type": "InstanceOfExpr", "expression": left} | self.pattern()
            else:
                left = {"type": "BinaryExpr", "left": left, "right": self.binary(BINDING[op] + 1), "operator": op}
        return left

    def pattern(self) -> dict:
        """What follows instanceof: a type, and a pattern if names follow."""
        mods = self.modifiers()["modifiers"]
        kind = self.kind_of()
        if self.accept("("):
            return {"type_": kind, "pattern": {"type": "RecordPatternExpr", "type_": kind, "patternList": self.separated(self.component, ")")}}
        if self.kind == "word" and self.text not in KEYWORDS and self.text != "when":
            return {"type_": kind, "pattern": {"type": "TypePatternExpr", "type_": kind, "name": self.simple(), "modifiers": mods}}
        return {"type_": kind}

    def component(self) -> dict:
        found = self.pattern()
        if "pattern" not in found:
            raise self.fail("a pattern")
        return found["pattern"]

    def unary(self) -> dict:
        with self.nested():
            if op := self.accept("++", "--", "+", "-", "!", "~"):
                return {"type": "UnaryExpr", "expression": self.unary(), "operator": op, "prefix": True}
            if self.text == "(" and self.kind == "mark" and (cast := self.attempt(self.cast)) is not None:
                return cast
            x = self.postfix(self.primary())
            while op := self.accept("++", "--"):
                x = {"type": "UnaryExpr", "expression": x, "operator": op, "prefix": False}
            return x

    def cast(self) -> dict:
        self.expect("(")
        kinds = [self.kind_of()]
        while self.accept("&"):
            kinds.append(self.kind_of())
        self.expect(")")
        primitive = kinds[0]["type"] == "PrimitiveType"
        if not primitive and not (self.kind in ("string", "lines", "char", "number") or self.kind == "word" and self.text != "instanceof" or self.text in ("(", "!", "~")):
            raise self.fail("an operand of a cast")
        kind = kinds[0] if len(kinds) == 1 else {"type": "IntersectionType", "elements": kinds, "annotations": []}
        return {"type": "CastExpr", "type_": kind, "expression": self.lambda_() or self.unary()}

    def call_arguments(self) -> list[dict]:
        self.expect("(")
        return self.separated(self.expression, ")")

    def primary(self) -> dict:
        kind, text = self.kind, self.text
        if kind == "number":
            self.at += 1
            if re.search(r"^0[xX][^pP]*$|^0[bB]", text):
                form = "Long" if text[-1] in "lL" else "Integer"
            else:
                form = "Double" if re.search(r"[.eEpPfFdD]", text) else "Long" if text[-1] in "lL" else "Integer"
            return {"type": f"{form}LiteralExpr", "value": text}
        if kind in ("string", "char", "lines"):
            self.at += 1
            form, cut = {"string": ("String", 1), "char": ("Char", 1), "lines": ("TextBlock", 3)}[kind]
            return {"type": f"{form}LiteralExpr", "value": text[cut:-cut]}
        if kind == "mark":
            if self.accept("("):
                inner = self.expression()
                self.expect(")")
                return {"type": "EnclosedExpr", "inner": inner}
            if text == "@":
                return self.annotation()
            raise self.fail("an expression")
        if text in ("true", "false", "null"):
            self.at += 1
            return {"type": "NullLiteralExpr"} if text == "null" else {"type": "BooleanLiteralExpr", "value": text == "true"}
        if text in ("this", "super"):
            self.at += 1
            if text == "this" and self.text == "(":
                raise self.fail("an expression")
            return {"type": f"{text.capitalize()}Expr"}
        if text == "new":
            return self.creation()
        if text == "switch":
            return self.switch("SwitchExpr")
        if (found := self.attempt(self.of_type)) is not None:
            return found
        name = self.simple()
        if self.text == "(":
            return {"type": "MethodCallExpr", "name": name, "arguments": self.call_arguments()}
        return {"type": "NameExpr", "name": name}

    def of_type(self) -> dict:
        """T.class, and references to methods of types that no expression can be: generic or array types and primitives."""
        kind = self.kind_of()
        if self.text == "." and self.ahead() == "class":
            self.at += 2
            return {"type": "ClassExpr", "type_": kind}
        plain = kind["type"] == "ClassOrInterfaceType" and "typeArguments" not in kind
        if self.text != "::" or plain:
            raise self.fail("'::'")
        return self.reference(kind)

    def reference(self, scope: dict) -> dict:
        self.expect("::")
        arguments = {"typeArguments": self.arguments()} if self.accept("<") else {}
        return {"type": "MethodReferenceExpr", "scope": scope, "identifier": self.accept("new") or self.word()} | arguments

    def creation(self, scope: dict | None = None) -> dict:
        self.expect("new")
        arguments = {"typeArguments": self.arguments()} if self.accept("<") else {}
        notes = self.annotations()
        if self.kind == "word" and self.text in PRIMITIVES:
            kind = {"type": "PrimitiveType", "type_": self.take("word").upper(), "annotations": notes}
        else:
            kind = self.class_type(notes)
        if self.text == "[":
            levels = []
            while self.text == "[" and self.kind == "mark":
                self.at += 1
                levels.append({"type": "ArrayCreationLevel"} | ({} if self.text == "]" else {"dimension": self.expression()}) | {"annotations": []})
                self.expect("]")
            return {"type": "ArrayCreationExpr", "elementType": kind, "levels": levels} | ({"initializer": self.initializer()} if self.text == "{" else {})
        out = {"type": "ObjectCreationExpr"} | ({"scope": scope} if scope else {}) | {"type_": kind, "arguments": self.call_arguments()} | arguments
        return out | ({"anonymousClassBody": self.body("")} if self.text == "{" else {})

    def initializer(self) -> dict:
        self.expect("{")
        return {"type": "ArrayInitializerExpr", "values": self.separated(self.value, "}", trailing=True)}

    def postfix(self, x: dict) -> dict:
        while self.kind == "mark":
            if self.text == ".":
                self.at += 1
                if self.text == "new":
                    x = self.creation(x)
                    continue
                if self.text in ("this", "super"):
                    x = {"type": f"{self.take('word').capitalize()}Expr", "typeName": self.qualifier(x)}
                    continue
                arguments = {"typeArguments": self.arguments()} if self.accept("<") else {}
                name = self.simple()
                if self.text == "(":
                    x = {"type": "MethodCallExpr", "scope": x, "name": name, "arguments": self.call_arguments()} | arguments
                else:
                    x = {"type": "FieldAccessExpr", "scope": x, "name": name} | arguments
            elif self.accept("["):
                x = {"type": "ArrayAccessExpr", "name": x, "index": self.expression()}
                self.expect("]")
            elif self.text == "::":
                x = self.reference(x)
            else:
                return x
        return x

    def qualifier(self, x: dict) -> dict:
        if x["type"] == "NameExpr":
            return name_node([x["name"]["identifier"]])
        if x["type"] != "FieldAccessExpr":
            raise self.fail("a name before this or super")
        return {"type": "Name", "identifier": x["name"]["identifier"], "qualifier": self.qualifier(x["scope"])}

    # statements
    def block(self) -> dict:
        self.expect("{")
        out = []
        while not self.accept("}"):
            out.append(self.statement())
        return {"type": "BlockStmt", "statements": out}

    def condition(self) -> dict:
        self.expect("(")
        out = self.expression()
        self.expect(")")
        return out

    def statement(self) -> dict:
        with self.nested():
            return self.statement_here()

    def statement_here(self) -> dict:
        text = self.text if self.kind in ("word", "mark") else ""
        if text == "{":
            return self.block()
        if self.accept(";"):
            return {"type": "EmptyStmt"}
        if self.kind == "word" and self.ahead() == ":" and text not in KEYWORDS:
            label = self.simple()
            self.at += 1
            return {"type": "LabeledStmt", "label": label, "statement": self.statement()}
        if self.accept("if"):
            out: dict = {"type": "IfStmt", "condition": self.condition(), "thenStmt": self.statement()}
            return out | ({"elseStmt": self.statement()} if self.accept("else") else {})
        if self.accept("while"):
            return {"type": "WhileStmt", "condition": self.condition(), "body": self.statement()}
        if self.accept("do"):
            body = self.statement()
            self.expect("while")
            return self.ended({"type": "DoStmt", "body": body, "condition": self.condition()})
        if self.accept("for"):
            return self.loop()
        if self.accept("try"):
            return self.try_()
        if text == "switch":
            at, found = self.at, self.switch("SwitchStmt")
            if self.text != ".":
                return found
            self.at = at
        if text == "synchronized" and self.ahead() == "(":
            self.at += 1
            return {"type": "SynchronizedStmt", "expression": self.condition(), "body": self.block()}
        if self.accept("return"):
            return self.ended({"type": "ReturnStmt"} | ({} if self.text == ";" else {"expression": self.expression()}))
        if self.accept("throw"):
            return self.ended({"type": "ThrowStmt", "expression": self.expression()})
        if text in ("break", "continue"):
            self.at += 1
            return self.ended({"type": f"{text.capitalize()}Stmt"} | ({} if self.text == ";" else {"label": self.simple()}))
        if text == "yield" and self.ahead() not in ("=", ".", "++", "--", "["):
            self.at += 1
            return self.ended({"type": "YieldStmt", "expression": self.expression()})
        if self.accept("assert"):
            return self.ended({"type": "AssertStmt", "check": self.expression()} | ({"message": self.expression()} if self.accept(":") else {}))
        if (found := self.attempt(self.constructor_call)) is not None:
            return found
        if (found := self.attempt(self.local_type)) is not None:
            return found
        if (found := self.attempt(lambda: self.ended(self.variables()))) is not None:
            return {"type": "ExpressionStmt", "expression": found}
        return self.ended({"type": "ExpressionStmt", "expression": self.expression()})

    def ended(self, x: dict) -> dict:
        self.expect(";")
        return x

    def constructor_call(self) -> dict:
        scope = None
        arguments = {"typeArguments": self.arguments()} if self.accept("<") else {}
        if self.text not in ("this", "super"):
            scope = {"type": "NameExpr", "name": self.simple()}
            self.expect(".")
        word = self.accept("this", "super")
        if not word or self.text != "(":
            raise self.fail("a constructor")
        out = {"type": "ExplicitConstructorInvocationStmt", "isThis": word == "this"} | ({"expression": scope} if scope else {})
        return self.ended(out | {"arguments": self.call_arguments()} | arguments)

    def local_type(self) -> dict:
        found = self.type_declaration(self.modifiers())
        if found["type"] == "RecordDeclaration":
            return {"type": "LocalRecordDeclarationStmt", "recordDeclaration": found}
        return {"type": "LocalClassDeclarationStmt", "classDeclaration": found}

    def variables(self) -> dict:
        mods = self.modifiers()
        kind = self.kind_of()
        return {"type": "VariableDeclarationExpr"} | mods | {"variables": self.declarators(kind)}

    def declarators(self, kind: dict) -> list[dict]:
        out = []
        while True:
            name = self.simple()
            out.append({"type": "VariableDeclarator", "name": name, "type_": self.brackets(kind, "NAME")} | ({"initializer": self.value()} if self.accept("=") else {}))
            if not self.accept(","):
                return out

    def loop(self) -> dict:
        self.expect("(")

        def each() -> dict:
            variable = self.variables()
            self.expect(":")
            return variable

        if (variable := self.attempt(each)) is not None:
            out: dict = {"type": "ForEachStmt", "variable": variable, "iterable": self.expression()}
            self.expect(")")
            return out | {"body": self.statement()}
        if (first := self.attempt(lambda: self.ended(self.variables()))) is not None:
            start = [first]
        else:
            start = self.separated(self.expression, ";")
        out = {"type": "ForStmt", "initialization": start}
        if not self.accept(";"):
            out["compare"] = self.expression()
            self.expect(";")
        return out | {"update": self.separated(self.expression, ")"), "body": self.statement()}

    def try_(self) -> dict:
        out: dict = {"type": "TryStmt", "resources": []}
        if self.accept("("):
            out["resources"] = self.separated(lambda: self.attempt(self.variables) or self.expression(), ")", ";", True)
        out |= {"tryBlock": self.block(), "catchClauses": []}
        while self.accept("catch"):
            self.expect("(")
            mods = self.modifiers()
            kinds = [self.kind_of()]
            while self.accept("|"):
                kinds.append(self.kind_of())
            kind = kinds[0] if len(kinds) == 1 else {"type": "UnionType", "elements": kinds, "annotations": []}
            parameter = {"type": "Parameter"} | mods | {"type_": kind, "isVarArgs": False, "varArgsAnnotations": [], "name": self.simple()}
            self.expect(")")
            out["catchClauses"].append({"type": "CatchClause", "parameter": parameter, "body": self.block()})
        return out | ({"finallyBlock": self.block()} if self.accept("finally") else {})

    def switch(self, kind: str) -> dict:
        self.expect("switch")
        out: dict = {"type": kind, "selector": self.condition(), "entries": []}
        self.expect("{")
        while not self.accept("}"):
            out["entries"].append(self.entry())
        return out

    def entry(self) -> dict:
        out: dict = {"type": "SwitchEntry", "labels": []}
        if not self.accept("default"):
            self.expect("case")
            while True:
                out["labels"].append({"type": "NameExpr", "name": {"type": "SimpleName", "identifier": "default"}} if self.accept("default") else self.attempt(self.pattern_label) or self.ternary())
                if not self.accept(","):
                    break
            if self.accept("when"):
                out["guard"] = self.binary(0)
        if self.accept(":"):
            found = []
            while self.text not in ("case", "default", "}"):
                found.append(self.statement())
            return out | {"type_": "STATEMENT_GROUP", "statements": found}
        self.expect("->")
        form = {"{": "BLOCK", "throw": "THROWS_STATEMENT"}.get(self.text, "EXPRESSION")
        return out | {"type_": form, "statements": [self.statement()]}

    def pattern_label(self) -> dict:
        found = self.component()
        if self.text not in (":", "->", ",", "when"):
            raise self.fail("'->'")
        return found

    # declarations
    def parameter(self) -> dict:
        mods = self.modifiers()
        kind = self.kind_of()
        notes = self.annotations()
        dots = bool(self.accept("..."))
        if self.text == "this":
            self.at += 1
            return {"type": "ReceiverParameter", "annotations": mods["annotations"], "type_": kind, "name": name_node(["this"])}
        name = self.simple()
        return {"type": "Parameter"} | mods | {"type_": self.brackets(kind, "NAME"), "isVarArgs": dots, "varArgsAnnotations": notes, "name": name}

    def parameters(self) -> dict:
        self.expect("(")
        found = self.separated(self.parameter, ")")
        receiver = [p for p in found if p["type"] == "ReceiverParameter"]
        return {"parameters": [p for p in found if p["type"] != "ReceiverParameter"]} | ({"receiverParameter": receiver[0]} if receiver else {})

    def list_after(self, word: str) -> list[dict]:
        if not self.accept(word):
            return []
        out = [self.kind_of()]
        while self.accept(","):
            out.append(self.kind_of())
        return out

    def body(self, owner: str) -> list[dict]:
        self.expect("{")
        out = []
        while not self.accept("}"):
            if not self.accept(";"):
                out.append(self.member(owner))
        return out

    def member(self, owner: str) -> dict:
        with self.nested():
            if self.text == "{" or self.text == "static" and self.ahead() == "{":
                return {"type": "InitializerDeclaration", "isStatic": bool(self.accept("static")), "body": self.block()}
            mods = self.modifiers()
            if (found := self.attempt(lambda: self.type_declaration(mods))) is not None:
                return found
            generics = self.type_parameters()
            if owner and self.text == owner and self.ahead() == "(":
                return {"type": "ConstructorDeclaration"} | mods | {"typeParameters": generics, "name": self.simple()} | self.parameters() | {"thrownExceptions": self.list_after("throws"), "body": self.block()}
            if owner and self.text == owner and self.ahead() == "{":
                return {"type": "CompactConstructorDeclaration"} | mods | {"typeParameters": generics, "name": self.simple(), "thrownExceptions": [], "body": self.block()}
            kind = self.kind_of()
            if self.ahead() != "(":
                return self.ended({"type": "FieldDeclaration"} | mods | {"variables": self.declarators(kind)})
            name = self.simple()
            rest = self.parameters()
            kind = self.brackets(kind, "NAME")
            if self.accept("default"):
                return self.ended({"type": "AnnotationMemberDeclaration"} | mods | {"type_": kind, "name": name, "defaultValue": self.value()})
            out = {"type": "MethodDeclaration"} | mods | {"typeParameters": generics, "type_": kind, "name": name} | rest | {"thrownExceptions": self.list_after("throws")}
            return out if self.accept(";") else out | {"body": self.block()}

    def type_declaration(self, mods: dict) -> dict:
        if self.text == "@" and self.ahead() == "interface":
            self.at += 2
            name = self.simple()
            return {"type": "AnnotationDeclaration"} | mods | {"name": name, "members": self.body("")}
        word = self.accept("class", "interface", "enum", "record")
        if not word:
            raise self.fail("a type")
        name = self.simple()
        head = mods | {"name": name}
        if word == "enum":
            return {"type": "EnumDeclaration"} | head | {"implementedTypes": self.list_after("implements")} | self.enum_body(name["identifier"])
        generics = self.type_parameters()
        if word == "record":
            return {"type": "RecordDeclaration"} | head | {"typeParameters": generics} | self.parameters() | {"implementedTypes": self.list_after("implements"), "members": self.body(name["identifier"])}
        out = {"type": "ClassOrInterfaceDeclaration"} | head | {"isInterface": word == "interface", "typeParameters": generics, "extendedTypes": self.list_after("extends"), "implementedTypes": self.list_after("implements")}
        return out | {"permittedTypes": self.list_after("permits"), "members": self.body(name["identifier"])}

    def enum_body(self, owner: str) -> dict:
        self.expect("{")
        entries, members = [], []
        while self.text not in (";", "}"):
            notes = self.annotations()
            name = self.simple()
            arguments = self.call_arguments() if self.text == "(" else []
            entries.append({"type": "EnumConstantDeclaration", "annotations": notes, "name": name, "arguments": arguments, "classBody": self.body("") if self.text == "{" else []})
            if not self.accept(","):
                break
        if self.accept(";"):
            while not self.accept("}"):
                if not self.accept(";"):
                    members.append(self.member(owner))
        else:
            self.expect("}")
        return {"entries": entries, "members": members}

    def unit(self) -> dict:
        out: dict = {"type": "CompilationUnit"}
        at, notes = self.at, self.attempt(self.annotations) or []
        if self.accept("package"):
            out["packageDeclaration"] = self.ended({"type": "PackageDeclaration", "annotations": notes, "name": self.name()})
        else:
            self.at = at
        out |= {"imports": [], "types": []}
        while self.accept("import"):
            found: dict = {"type": "ImportDeclaration", "isStatic": bool(self.accept("static")), "isAsterisk": False, "name": self.name()}
            if self.accept("."):
                self.expect("*")
                found["isAsterisk"] = True
            out["imports"].append(self.ended(found))
        while self.kind != "end":
            if not self.accept(";"):
                out["types"].append(self.type_declaration(self.modifiers()))
        return out


def compilation_unit(c: Cursor) -> dict:
    """The tree of a file; comments are left out, literals keep their escapes and suffixes."""
    t = Reader(c)
    return t.whole(t.unit)
