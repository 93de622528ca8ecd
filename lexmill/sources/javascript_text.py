"""JavaScript trees as text, which the rule reads back to the same tree; parentheses where what binds less stands inside."""

from __future__ import annotations

from .javascript import BINDING

TAB = "  "
#: How strongly expressions bind, from sequences to primaries; binary operators lie between BINARY and UNARY.
SEQUENCE, ASSIGNMENT, CONDITIONAL, BINARY, UNARY, POSTFIX, CALL, PRIMARY = 0, 1, 2, 3, 20, 21, 22, 23
STRENGTH = {"SequenceExpression": SEQUENCE, "AssignmentExpression": ASSIGNMENT, "ArrowFunctionExpression": ASSIGNMENT, "YieldExpression": ASSIGNMENT, "ConditionalExpression": CONDITIONAL, "UnaryExpression": UNARY, "AwaitExpression": UNARY, "MemberExpression": CALL, "CallExpression": CALL, "NewExpression": CALL, "TaggedTemplateExpression": CALL, "ImportExpression": CALL, "ChainExpression": POSTFIX}


def strength(x: dict) -> int:
    if x["type"] in ("BinaryExpression", "LogicalExpression"):
        return BINARY + BINDING[x["operator"]]
    if x["type"] == "UpdateExpression":
        return UNARY if x["prefix"] else POSTFIX
    return STRENGTH.get(x["type"], PRIMARY)


def text(x: dict, n: int = 0) -> str:
    return WRITERS[x["type"]](x, n)


def at_least(x: dict, least: int, n: int) -> str:
    return text(x, n) if strength(x) >= least else f"({text(x, n)})"


def _list(items: list, n: int) -> str:
    return ", ".join("" if x is None else at_least(x, ASSIGNMENT, n) for x in items)


def _array(x: dict, n: int) -> str:
    return f"[{_list(x['elements'], n)}{',' if x['elements'] and x['elements'][-1] is None else ''}]"


def _braces(items: list, n: int) -> str:
    return "{\n" + "".join(f"{TAB * (n + 1)}{text(s, n + 1)}\n" for s in items) + TAB * n + "}" if items else "{}"


def _leftmost(x: dict) -> dict:
    """The expression that an expression's text begins with."""
    while True:
        inner = None
        for name in ("left", "object", "callee", "tag", "test"):
            if x["type"] != "NewExpression" and isinstance(x.get(name), dict):
                inner = x[name]
                break
        if x["type"] == "SequenceExpression":
            inner = x["expressions"][0]
        elif x["type"] == "ChainExpression":
            inner = x["expression"]
        elif x["type"] == "UpdateExpression" and not x["prefix"]:
            inner = x["argument"]
        if inner is None:
            return x
        x = inner


def _statement(x: dict, n: int) -> str:
    e = x["expression"]
    hidden = _leftmost(e)["type"] in ("ObjectExpression", "FunctionExpression", "ClassExpression", "ObjectPattern")
    quoted = "directive" not in x and e["type"] == "Literal" and e["raw"][0] in "'\""
    return (f"({text(e, n)})" if hidden or quoted else text(e, n)) + ";"


def _binary(x: dict, n: int) -> str:
    here, right_first = strength(x), x["operator"] == "**"
    left = at_least(x["left"], UNARY + 1 if right_first else here, n)
    right = at_least(x["right"], here if right_first else here + 1, n)
    mixed = {"??": ("||", "&&"), "||": ("??",), "&&": ("??",)}.get(x["operator"], ())
    if x["left"].get("operator") in mixed and not left.startswith("("):
        left = f"({left})"
    if x["right"].get("operator") in mixed and not right.startswith("("):
        right = f"({right})"
    return f"{left} {x['operator']} {right}"


def _arrow(x: dict, n: int) -> str:
    body = text(x["body"], n) if not x["expression"] else at_least(x["body"], ASSIGNMENT, n)
    hidden = x["expression"] and _leftmost(x["body"])["type"] in ("ObjectExpression", "ObjectPattern") and not body.startswith("(")
    return f"{'async ' if x['async'] else ''}({_list(x['params'], n)}) => " + (f"({body})" if hidden else body)


def _function(x: dict, n: int) -> str:
    return f"{'async ' if x['async'] else ''}function{'*' if x['generator'] else ''} {text(x['id'], n) if x['id'] else ''}({_list(x['params'], n)}) {text(x['body'], n)}"


def _key(x: dict, n: int) -> str:
    return f"[{at_least(x['key'], ASSIGNMENT, n)}]" if x["computed"] else text(x["key"], n)


def _method(x: dict, n: int) -> str:
    f, kind = x["value"], f"{x['kind']} " if x["kind"] in ("get", "set") else ""
    return f"{'async ' if f['async'] else ''}{'*' if f['generator'] else ''}{kind}{_key(x, n)}({_list(f['params'], n)}) {text(f['body'], n)}"


def _property(x: dict, n: int) -> str:
    if x["method"] or x["kind"] in ("get", "set"):
        return _method(x, n)
    return text(x["value"], n) if x["shorthand"] else f"{_key(x, n)}: {at_least(x['value'], ASSIGNMENT, n)}"


def _class(x: dict, n: int) -> str:
    return "class " + (text(x["id"], n) + " " if x["id"] else "") + (f"extends {at_least(x['superClass'], CALL, n)} " if x["superClass"] else "") + _braces(x["body"]["body"], n)


def _object(x: dict, n: int) -> str:
    """What a member or a call is of: chains and numbers need parentheses."""
    out = at_least(x, CALL, n)
    return f"({out})" if x["type"] == "Literal" and out[0].isdigit() else out


def _member(x: dict, n: int) -> str:
    mark = "?." if x["optional"] else "" if x["computed"] else "."
    return _object(x["object"], n) + mark + (f"[{text(x['property'], n)}]" if x["computed"] else text(x["property"], n))


def _has_call(x: dict) -> bool:
    while x["type"] in ("MemberExpression", "TaggedTemplateExpression"):
        x = x.get("object") or x["tag"]
    return x["type"] in ("CallExpression", "ImportExpression")


def _new(x: dict, n: int) -> str:
    callee = at_least(x["callee"], CALL, n)
    return f"new {f'({callee})' if _has_call(x['callee']) else callee}({_list(x['arguments'], n)})"


def _unary(x: dict, n: int) -> str:
    inner = at_least(x["argument"], UNARY, n)
    gap = " " if x["operator"].isalpha() or inner[0] == x["operator"][-1] else ""
    return x["operator"] + gap + inner


def _template(x: dict, n: int) -> str:
    parts = [q["value"]["raw"] for q in x["quasis"]]
    return "`" + parts[0] + "".join("${" + text(e, n) + "}" + q for e, q in zip(x["expressions"], parts[1:], strict=True)) + "`"


def _declared(x: dict, n: int) -> str:
    return f"{x['kind']} " + ", ".join(text(d["id"], n) + (f" = {at_least(d['init'], ASSIGNMENT, n)}" if d["init"] else "") for d in x["declarations"])


def _for(x: dict, n: int) -> str:
    first = x["init"]
    start = "" if first is None else _declared(first, n) if first["type"] == "VariableDeclaration" else text(first, n)
    return f"for ({start}; {text(x['test'], n) if x['test'] else ''}; {text(x['update'], n) if x['update'] else ''}) {text(x['body'], n)}"


def _each(x: dict, n: int) -> str:
    left = _declared(x["left"], n) if x["left"]["type"] == "VariableDeclaration" else text(x["left"], n)
    of = x["type"] == "ForOfStatement"
    return f"for {'await ' if x.get('await') else ''}({left} {'of' if of else 'in'} {at_least(x['right'], ASSIGNMENT if of else SEQUENCE, n)}) {text(x['body'], n)}"


def _try(x: dict, n: int) -> str:
    out = f"try {text(x['block'], n)}"
    if h := x["handler"]:
        out += " catch " + (f"({text(h['param'], n)}) " if h["param"] else "") + text(h["body"], n)
    return out + (f" finally {text(x['finalizer'], n)}" if x["finalizer"] else "")


def _open_if(x: dict) -> bool:
    """Whether a statement ends with an if that an else after it would join."""
    while True:
        if x["type"] == "IfStatement":
            if not x["alternate"]:
                return True
            x = x["alternate"]
        elif x["type"] in ("ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "LabeledStatement", "WithStatement"):
            x = x["body"]
        else:
            return False


def _if(x: dict, n: int) -> str:
    first = text(x["consequent"], n)
    if x["alternate"] and _open_if(x["consequent"]):
        raise ValueError("an if without braces can't stand before else")
    return f"if ({text(x['test'], n)}) {first}" + (f" else {text(x['alternate'], n)}" if x["alternate"] else "")


def _jump(x: dict, n: int) -> str:
    word, what = x["type"].removesuffix("Statement").lower(), x.get("argument") or x.get("label")
    return f"{word}{f' {text(what, n)}' if what else ''};"


def _cases(x: dict, n: int) -> str:
    return f"switch ({text(x['discriminant'], n)}) {_braces(x['cases'], n)}"


def _case(x: dict, n: int) -> str:
    return (f"case {text(x['test'], n)}:" if x["test"] else "default:") + "".join(f"\n{TAB * (n + 1)}{text(s, n + 1)}" for s in x["consequent"])


WRITERS = {
    "Program": lambda x, n: "".join(text(s, n) + "\n" for s in x["body"]),
    "ExpressionStatement": _statement,
    "BlockStatement": lambda x, n: _braces(x["body"], n),
    "StaticBlock": lambda x, n: "static " + _braces(x["body"], n),
    "EmptyStatement": lambda x, n: ";",
    "DebuggerStatement": lambda x, n: "debugger;",
    "VariableDeclaration": lambda x, n: _declared(x, n) + ";",
    "FunctionDeclaration": _function,
    "FunctionExpression": _function,
    "ClassDeclaration": _class,
    "ClassExpression": _class,
    "MethodDefinition": lambda x, n: ("static " if x["static"] else "") + _method(x, n),
    "PropertyDefinition": lambda x, n: ("static " if x["static"] else "") + _key(x, n) + (f" = {at_least(x['value'], ASSIGNMENT, n)}" if x["value"] else "") + ";",
    "IfStatement": _if,
    "WhileStatement": lambda x, n: f"while ({text(x['test'], n)}) {text(x['body'], n)}",
    "DoWhileStatement": lambda x, n: f"do {text(x['body'], n)} while ({text(x['test'], n)});",
    "WithStatement": lambda x, n: f"with ({text(x['object'], n)}) {text(x['body'], n)}",
    "ForStatement": _for,
    "ForInStatement": _each,
    "ForOfStatement": _each,
    "SwitchStatement": _cases,
    "SwitchCase": _case,
    "TryStatement": _try,
    "ReturnStatement": _jump,
    "ThrowStatement": _jump,
    "BreakStatement": _jump,
    "ContinueStatement": _jump,
    "LabeledStatement": lambda x, n: f"{text(x['label'], n)}: {text(x['body'], n)}",
    "Identifier": lambda x, n: x["name"],
    "PrivateIdentifier": lambda x, n: f"#{x['name']}",
    "Literal": lambda x, n: x["raw"],
    "ThisExpression": lambda x, n: "this",
    "Super": lambda x, n: "super",
    "TemplateLiteral": _template,
    "TaggedTemplateExpression": lambda x, n: at_least(x["tag"], CALL, n) + text(x["quasi"], n),
    "ArrayExpression": _array,
    "ArrayPattern": _array,
    "ObjectExpression": lambda x, n: f"{{{_list(x['properties'], n)}}}",
    "ObjectPattern": lambda x, n: f"{{{_list(x['properties'], n)}}}",
    "Property": _property,
    "SpreadElement": lambda x, n: f"...{at_least(x['argument'], ASSIGNMENT, n)}",
    "RestElement": lambda x, n: f"...{text(x['argument'], n)}",
    "AssignmentPattern": lambda x, n: f"{text(x['left'], n)} = {at_least(x['right'], ASSIGNMENT, n)}",
    "SequenceExpression": lambda x, n: _list(x["expressions"], n),
    "AssignmentExpression": lambda x, n: f"{text(x['left'], n)} {x['operator']} {at_least(x['right'], ASSIGNMENT, n)}",
    "ArrowFunctionExpression": _arrow,
    "YieldExpression": lambda x, n: "yield" + ("*" if x["delegate"] else "") + (f" {at_least(x['argument'], ASSIGNMENT, n)}" if x["argument"] else ""),
    "ConditionalExpression": lambda x, n: f"{at_least(x['test'], BINARY, n)} ? {at_least(x['consequent'], ASSIGNMENT, n)} : {at_least(x['alternate'], ASSIGNMENT, n)}",
    "BinaryExpression": _binary,
    "LogicalExpression": _binary,
    "UnaryExpression": _unary,
    "AwaitExpression": lambda x, n: f"await {at_least(x['argument'], UNARY, n)}",
    "UpdateExpression": lambda x, n: x["operator"] + at_least(x["argument"], CALL, n) if x["prefix"] else at_least(x["argument"], CALL, n) + x["operator"],
    "MemberExpression": _member,
    "CallExpression": lambda x, n: _object(x["callee"], n) + ("?." if x["optional"] else "") + f"({_list(x['arguments'], n)})",
    "NewExpression": _new,
    "ImportExpression": lambda x, n: f"import({at_least(x['source'], ASSIGNMENT, n)})",
    "MetaProperty": lambda x, n: f"{text(x['meta'], n)}.{text(x['property'], n)}",
    "ChainExpression": lambda x, n: text(x["expression"], n),
}
