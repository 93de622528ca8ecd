"""Zig trees as text, which the rule reads back to the same tree."""

from __future__ import annotations

TAB = "    "


def _list(items: list, level: int) -> str:
    return ", ".join(text(x, level) for x in items)


def _indent(block: str, level: int) -> str:
    return TAB * level + block


def _braced(x: dict) -> bool:
    """Whether a statement ends with a block of its own, after which no ; stands."""
    last = x.get("elseBody", x.get("body", x.get("operand") if x["type"] == "ComptimeExpr" else None))
    return x["type"] in ("BlockExpr", "SwitchExpr") or x["type"] in ("IfExpr", "WhileStmt", "ForStmt", "DeferStmt", "ComptimeExpr") and last is not None and _braced(last)


def _body(x: dict, level: int) -> str:
    """A statement with its end."""
    return text(x, level) + ("" if x["type"] in ("VarDecl", "FnDecl", "TestDecl", "UsingnamespaceDecl") or _braced(x) else ";")


def _members(members: list, level: int) -> str:
    return "".join(_indent(text(m, level), level) + ("," if m["type"] == "ContainerField" else "") + "\n" for m in members)


def _capture(x: dict, name: str = "capture") -> str:
    return f" |{x[name]}|" if name in x else ""


def _otherwise(x: dict, level: int) -> str:
    return f" else{_capture(x, 'elseCapture')} {text(x['elseBody'], level)}" if "elseBody" in x else ""


def _flags(x: dict) -> str:
    return "".join(f"{w} " for w in ("pub", "extern", "export", "inline", "comptime", "threadlocal") if x.get(f"is{w.capitalize()}"))


def _declared(x: dict, level: int, value: str) -> str:
    out = f": {text(x['typeExpr'], level)}" if "typeExpr" in x else ""
    out += f" align({text(x['alignExpr'], level)})" if "alignExpr" in x else ""
    return out + (f" = {text(x[value], level)}" if value in x else "")


def _label(x: dict) -> str:
    return f"{x['label']}: " if "label" in x else ""


def _pointer(x: dict, level: int) -> str:
    end = f":{text(x['sentinel'], level)}" if "sentinel" in x else ""
    return {"one": "*", "many": f"[*{end}]", "slice": f"[{end}]"}[x["size"]] + ("const " if x["isConst"] else "") + text(x["child"], level)


def _block(x: dict, level: int) -> str:
    return _label(x) + ("{\n" + "".join(_indent(_body(s, level + 1), level + 1) + "\n" for s in x["statements"]) + _indent("}", level) if x["statements"] else "{}")


def _container(x: dict, level: int) -> str:
    head = (f"{x['layout']} " if "layout" in x else "") + x.get("kind", "struct") + (f"({text(x['argument'], level)})" if "argument" in x else "")
    return head + (" {\n" + _members(x["members"], level + 1) + _indent("}", level) if x["members"] else " {}")


def _prong(x: dict, level: int) -> str:
    return ("else" if x["isElse"] else _list(x["cases"], level)) + f" =>{_capture(x)} {text(x['body'], level)}"


def _values(x: dict, level: int) -> str:
    head = text(x["operand"], level) if "operand" in x else "."
    inner = _list(x.get("fields", x.get("elements")), level)
    return f"{head}{{ {inner} }}" if inner else f"{head}{{}}"


def _loop(x: dict, level: int) -> str:
    head = _label(x) + ("inline " if x["isInline"] else "")
    if x["type"] == "WhileStmt":
        head += f"while ({text(x['condition'], level)}){_capture(x)}" + (f" : ({text(x['continuation'], level)})" if "continuation" in x else "")
    else:
        head += f"for ({_list(x['inputs'], level)})" + (f" |{', '.join(x['captures'])}|" if x["captures"] else "")
    return f"{head} {text(x['body'], level)}{_otherwise(x, level)}"


WRITERS = {
    "Identifier": lambda x, n: x["name"],
    "IntegerLiteral": lambda x, n: x["value"],
    "FloatLiteral": lambda x, n: x["value"],
    "StringLiteral": lambda x, n: f'"{x["value"]}"',
    "MultilineStringLiteral": lambda x, n: "\n" + "\n".join(f"{TAB * (n + 1)}\\\\{line}" for line in x["value"].split("\n")) + "\n" + TAB * n,
    "CharLiteral": lambda x, n: f"'{x['value']}'",
    "EnumLiteral": lambda x, n: f".{x['name']}",
    "BoolLiteral": lambda x, n: str(x["value"]).lower(),
    "NullLiteral": lambda x, n: "null",
    "UndefinedLiteral": lambda x, n: "undefined",
    "PointerType": _pointer,
    "ArrayType": lambda x, n: f"[{text(x['length'], n)}" + (f":{text(x['sentinel'], n)}" if "sentinel" in x else "") + f"]{text(x['child'], n)}",
    "OptionalType": lambda x, n: f"?{text(x['child'], n)}",
    "ErrorUnionType": lambda x, n: f"{text(x['error'], n)}!{text(x['payload'], n)}",
    "FnProtoType": lambda x, n: f"fn ({_list(x['params'], n)}) {text(x['returnType'], n)}",
    "BinaryExpr": lambda x, n: text(x["left"], n) + (f"{x['operator']}" if x["operator"].startswith("..") else f" {x['operator']}{_capture(x)} ") + (text(x["right"], n) if "right" in x else ""),
    "UnaryExpr": lambda x, n: x["operator"] + text(x["operand"], n),
    "FieldAccessExpr": lambda x, n: f"{text(x['operand'], n)}.{x['member']}",
    "IndexExpr": lambda x, n: f"{text(x['operand'], n)}[{text(x['index'], n)}]",
    "SliceExpr": lambda x, n: f"{text(x['operand'], n)}[{text(x['start'], n)}.." + (text(x["end"], n) if "end" in x else "") + (f" :{text(x['sentinel'], n)}" if "sentinel" in x else "") + "]",
    "CallExpr": lambda x, n: f"{text(x['callee'], n)}({_list(x['args'], n)})",
    "BuiltinCallExpr": lambda x, n: f"@{x['name']}({_list(x['args'], n)})",
    "IfExpr": lambda x, n: f"if ({text(x['condition'], n)}){_capture(x)} {text(x['body'], n)}{_otherwise(x, n)}",
    "SwitchExpr": lambda x, n: f"{_label(x)}switch ({text(x['operand'], n)}) {{\n" + "".join(_indent(_prong(p, n + 1), n + 1) + ",\n" for p in x["prongs"]) + _indent("}", n),
    "StructInitField": lambda x, n: f".{x['name']} = {text(x['value'], n)}",
    "StructInitExpr": _values,
    "ArrayInitExpr": _values,
    "TryExpr": lambda x, n: f"try {text(x['operand'], n)}",
    "ComptimeExpr": lambda x, n: f"comptime {text(x['operand'], n)}",
    "BlockExpr": _block,
    "GroupedExpr": lambda x, n: f"({text(x['inner'], n)})",
    "ErrorSetExpr": lambda x, n: "error{" + ", ".join(x["names"]) + "}",
    "StructExpr": _container,
    "AssignStmt": lambda x, n: f"{text(x['target'], n)} {x['operator']} {text(x['value'], n)}",
    "WhileStmt": _loop,
    "ForStmt": _loop,
    "ReturnStmt": lambda x, n: "return" + (f" {text(x['value'], n)}" if "value" in x else ""),
    "BreakStmt": lambda x, n: "break" + (f" :{x['label']}" if "label" in x else "") + (f" {text(x['value'], n)}" if "value" in x else ""),
    "ContinueStmt": lambda x, n: "continue" + (f" :{x['label']}" if "label" in x else ""),
    "DeferStmt": lambda x, n: ("errdefer" if x["isErrdefer"] else "defer") + _capture(x) + f" {text(x['body'], n)}",
    "FnParam": lambda x, n: ("comptime " if x["isComptime"] else "") + ("noalias " if x["isNoalias"] else "") + x.get("name", "") + (": " if "name" in x and "typeExpr" in x else "") + (text(x["typeExpr"], n) if "typeExpr" in x else ""),
    "FnDecl": lambda x, n: f"{_flags(x)}fn {x['name']}({_list(x['params'], n)}) {text(x['returnType'], n)}" + (f" {text(x['body'], n)}" if "body" in x else ";"),
    "VarDecl": lambda x, n: f"{_flags(x)}{'const' if x['isConst'] else 'var'} {x['name']}{_declared(x, n, 'initExpr')};",
    "TestDecl": lambda x, n: "test " + (f'"{x["name"]}" ' if "name" in x else "") + text(x["body"], n),
    "UsingnamespaceDecl": lambda x, n: f"{_flags(x)}usingnamespace {text(x['expression'], n)};",
    "ContainerField": lambda x, n: x["name"] + _declared(x, n, "defaultValue"),
    "Root": lambda x, n: _members(x["members"], n),
}


def text(x: dict, level: int = 0) -> str:
    return WRITERS[x["type"]](x, level)
