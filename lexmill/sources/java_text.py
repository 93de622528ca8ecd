"""Java trees as text, which the rule reads back to the same tree."""

from __future__ import annotations

TAB = "    "


def text(x: dict, level: int = 0) -> str:
    return WRITERS[x["type"]](x, level)


def _list(items: list, n: int, mark: str = ", ") -> str:
    return mark.join(text(x, n) for x in items)


def _lines(items: list, n: int) -> str:
    """Items on lines of their own, one level further in."""
    return "".join(f"{TAB * (n + 1)}{text(x, n + 1)}\n" for x in items)


def _braces(items: list, n: int) -> str:
    return "{\n" + _lines(items, n) + TAB * n + "}" if items else "{}"


def _mods(x: dict, n: int, own_line: bool = False) -> str:
    notes = x.get("annotations", [])
    return "".join(text(a, n) + (f"\n{TAB * n}" if own_line else " ") for a in notes) + "".join(m["keyword"].lower().replace("_", "-") + " " for m in x.get("modifiers", []))


def _notes(x: dict, n: int) -> str:
    return "".join(text(a, n) + " " for a in x.get("annotations", []))


def _generics(items: list, n: int) -> str:
    return f"<{_list(items, n)}>" if items else ""


def _arguments(x: dict, n: int) -> str:
    return f"<{_list(x['typeArguments'], n)}>" if "typeArguments" in x else ""


def _clause(word: str, items: list, n: int) -> str:
    return f" {word} {_list(items, n)}" if items else ""


def _parameters(x: dict, n: int) -> str:
    return f"({_list([*([x['receiverParameter']] if 'receiverParameter' in x else []), *x['parameters']], n)})"


def _parameter(x: dict, n: int) -> str:
    kind = "" if x["type_"]["type"] == "UnknownType" else text(x["type_"], n)
    dots = (" " + _list(x["varArgsAnnotations"], n, " ") + " " if x["varArgsAnnotations"] else "") + "..." if x["isVarArgs"] else ""
    return _mods(x, n) + (f"{kind}{dots} " if kind else "") + text(x["name"], n)


def _element(kind: dict) -> tuple[dict, int]:
    """A type without the brackets that stand after the variable's name, and their number."""
    depth = 0
    while kind["type"] == "ArrayType" and kind["origin"] == "NAME":
        kind, depth = kind["componentType"], depth + 1
    return kind, depth


def _variables(x: dict, n: int, own_line: bool = False) -> str:
    parts = []
    for v in x["variables"]:
        value = f" = {text(v['initializer'], n)}" if "initializer" in v else ""
        parts.append(text(v["name"], n) + "[]" * _element(v["type_"])[1] + value)
    return f"{_mods(x, n, own_line)}{text(_element(x['variables'][0]['type_'])[0], n)} {', '.join(parts)}"


def _lambda(x: dict, n: int) -> str:
    body = x["body"]
    head = f"({_list(x['parameters'], n)})" if x["isEnclosingParameters"] else _list(x["parameters"], n)
    return f"{head} -> {text(body['expression'] if body['type'] == 'ExpressionStmt' else body, n)}"


def _creation(x: dict, n: int) -> str:
    out = (text(x["scope"], n) + "." if "scope" in x else "") + f"new {_arguments(x, n)}{text(x['type_'], n)}({_list(x['arguments'], n)})"
    return out + (" " + _braces(x["anonymousClassBody"], n) if "anonymousClassBody" in x else "")


def _scoped(x: dict, n: int) -> str:
    return text(x["scope"], n) + "." if "scope" in x else ""


def _instance(x: dict, n: int) -> str:
    return f"{text(x['expression'], n)} instanceof {text(x['pattern'] if 'pattern' in x else x['type_'], n)}"


def _switch(x: dict, n: int) -> str:
    return f"switch ({text(x['selector'], n)}) {_braces(x['entries'], n)}"


def _entry(x: dict, n: int) -> str:
    head = (f"case {_list(x['labels'], n)}" if x["labels"] else "default") + (f" when {text(x['guard'], n)}" if "guard" in x else "")
    if x["type_"] == "STATEMENT_GROUP":
        return f"{head}:" + ("\n" + _lines(x["statements"], n)).rstrip("\n")
    return f"{head} -> {_list(x['statements'], n)}"


def _for(x: dict, n: int) -> str:
    return f"for ({_list(x['initialization'], n)}; {text(x['compare'], n) if 'compare' in x else ''}; {_list(x['update'], n)}) {text(x['body'], n)}"


def _if(x: dict, n: int) -> str:
    return f"if ({text(x['condition'], n)}) {text(x['thenStmt'], n)}" + (f" else {text(x['elseStmt'], n)}" if "elseStmt" in x else "")


def _try(x: dict, n: int) -> str:
    head = "try " + (f"({_list(x['resources'], n, '; ')}) " if x["resources"] else "") + text(x["tryBlock"], n)
    head += "".join(f" catch ({text(c['parameter'], n)}) {text(c['body'], n)}" for c in x["catchClauses"])
    return head + (f" finally {text(x['finallyBlock'], n)}" if "finallyBlock" in x else "")


def _constructor_call(x: dict, n: int) -> str:
    return (text(x["expression"], n) + "." if "expression" in x else "") + f"{_arguments(x, n)}{'this' if x['isThis'] else 'super'}({_list(x['arguments'], n)});"


def _method(x: dict, n: int) -> str:
    generics = _generics(x["typeParameters"], n)
    return _mods(x, n, True) + (generics + " " if generics else "") + f"{text(x['type_'], n)} {text(x['name'], n)}{_parameters(x, n)}{_clause('throws', x['thrownExceptions'], n)}" + (f" {text(x['body'], n)}" if "body" in x else ";")


def _constructor(x: dict, n: int) -> str:
    generics = _generics(x["typeParameters"], n)
    return _mods(x, n, True) + (generics + " " if generics else "") + text(x["name"], n) + (_parameters(x, n) if "parameters" in x else "") + f"{_clause('throws', x['thrownExceptions'], n)} {text(x['body'], n)}"


def _class(x: dict, n: int) -> str:
    return f"{_mods(x, n, True)}{'interface' if x['isInterface'] else 'class'} {text(x['name'], n)}{_generics(x['typeParameters'], n)}{_clause('extends', x['extendedTypes'], n)}{_clause('implements', x['implementedTypes'], n)}{_clause('permits', x['permittedTypes'], n)} {_braces(x['members'], n)}"


def _enum(x: dict, n: int) -> str:
    inner = TAB * (n + 1) + f",\n{TAB * (n + 1)}".join(text(e, n + 1) for e in x["entries"]) if x["entries"] else TAB * (n + 1)
    return f"{_mods(x, n, True)}enum {text(x['name'], n)}{_clause('implements', x['implementedTypes'], n)} {{\n{inner};\n{_lines(x['members'], n)}{TAB * n}}}"


def _unit(x: dict, n: int) -> str:
    parts = [text(x["packageDeclaration"], n) + "\n"] if "packageDeclaration" in x else []
    if x["imports"]:
        parts.append("".join(text(i, n) + "\n" for i in x["imports"]))
    return "\n".join(parts + [text(t, n) + "\n" for t in x["types"]])


WRITERS = {
    "Name": lambda x, n: (text(x["qualifier"], n) + "." if "qualifier" in x else "") + x["identifier"],
    "SimpleName": lambda x, n: x["identifier"],
    "MarkerAnnotationExpr": lambda x, n: f"@{text(x['name'], n)}",
    "SingleMemberAnnotationExpr": lambda x, n: f"@{text(x['name'], n)}({text(x['memberValue'], n)})",
    "NormalAnnotationExpr": lambda x, n: f"@{text(x['name'], n)}({_list(x['pairs'], n)})",
    "MemberValuePair": lambda x, n: f"{text(x['name'], n)} = {text(x['value'], n)}",
    "PackageDeclaration": lambda x, n: f"{_notes(x, n)}package {text(x['name'], n)};",
    "ImportDeclaration": lambda x, n: f"import {'static ' if x['isStatic'] else ''}{text(x['name'], n)}{'.*' if x['isAsterisk'] else ''};",
    "TypeParameter": lambda x, n: _notes(x, n) + text(x["name"], n) + (" extends " + _list(x["typeBound"], n, " & ") if x["typeBound"] else ""),
    "ClassOrInterfaceType": lambda x, n: _scoped(x, n) + _notes(x, n) + text(x["name"], n) + _arguments(x, n),
    "PrimitiveType": lambda x, n: _notes(x, n) + x["type_"].lower(),
    "ArrayType": lambda x, n: text(x["componentType"], n) + "[]",
    "VoidType": lambda x, n: _notes(x, n) + "void",
    "VarType": lambda x, n: _notes(x, n) + "var",
    "WildcardType": lambda x, n: _notes(x, n) + "?" + (f" extends {text(x['extendedType'], n)}" if "extendedType" in x else "") + (f" super {text(x['superType'], n)}" if "superType" in x else ""),
    "UnionType": lambda x, n: _list(x["elements"], n, " | "),
    "IntersectionType": lambda x, n: _list(x["elements"], n, " & "),
    "NameExpr": lambda x, n: text(x["name"], n),
    "IntegerLiteralExpr": lambda x, n: x["value"],
    "LongLiteralExpr": lambda x, n: x["value"],
    "DoubleLiteralExpr": lambda x, n: x["value"],
    "CharLiteralExpr": lambda x, n: f"'{x['value']}'",
    "StringLiteralExpr": lambda x, n: f'"{x["value"]}"',
    "TextBlockLiteralExpr": lambda x, n: f'"""{x["value"]}"""',
    "BooleanLiteralExpr": lambda x, n: str(x["value"]).lower(),
    "NullLiteralExpr": lambda x, n: "null",
    "ThisExpr": lambda x, n: (text(x["typeName"], n) + "." if "typeName" in x else "") + "this",
    "SuperExpr": lambda x, n: (text(x["typeName"], n) + "." if "typeName" in x else "") + "super",
    "FieldAccessExpr": lambda x, n: f"{_scoped(x, n)}{_arguments(x, n)}{text(x['name'], n)}",
    "ArrayAccessExpr": lambda x, n: f"{text(x['name'], n)}[{text(x['index'], n)}]",
    "MethodCallExpr": lambda x, n: f"{_scoped(x, n)}{_arguments(x, n)}{text(x['name'], n)}({_list(x['arguments'], n)})",
    "ObjectCreationExpr": _creation,
    "ArrayCreationExpr": lambda x, n: f"new {text(x['elementType'], n)}{_list(x['levels'], n, '')}" + (f" {text(x['initializer'], n)}" if "initializer" in x else ""),
    "ArrayCreationLevel": lambda x, n: f"[{text(x['dimension'], n) if 'dimension' in x else ''}]",
    "ArrayInitializerExpr": lambda x, n: f"{{{_list(x['values'], n)}}}",
    "BinaryExpr": lambda x, n: f"{text(x['left'], n)} {x['operator']} {text(x['right'], n)}",
    "UnaryExpr": lambda x, n: f"{x['operator']}{' ' if x['operator'] in '+-' else ''}{text(x['expression'], n)}" if x["prefix"] else f"{text(x['expression'], n)}{x['operator']}",
    "AssignExpr": lambda x, n: f"{text(x['target'], n)} {x['operator']} {text(x['value'], n)}",
    "ConditionalExpr": lambda x, n: f"{text(x['condition'], n)} ? {text(x['thenExpr'], n)} : {text(x['elseExpr'], n)}",
    "EnclosedExpr": lambda x, n: f"({text(x['inner'], n)})",
    "CastExpr": lambda x, n: f"({text(x['type_'], n)}) {text(x['expression'], n)}",
    "InstanceOfExpr": _instance,
    "TypePatternExpr": lambda x, n: f"{_mods(x, n)}{text(x['type_'], n)} {text(x['name'], n)}",
    "RecordPatternExpr": lambda x, n: f"{text(x['type_'], n)}({_list(x['patternList'], n)})",
    "ClassExpr": lambda x, n: f"{text(x['type_'], n)}.class",
    "LambdaExpr": _lambda,
    "MethodReferenceExpr": lambda x, n: f"{text(x['scope'], n)}::{_arguments(x, n)}{x['identifier']}",
    "SwitchExpr": _switch,
    "BlockStmt": lambda x, n: _braces(x["statements"], n),
    "ExpressionStmt": lambda x, n: text(x["expression"], n) + ";",
    "ReturnStmt": lambda x, n: "return" + (f" {text(x['expression'], n)}" if "expression" in x else "") + ";",
    "IfStmt": _if,
    "ForStmt": _for,
    "ForEachStmt": lambda x, n: f"for ({text(x['variable'], n)} : {text(x['iterable'], n)}) {text(x['body'], n)}",
    "WhileStmt": lambda x, n: f"while ({text(x['condition'], n)}) {text(x['body'], n)}",
    "DoStmt": lambda x, n: f"do {text(x['body'], n)} while ({text(x['condition'], n)});",
    "SwitchStmt": _switch,
    "SwitchEntry": _entry,
    "BreakStmt": lambda x, n: "break" + (f" {text(x['label'], n)}" if "label" in x else "") + ";",
    "ContinueStmt": lambda x, n: "continue" + (f" {text(x['label'], n)}" if "label" in x else "") + ";",
    "YieldStmt": lambda x, n: f"yield {text(x['expression'], n)};",
    "ThrowStmt": lambda x, n: f"throw {text(x['expression'], n)};",
    "TryStmt": _try,
    "SynchronizedStmt": lambda x, n: f"synchronized ({text(x['expression'], n)}) {text(x['body'], n)}",
    "LabeledStmt": lambda x, n: f"{text(x['label'], n)}: {text(x['statement'], n)}",
    "AssertStmt": lambda x, n: f"assert {text(x['check'], n)}" + (f" : {text(x['message'], n)}" if "message" in x else "") + ";",
    "LocalClassDeclarationStmt": lambda x, n: text(x["classDeclaration"], n),
    "LocalRecordDeclarationStmt": lambda x, n: text(x["recordDeclaration"], n),
    "EmptyStmt": lambda x, n: ";",
    "ExplicitConstructorInvocationStmt": _constructor_call,
    "VariableDeclarationExpr": _variables,
    "Parameter": _parameter,
    "ReceiverParameter": lambda x, n: f"{_notes(x, n)}{text(x['type_'], n)} {text(x['name'], n)}",
    "FieldDeclaration": lambda x, n: _variables(x, n, True) + ";",
    "MethodDeclaration": _method,
    "ConstructorDeclaration": _constructor,
    "CompactConstructorDeclaration": _constructor,
    "InitializerDeclaration": lambda x, n: f"{'static ' if x['isStatic'] else ''}{text(x['body'], n)}",
    "EnumConstantDeclaration": lambda x, n: _notes(x, n) + text(x["name"], n) + (f"({_list(x['arguments'], n)})" if x["arguments"] else "") + (f" {_braces(x['classBody'], n)}" if x["classBody"] else ""),
    "AnnotationMemberDeclaration": lambda x, n: f"{_mods(x, n)}{text(x['type_'], n)} {text(x['name'], n)}() default {text(x['defaultValue'], n)};",
    "ClassOrInterfaceDeclaration": _class,
    "EnumDeclaration": _enum,
    "RecordDeclaration": lambda x, n: f"{_mods(x, n, True)}record {text(x['name'], n)}{_generics(x['typeParameters'], n)}{_parameters(x, n)}{_clause('implements', x['implementedTypes'], n)} {_braces(x['members'], n)}",
    "AnnotationDeclaration": lambda x, n: f"{_mods(x, n, True)}@interface {text(x['name'], n)} {_braces(x['members'], n)}",
    "CompilationUnit": _unit,
}
