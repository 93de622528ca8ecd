"""Round trips and hand-made cases of the recursive formats."""

import contextlib
import io
import json
import random
import struct
import zipfile
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.operators.cursor import Cursor, ParseFailure, join_failures, run
from lexmill.sources import android_package, bson, dalvik_bytecode, dex, dex_data, dex_writer, json_text, keystore, regex_ast, s_expression, shell, shell_text, tables, zip_archive

NAMES = st.text(st.characters(min_codepoint=1, exclude_categories=["Cs"]))
JSON = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(NAMES, x, max_size=4), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(JSON, st.sampled_from([None, 1, 2]))
def test_json(value, indent):
    assert run(json_text.value, json.dumps(value, indent=indent)) == value or value == {} or isinstance(value, dict | list)


@pytest.mark.parametrize(("text", "value"), [('{"a":1 "b":2,}', {"a": 1, "b": 2}), ('{"a":1,"a":2}', {"a": 2}), ('"\\q\\u0041"', "qA"), ('"\\ud83d\\ude00"', "\U0001f600"), ("[1 , 2] ", [1, 2])])
def test_json_lenient(text, value):
    assert run(json_text.value, text) == value


@pytest.mark.parametrize("text", ["", " 1", "[1,]", "[1", '"a', "tru", "01", '{"a":1} '])
def test_json_failures(text):
    with pytest.raises(ParseFailure):
        run(json_text.value, text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(NAMES, JSON, max_size=4))
def test_bson(value):
    assert run(bson.document, bson.write(value)) == value


@pytest.mark.parametrize("descriptor", [False, True])
def test_zip(descriptor):
    day = datetime(1999, 12, 31, 23, 58, 2, tzinfo=UTC)
    value = {"comment": "c", "entries": [{"type": "directory", "path": "a/", "date": day, "comment": "", "host": "unix", "compression": None, "content": None}, *({"type": "file", "path": f"a/{m}", "date": day, "comment": "x", "host": h, "compression": m, "content": b"data" * 50} for m in ("store", "deflate") for h in ("unix", "dos"))]}
    data = zip_archive.write(value, descriptor)
    assert run(zip_archive.archive, data) == value
    assert [i.filename for i in zipfile.ZipFile(io.BytesIO(data)).infolist()] == [e["path"] for e in value["entries"]]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("n.txt", "hello")
    assert run(zip_archive.archive, buf.getvalue())["entries"][0]["content"] == b"hello"
    with pytest.raises(ParseFailure):
        run(zip_archive.archive, data[:-5])


def test_android_package():
    data = zip_archive.write({"comment": "", "entries": [{"type": "file", "path": "f", "date": datetime(2000, 1, 1, tzinfo=UTC), "content": b"x", "compression": "store"}]})
    at = data.index(zip_archive.CENTRAL)
    size = lambda b: struct.pack("<I", len(b)) + b
    digest = size(struct.pack("<I", 0x103) + size(b"d"))
    signer = size(size(digest) + size(size(b"cert")) + size(b"")) + size(size(struct.pack("<I", 0x103) + size(b"s"))) + size(b"key")
    block = android_package.write_block([(android_package.V2, size(size(signer))), (7, b"other")])
    end = data.index(zip_archive.END)
    whole = data[:at] + block + data[at : end + 16] + struct.pack("<I", at + len(block)) + data[end + 20 :]
    got = run(android_package.package, whole)
    first, other = got["signing_block"]["pairs"]
    assert first["signers"][0]["public_key"] == b"key" and first["signers"][0]["signed_data"]["certificates"] == [b"cert"]
    assert other == {"id": 7, "value": b"other"}
    assert b"".join(android_package.signable_sections(whole)) == data


def test_keystore():
    value = {"implementation": "JKS", "version": 2, "entries": [{"type": "privateKey", "alias": "k\0\U0001f600", "created_millis": 1, "private_key": b"p", "certificates": [{"type": "X.509", "certificate": b"c"}]}], "hash": bytes(20)}
    assert run(keystore.keystore, keystore.write(value)) == value


@pytest.mark.parametrize("text", ["(a 'b `(c ,d ,@e) \"x\\\"y\")", "()", "atom", "'()"])
def test_s_expressions(text):
    tree = run(s_expression.document, text)
    assert s_expression.write(tree) == text
    assert run(s_expression.document, f"  {text} ") == tree


def test_regex():
    assert run(regex_ast.alternation, "a|b*")["right"] == {"type": "star", "inner": {"type": "literal", "charset": [(98, 98)]}}
    assert run(regex_ast.alternation, "[^a-c]")["charset"] == [(0, 96), (100, 0xFFFF)]
    assert run(regex_ast.alternation, r"\d{2,}(?<n>x)(?!y)$")["left"]["max"] is None
    assert run(regex_ast.alternation, "") == {"type": "epsilon"}
    for bad in ("(", "a)", "*", "[a", "a{"):
        with pytest.raises(ParseFailure):
            run(regex_ast.alternation, bad)


def test_charsets():
    a, b = [(1, 5), (7, 9)], [(4, 7)]
    assert regex_ast.union(a, b) == [(1, 9)] and regex_ast.difference(a, b) == [(1, 3), (8, 9)] and regex_ast.complement(regex_ast.complement(a)) == a


def test_shell():
    tree = run(shell.script, "A=1 cmd \"x $HOME ${y:-z}\" 'q' 2>&1 | b & (c; d) && { e; }\ncat <<E\nbody $x\nE\nf $(g)")
    first = tree["entries"][0]
    assert first["separator"] == "&" and len(first["command"]["commands"]) == 2
    assert first["command"]["commands"][0]["assignments"][0]["name"] == "A"
    assert tree["entries"][1]["command"]["commands"][0]["type"] == "subshell"
    assert tree["entries"][3]["command"]["commands"][0]["redirects"][0]["body"] == "body $x\n"
    assert tree["entries"][4]["command"]["commands"][0]["words"][1]["parts"][0]["type"] == "command-substitution"
    for bad in ("'a", "(a", "| a"):
        with pytest.raises(ParseFailure):
            run(shell.script, bad)


def test_dex_sections():
    strings = [b"LA;", b"V"]
    ids, data = 112, 112 + 8 + 8
    offsets, blob = [], b""
    for s in strings:
        offsets.append(data + len(blob))
        blob += bytes([len(s)]) + s + b"\0"
    head = b"dex\n035\0" + struct.pack("<I20sIII", 0, bytes(20), 0, 112, 0x12345678) + struct.pack("<III", 0, 0, 0)
    head += struct.pack("<" + "I" * 14, 2, ids, 2, ids + 8, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    got = run(dex.executable, head + struct.pack("<II", *offsets) + struct.pack("<II", 0, 1) + blob)
    assert [r["value"] for r in got["string_data"]] == ["LA;", "V"] and got["type_ids"][1] == {"idx": 1, "string_idx": 1}


def test_failures():
    many = [ParseFailure("A", "", 3, 1), ParseFailure("B", "", 5, 0), ParseFailure("C", "", 5, 2)]
    assert [f.name for f in join_failures(many, "furthest")] == ["B", "C"]
    assert [f.name for f in join_failures(many, "deepest")] == ["C"]
    assert join_failures(many, "none") == [] and join_failures(many) == many
    assert Cursor("abc").attempt(lambda c: c.take(9))[0] is False


def test_tables(spark):
    df = spark.createDataFrame([(1, '{"a": [1, "x"]}'), (2, "{"), (3, None)], "id long, s string")
    rows = {r.id: r for r in tables.parse_column(df, "s", "json").collect()}
    assert json.loads(rows[1].value) == {"a": [1, "x"]} and rows[2].error.name == "Unexpected" and rows[3].value is None and rows[3].error is None
    nodes = tables.node_table(df, "id", "s", "json").collect()
    assert {r.id for r in nodes} == {1} and sum(r.parent_id is None for r in nodes) == 1
    with pytest.raises(Exception, match="Unexpected"):
        tables.parse_column(df, "s", "json", strict=True).collect()


def test_zip_source(spark, tmp_path):
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("f.txt", f"text {i}")
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 not really")
    got = tables.read_archives(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.content) for r in got if not r.error) == [b"text 0", b"text 1"]
    assert [r.archive.endswith("bad.zip") for r in got if r.error] == [True]
    assert tables.read_files(spark, str(tmp_path), "zip").where("error is null").count() == 2


@pytest.mark.parametrize(("form", "text"), [("json", "[" * 3000 + "1" + "]" * 3000), ("s_expression", "(" * 3000 + "a" + ")" * 3000), ("shell", "(" * 400 + "ls" + ")" * 400), ("java", "class A { int x = " + "(" * 300 + "1" + ")" * 300 + "; }")])
def test_deep_nesting_is_read(form, text):
    value = run(tables.FORMATS[form][0], text)
    assert tables.to_json(value) and len(tables.flatten(value)) > 300 - 299 * (form == "java")


@pytest.mark.parametrize("form", sorted(tables.FORMATS))
def test_any_bytes_are_a_value_or_a_failure(form):
    """Random inputs, cut and changed ones, and nesting without end: never another exception than a failure."""
    rng = random.Random(form)
    rule, binary = tables.FORMATS[form]
    marks = ["(", "[", "{", '"', "'", "\\", "\n", "a", "1", "-", " ", ";", "$", "`", "<", "=", "\ud800", "class A ", "const x = ", ".method "]
    heads = [b"PK\x03\x04", b"dex\n035\0", b"\xfe\xed\xfe\xed\0\0\0\2", b"\x12\0\0\0\x02a\0", b""]
    for i in range(150):
        x = rng.choice(heads) + rng.randbytes(rng.randrange(80)) if binary else "".join(rng.choice(marks) for _ in range(rng.randrange(60)))
        with contextlib.suppress(ParseFailure):
            run(rule, x)
    if not binary:
        for mark in "([{":
            with contextlib.suppress(ParseFailure):
                run(rule, mark * 3000)


def test_symbolic_escapes():
    read = lambda x: run(s_expression.document, x)["value"]
    assert read(r'"a\nb\t\r\f\b\q\"\\"') == 'a\nb\t\r\f\bq"\\'
    assert read(r"a\ b\(") == "a b(" and read("ab\\") == "ab"
    for value in ('x\n"\\\t', "plain"):
        assert read(s_expression.write({"type": "string", "value": value})) == value
    with pytest.raises(ParseFailure):
        run(s_expression.document, "\\")


def test_stream(spark, tmp_path):
    from lexmill.streaming.chunks import split_stream

    spark.createDataFrame([(1, 0, "ab;c"), (1, 2, ";e"), (1, 1, "d"), (2, 0, "x;")], "stream_id long, seq long, chunk string").repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream_id long, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = split_stream(src, ";").writeStream.format("memory").queryName("items").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("items").collect()) == [(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x")]


def test_opcodes():
    table = dalvik_bytecode.OPCODES
    assert len(table) == 224 and len(dalvik_bytecode.CODES) == 224
    assert [table[i][0] for i in (0x09, 0x2D, 0x3D, 0x51, 0x5F, 0x6D, 0x78, 0x8F, 0xAF, 0xCF, 0xD7, 0xE2, 0xFF)] == ["move-object/16", "cmpl-float", "if-lez", "aput-short", "iput-short", "sput-short", "invoke-interface/range", "int-to-short", "rem-double", "rem-double/2addr", "xor-int/lit16", "ushr-int/lit8", "const-method-type"]
    assert all(i not in table for i in (0x3E, 0x43, 0x73, 0x79, 0x7A, 0xE3, 0xF9))


def test_bytecode():
    forms = {}
    for code, (name, form) in dalvik_bytecode.OPCODES.items():
        forms[form] = name
    fill = {"a": 3, "b": 5, "c": 7, "literal": -2, "index": 9, "target": 4, "prototype": 6}
    code = []
    for form, name in forms.items():
        fields = {n: fill[n] for n in dalvik_bytecode.LAYOUT[form][1] if n in fill}
        if form in ("35c", "45cc"):
            fields = {"index": 9, "registers": [1, 2, 3, 4, 5]} | ({"prototype": 6} if form == "45cc" else {})
        if "count" in dalvik_bytecode.LAYOUT[form][1]:
            fields |= {"registers": [4, 5, 6]}
        if form == "21h":
            fields["literal"] = -2 << (48 if name == "const-wide/high16" else 16)
        code.append({"operation": name} | fields)
    code += [{"operation": "packed-switch-payload", "first": -1, "targets": [3, 4]}, {"operation": "sparse-switch-payload", "keys": [1, 9], "targets": [2, 2]}, {"operation": "fill-array-data-payload", "width": 1, "data": b"abc"}]
    got = run(dalvik_bytecode.instructions, dalvik_bytecode.write(code))
    assert [{k: v for k, v in x.items() if k not in ("offset", "units")} for x in got] == code
    with pytest.raises(ParseFailure):
        run(dalvik_bytecode.instructions, b"\x3e\x00")


def test_targets():
    code = [{"operation": "packed-switch", "a": 0, "target": 6}, {"operation": "goto", "target": -3}, {"operation": "return-void"}, {"operation": "nop"}, {"operation": "packed-switch-payload", "first": 0, "targets": [3, 4]}]
    got = dalvik_bytecode.with_target_indices(run(dalvik_bytecode.instructions, dalvik_bytecode.write(code)))
    assert got[0]["target_index"] == 4 and got[1]["target_index"] == 0 and got[4]["target_indices"] == [1, 2]


@pytest.mark.parametrize("text", ["A=1 B= cmd \"x $HOME ${y:-z} \\\"\" 'q r' a\\ b 2>&1 | b & (c; d) && { e; }", "cat <<E >o\nbody $x\nE\nf $(g `h`) $((1 + 2)) ${#v}", "! a || b\nc", "x=$(a; b) >f", ""])
def test_shell_text(text):
    tree = run(shell.script, text)
    again = shell_text.script(tree)
    assert run(shell.script, again) == tree, again


def test_executable_round_trip():
    values = [{"type": t, "value": v} for t, v in [("byte", -3), ("short", -300), ("char", 40000), ("int", 7), ("long", -(1 << 60)), ("float", 1.5), ("double", -0.1), ("double", 0.0), ("string", 2), ("null", None), ("boolean", True), ("boolean", False), ("enum", 300)]]
    values += [{"type": "array", "value": values[:3]}, {"type": "annotation", "value": {"type_idx": 1, "elements": [{"name_idx": 200, "value": values[0]}]}}]
    body = [{"operation": "packed-switch", "a": 0, "target": 4}, {"operation": "return-void"}, {"operation": "packed-switch-payload", "first": 0, "targets": [3]}, {"operation": "nop"}]
    codes = [{"op": "advance_pc", "value": 300}, {"op": "advance_line", "value": -70}, {"op": "start_local_extended", "register": 1, "name_idx": 0, "type_idx": None, "signature_idx": 2}, {"op": "set_prologue_end"}, {"op": "special", "value": 10 + 15 * 2 + 5}, {"op": "end_local", "register": 1}]
    tries = [{"start": 0, "count": 1, "handlers": [{"type_idx": 1, "address": 3}], "catch_all": None}, {"start": 1, "count": 2, "handlers": [], "catch_all": 3}]
    code = {"registers": 2, "ins": 1, "outs": 0, "instructions": body, "tries": tries, "debug": {"line_start": 100, "parameter_names": [None], "codes": codes}}
    note = {"visibility": "system", "type_idx": 0, "elements": [{"name_idx": 1, "value": values[3]}]}
    notes = {"class": [note], "fields": [{"idx": 0, "annotations": [note, note]}], "methods": [{"idx": 0, "annotations": [note]}], "parameters": [{"idx": 1, "annotations": [[], [note]]}]}
    data = {"static_fields": [{"idx": 0, "access_flags": 8}, {"idx": 5, "access_flags": 1}], "instance_fields": [], "direct_methods": [{"idx": 0, "access_flags": 1, "code": code}], "virtual_methods": [{"idx": 1, "access_flags": 1024, "code": None}]}
    raw = dex_writer.write(["LA;", "V", "x\0\U0001f600"], [0, 1], [(1, 1, [0])], [(0, 1, 2)], [(0, 0, 2), (0, 0, 1)], [{"class_idx": 0, "access_flags": 1, "superclass_idx": dex.NO_INDEX, "source_file_idx": dex.NO_INDEX, "interfaces": [1], "data": data, "annotations": notes, "static_values": values}])
    got = run(dex.executable, raw)
    one = got["class_defs"][0]
    read = one["data"]["direct_methods"][0]["code"]
    read["instructions"] = [{k: v for k, v in x.items() if k not in ("offset", "units")} for x in read["instructions"]]
    assert one["data"] == data and one["annotations"] == notes and one["static_values"] == values
    assert [r["value"] for r in got["string_data"]] == ["LA;", "V", "x\0\U0001f600"]
    assert [r["offset"] for r in got["map"]] == sorted(r["offset"] for r in got["map"]) and got["header"]["file_size"] == len(raw)
    assert dex_data.lines(read["debug"]) == [(302, 31)]
    with pytest.raises(ParseFailure):
        run(dex_data.encoded_value, b"\x01\0")
