"""Formats over DataFrames: one value, one node table or one row for each entry, for any column of inputs."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from datetime import datetime
from math import isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cursor import Cursor, ParseFailure, run
from . import android_package, bson, dalvik_bytecode, dex, java, java_text, javascript, javascript_text, json_text, keystore, regex_ast, s_expression, shell, shell_text, smali, zig, zig_text, zip_archive

#: Name to (rule, reads bytes).
FORMATS: dict[str, tuple[Callable[[Cursor], object], bool]] = {
    "json": (json_text.value, False), "s_expression": (s_expression.document, False), "regex": (regex_ast.alternation, False), "shell": (shell.script, False), "java": (java.compilation_unit, False), "zig": (zig.source_file, False), "smali": (smali.class_definition, False), "javascript": (javascript.program, False),
    "bson": (bson.document, True), "zip": (zip_archive.archive, True), "apk": (android_package.package, True), "keystore": (keystore.keystore, True), "dex": (dex.executable, True), "dalvik": (dalvik_bytecode.instructions, True),
}
#: Printers of trees that the rules of the same name give.
PRINTERS: dict[str, Callable[[dict], str]] = {"shell": shell_text.script, "java": java_text.text, "zig": zig_text.text, "javascript": javascript_text.text}
VALUE = "value string, error struct<name string, message string, position bigint, depth int>"
NODES = "node_id bigint, parent_id bigint, ordinal int, field string, type string, value string"


def plain(value: object) -> object:
    """What JSON can hold: bytes in base 64, dates in ISO form, numbers that aren't finite as text."""
    if isinstance(value, float) and not isfinite(value):
        return str(value)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def to_json(value: object) -> str:
    """JSON text of a rule's value, without recursion, so depth is no matter."""
    out: list[str] = []
    todo: list[object] = [value]
    text = json.JSONEncoder(ensure_ascii=False).encode
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            todo.append(_Raw("}"))
            for i, (k, v) in reversed(list(enumerate(x.items()))):
                todo += [v, _Raw(f"{', ' if i else ''}{text(str(k))}: ")]
            out.append("{")
        elif isinstance(x, list | tuple):
            todo.append(_Raw("]"))
            for i, v in reversed(list(enumerate(x))):
                todo += [v, _Raw(", " if i else "")]
            out.append("[")
        else:
            out.append(text(plain(x)))
    return "".join(out)


class _Raw(str):
    """Text that is JSON already."""


def parse_column(df: DataFrame, column: str, form: str, strict: bool = False) -> DataFrame:
    """df with `value` (JSON text, for parse_json) and `error`; null inputs give nulls; strict lets a failure end the query."""
    rule, binary = FORMATS[form]
    at, keep = df.columns.index(column), df.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, errors = [], []
            for x in b.column(at).to_pylist():
                value = error = None
                if x is not None:
                    try:
                        value = to_json(run(rule, x))
                    except ParseFailure as e:
                        if strict:
                            raise
                        error = {"name": e.name, "message": e.message, "position": e.position, "depth": e.depth}
                values.append(value)
                errors.append(error)
            kind = pa.struct([("name", pa.string()), ("message", pa.string()), ("position", pa.int64()), ("depth", pa.int32())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string()), pa.array(errors, kind)], names=[*b.schema.names, "value", "error"])

    return df.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", " + VALUE)


def print_column(df: DataFrame, column: str, form: str, name: str = "text") -> DataFrame:
    """df with the text of each tree (JSON text as parse_column gives it); null trees give null."""
    printer, at = PRINTERS[form], df.columns.index(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else printer(json.loads(x)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` string")


def flatten(tree: object) -> list[tuple]:
    """(node_id, parent_id, ordinal, field, type, value) of a tree in depth-first order."""
    out: list[tuple] = []
    todo: list[tuple] = [(tree, None, 0, None)]
    while todo:
        x, parent, ordinal, name = todo.pop()
        me = len(out)
        if isinstance(x, dict):
            out.append((me, parent, ordinal, name, str(x.get("type", "object")), None))
            todo += [(v, me, i, k) for i, (k, v) in enumerate((k, v) for k, v in x.items() if k != "type")][::-1]
        elif isinstance(x, list | tuple):
            out.append((me, parent, ordinal, name, "array", None))
            todo += [(v, me, i, None) for i, v in enumerate(x)][::-1]
        else:
            out.append((me, parent, ordinal, name, "null" if x is None else type(x).__name__, None if x is None else str(plain(x))))
    return out


def node_table(df: DataFrame, key: str, column: str, form: str) -> DataFrame:
    """key and a row for each node of each input's tree; inputs that are null or don't parse have no rows."""
    rule, _ = FORMATS[form]
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x is None:
                    continue
                try:
                    tree = flatten(run(rule, x))
                except ParseFailure:
                    continue
                keys += [k] * len(tree)
                found += tree
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, *names])

    return df.select(key, column).mapInArrow(rows, f"`{key}` {df.schema[key].dataType.simpleString()}, {NODES}")


ENTRIES = "entry int, type string, path string, date timestamp, comment string, host string, compression string, content binary, error string"


def zip_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and a row for each entry of each archive; an archive that can't be read has one row with its error, null ones none."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # a batch for each archive, so memory holds one
                if x is None:
                    continue
                try:
                    found = [{"entry": i, **e} for i, e in enumerate(run(zip_archive.archive, x)["entries"])]
                except ParseFailure as e:
                    found = [{"error": str(e)}]
                cols = [[e.get(n) for e in found] for n in names]
                kinds = [pa.int32(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, *names])

    return df.select(key, column).mapInArrow(rows, f"`{key}` {df.schema[key].dataType.simpleString()}, {ENTRIES}")


def read_files(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(path, value, error) of each file below a path that Spark reads."""
    _, binary = FORMATS[form]
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content") if binary else F.decode("content", "UTF-8").alias("content"))
    return parse_column(files, "content", form).drop("content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entries' columns) of each archive below a path that Spark reads, whichever store holds it."""
    return zip_entries(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), "archive", "content")
