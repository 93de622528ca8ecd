"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes up to which a measured table may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset (local tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: a lost executor loses nothing of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and(df: DataFrame, *measures: Column) -> tuple[DataFrame, list]:
    """df cut, and aggregates over its rows taken on the way, without another job. A task that ran twice may count twice."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("m0"), *(m.alias(f"m{i}") for i, m in enumerate(measures, 1))))
    return out, [seen.get[f"m{i}"] for i in range(len(measures) + 1)]


def _width(name: str, kind: DataType) -> Column:
    """Bytes of a column of the table in hand, as a broadcast holds them."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = F.transform(c, lambda x: F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(kind.elementType, (StringType, BinaryType)) else None
        inner = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, StructType) else 8
        return F.coalesce((F.size(c) * inner if each is None else F.aggregate(each, F.lit(0), lambda a, x: a + x)), F.lit(0)) + 24
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df, cut and measured on the way; hinted for broadcast if all its rows take at most so many bytes."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(32)).cast("long")
    out, (_, size) = cut_and(df, F.sum(width))
    if (size or 0) > most:
        return out, False
    return F.broadcast(out.coalesce(max(1, out.rdd.getNumPartitions() // 32))), True


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def runs(n_chars: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of consecutive texts with at most so many characters together, one text at least."""
    i, total = 0, 0
    for j, n in enumerate(n_chars):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(n_chars):
        yield i, len(n_chars)


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(i, j, texts i to j) of a column, at most so many bytes at a time: only one block's texts are Python strings at once."""
    for i, j in runs(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield i, j, column.slice(i, j - i).to_pylist()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component): each node that has an edge with the smallest node it reaches.

    Alternating large-star and small-star steps; each replaces the edges by as many or fewer and is cut. What says that
    nothing moved any more is observed on the way: two numbers a round. Null ends and loops are ignored; repeated edges
    count once; a node with very many edges is one of skewed joins, which adaptive execution splits.
    """
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ends = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, state = cut_and(ends, sign)
    for _ in range(rounds if state[0] else 0):
        # large star: the larger ends of a node go to the smallest of its neighbourhood, itself included
        low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = e.join(low, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: a node and its smaller ends go to the smallest of them
        least = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        moved = least.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, (e, state) = state, cut_and(moved.where("a <> b").distinct(), sign)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


WORDS = re.compile(r"[^\W\d_]+")
