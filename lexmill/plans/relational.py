"""Joins, windows and aggregates that formats resolve their indices, offsets and pools with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(df: DataFrame, pool: DataFrame, key: str, pool_key: str, value: str, name: str, by: Sequence[str] = (), optional: bool = False) -> DataFrame:
    """df with `name`, the pool's value at df's key. A missing entry is an error, unless optional, where it is null."""
    side = pool.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(pool_key).alias("__key"), F.col(value).alias(name))
    on = df[key] == side["__key"]
    for c in by:
        on = on & (df[c] == side[f"__{c}"])
    out = df.join(side, on, "left")
    if not optional:
        out = out.withColumn(name, F.when(out["__key"].isNull(), F.raise_error(F.concat(F.lit(f"{key} has no entry for "), F.coalesce(df[key].cast("string"), F.lit("null"))))).otherwise(F.col(name)))
    return out.drop("__key", *(f"__{c}" for c in by))


def running_offset(df: DataFrame, size: Column, by: Sequence[str], order: Sequence[str], name: str = "offset") -> DataFrame:
    """Where each row's output begins: the sum of the sizes before it within its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def delta_encode(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str = "delta") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))


def delta_decode(df: DataFrame, delta: str, by: Sequence[str], order: Sequence[str], name: str = "value") -> DataFrame:
    return df.withColumn(name, F.sum(delta).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def zip_by_position(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], name: str = "position") -> DataFrame:
    """The i-th row of left with the i-th of right within each group."""
    number = lambda df, order: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return number(left, left_order).join(number(right, right_order), [*by, name])


def address_join(sources: DataFrame, target: str, places: DataFrame, offset: str, index: str, by: Sequence[str], name: str = "target_index") -> DataFrame:
    """The index of the place that begins at each source's target address; null where none does."""
    side = places.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(offset).alias("__at"), F.col(index).alias(name))
    on = sources[target] == side["__at"]
    for c in by:
        on = on & (sources[c] == side[f"__{c}"])
    return sources.join(side, on, "left").drop("__at", *(f"__{c}" for c in by))


def dictionary(df: DataFrame, key: str, order: str, name: str = "code") -> DataFrame:
    """(key, first, code): distinct keys numbered densely in the order they are first seen (a number or time; ties by key).

    The pool is aggregated, dealt into ranges of the order by its quantiles, and numbered within each range behind the
    counts of the ranges before; no task has the whole pool. The driver gets the quantiles, fewer than shuffle partitions.
    """
    spark = df.sparkSession
    first = df.groupBy(key).agg(F.min(order).alias("first"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.col("first").cast("double")
    bounds = sorted(set(first.select(place.alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    ranged = first.withColumn("__range", F.size(F.filter(cuts, lambda b: b < place)))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n")).select(F.col("__range").alias("__r"), (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__ahead"))  # a row for each range
    numbered = ranged.join(F.broadcast(sizes), F.col("__range") == F.col("__r"))
    here = F.row_number().over(Window.partitionBy("__range").orderBy("first", key)) - 1
    return numbered.withColumn(name, (here + F.col("__ahead")).cast("int")).select(key, "first", name)


def any_and_all(df: DataFrame, by: Sequence[str], tests: dict[str, object]) -> DataFrame:
    """by, and for each test whether it holds for any and for all rows of the group; null tests count as false."""
    held = {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    return df.groupBy(*by).agg(*(f(v).alias(f"{word}_{k}") for k, v in held.items() for word, f in (("any", F.bool_or), ("all", F.bool_and))))


def first_match(df: DataFrame, by: Sequence[str], test: object, order: str, value: str) -> DataFrame:
    """by and the value of each group's first row in order that passes the test; groups without one are left out."""
    return df.where(test).groupBy(*by).agg(F.min_by(value, order).alias(value))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with the last change of each key in place of its row, and the rows of new keys; order is left out of both."""
    names = [c for c in base.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("__new"))
    merged = base.select(key, F.struct(*names).alias("__old")).join(last, key, "full")
    return merged.select(key, F.coalesce("__new", "__old").alias("x")).select(key, "x.*")


def best_failures(df: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """Rows of each group with the largest measure (furthest position, greatest depth); ties stay."""
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(measure)))).where("__rank = 1").drop("__rank")


def join_chunks(df: DataFrame, by: Sequence[str], order: str, chunk: str, name: str = "whole") -> DataFrame:
    """Chunks of each group put together in their order, however they arrive."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), "").alias(name))


def cut_chunks(df: DataFrame, text: str, size: int, order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """A row for each piece of `size` elements; an empty text has one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias(order)).withColumn(chunk, F.substring(F.col(text), F.col(order) * size + 1, F.lit(size)))


def merge_ranges(df: DataFrame, by: Sequence[str], low: str, high: str) -> DataFrame:
    """Union of ranges of integers within each group: overlapping and neighbouring ranges become one."""
    before = Window.partitionBy(*by).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__new", F.when(F.col(low) <= F.max(high).over(before) + 1, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(upto))
    return marked.groupBy(*by, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def subtract_ranges(df: DataFrame, other: DataFrame, by: Sequence[str], low: str, high: str) -> DataFrame:
    """df's ranges without those of other, within each group: boundaries are swept, so nothing is crossed with anything."""
    point = lambda d, sign: d.select(*by, F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(sign[0]).alias("a"), F.lit(sign[1]).alias("b")), F.struct((F.col(high) + 1).alias("at"), F.lit(-sign[0]).alias("a"), F.lit(-sign[1]).alias("b")))).alias("p")).select(*by, "p.*")
    swept = point(df, (1, 0)).union(point(other, (0, 1))).groupBy(*by, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*by).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = swept.select(*by, F.col("at").alias(low), (F.lead("at").over(w) - 1).alias(high), F.sum("a").over(run).alias("__a"), F.sum("b").over(run).alias("__b"))
    return merge_ranges(open_.where("__a > 0 and __b = 0").drop("__a", "__b"), by, low, high)


def track_sections(df: DataFrame, section: str, offset: str) -> DataFrame:
    """(section, offset, size): where each section begins and how many items it has, by offset."""
    return df.groupBy(section).agg(F.min(offset).alias("offset"), F.count("*").alias("size")).orderBy("offset", section)
