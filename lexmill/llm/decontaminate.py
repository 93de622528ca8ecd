"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: Fixed masks: 1 is a token that is hashed, 0 one that may differ. The second survives a change of every fifth token, all
#: together any two changes in 13 tokens.
MASKS = ("1110010111", "1101111011", "1110111")
#: An overlap holds so many aligned tokens, or the whole item if that is shorter, of which this share is equal.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seed_rows(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """keep, position and seed of each seed of column `hashes`, none where it is null or holds fewer tokens than a mask.

    Each token is a row before its seeds are made: over columns of a row they are compiled, within an array interpreted.
    """
    places = F.array_repeat(F.lit(0), F.size("hashes"))  # not hashes itself: Spark would filter by its size and make it twice
    rows = df.select(*keep, "hashes", F.posexplode(places).alias("pos", "__0"))
    return rows.select(*keep, "pos", F.explode(F.array(*(_seed(m, mask) for m, mask in enumerate(masks)))).alias("seed")).where("seed is not null")


def _seed(m: int, mask: str) -> Column:
    """Seed of one mask at `pos` of `hashes`, null if too few tokens are left."""
    picked = ", ".join(f"get(hashes, pos + {k})" for k, c in enumerate(mask) if c == "1")
    return F.expr(f"if(pos + {len(mask)} <= size(hashes), xxhash64({picked}, {m}), null)")


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, pick) -> Column:  # noqa: ANN001
    """pick (least, greatest) of all numbers up to each."""
    return F.aggregate(numbers, F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, pick(x, F.get(a, F.size(a) - 1))))


def _window(equal: Column, least: Column, share: float) -> Column:
    """struct(from, to, eq): of all windows over an alignment's 1 (equal) and 0 in which `share` is equal, the longest and first.

    No valid window holds more equal tokens than the longest. Unequal tokens at its ends are taken off, as far as
    `least` tokens stay; a result of fewer than `least` tokens says that no window of that length is valid.
    """
    part = Fraction(share).limit_denominator(1_000_000)
    up = F.aggregate(equal, F.array(F.lit(0).cast("long")), lambda a, e: F.array_append(a, F.get(a, F.size(a) - 1) + e))

    def longest(up: Column, first: Column, last: Column) -> Column:
        # first: least surplus of a start up to i; last: most of an end from j on; neither i nor j ever goes back
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("from"), F.lit(0).alias("to"))

        def step(a: Column, _: Column) -> Column:
            ok = F.get(last, a["j"]) >= F.get(first, a["i"])
            more = ok & (a["j"] - a["i"] > a["to"] - a["from"])
            moved = F.struct((a["i"] + F.when(ok, 0).otherwise(1)).alias("i"), (a["j"] + F.when(ok, 1).otherwise(0)).alias("j"), F.when(more, a["i"]).otherwise(a["from"]).alias("from"), F.when(more, a["j"]).otherwise(a["to"]).alias("to"))
            return F.when(a["j"] >= F.size(up), a).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(up)), start, step)

    def trimmed(up: Column, w: Column) -> Column:
        ones, before = F.get(up, w["to"]) - F.get(up, w["from"]), F.get(up, w["from"])
        begin = F.array_position(up, before + 1).cast("int") - 2  # the first equal token
        end = F.array_position(up, before + ones).cast("int") - 1  # behind the last one
        stop = F.greatest(end, F.least(begin + least, w["to"]))
        return F.when(ones == 0, F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(0).cast("long").alias("eq"))).otherwise(F.struct(F.greatest(w["from"], F.least(begin, stop - least)).alias("from"), stop.alias("to"), ones.alias("eq")))

    def of(up: Column) -> Column:
        surplus = F.transform(up, lambda c, i: part.denominator * c - part.numerator * i)
        ends = _let(surplus, lambda p: F.struct(_running(p, F.least).alias("first"), F.reverse(_running(F.reverse(p), F.greatest)).alias("last")))
        return _let(ends, lambda x: _let(longest(up, x["first"], x["last"]), lambda w: trimmed(up, w)))

    return _let(up, of)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST_TOKENS, share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, n_tokens, n_equal): the best substitution-tolerant overlap of each pair that has one.

    Seeds of all documents are joined to those of the items (broadcast within the counted bound, else shuffled). Each
    hit fixes an alignment; every window along it counts that holds `least` tokens, or all of a shorter item's, of which
    `share` are equal, wherever the others stand, and the one with most equal tokens is the overlap. Items shorter than
    a mask are looked up as a whole. Null or empty texts on either side overlap with nothing; rows of one id are taken together;
    null ids are a single id of their own; ties go to the first start; other columns are left out; empty tables give no
    rows. Texts are whole.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    items = cut(benchmark.select(F.col(item_col).alias("__item"), words_of(F.col(item_text)).alias("__words")).where(F.size("__words") > 0).distinct())
    span = min(map(len, masks))
    short = [r[0] for r in items.select(F.size("__words")).where(F.size("__words") < span).distinct().collect()]  # fewer than a mask's length
    every = [*masks, *("1" * n for n in sorted(short))]
    ready = items.select("__item", F.size("__words").alias("__n"), hashed(F.col("__words")).alias("hashes"))
    marks = _seed_rows(ready, ["__item"], every).groupBy("seed").agg(F.collect_set(F.struct("__item", F.col("pos").alias("__at"))).alias("__where"))
    marks, _ = small(marks)

    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    coded = texts.select("__doc", hashed(F.split(F.lower("__text"), r"[^\p{L}\p{N}]+")).alias("raw"))
    empty = F.xxhash64(F.lit(""))
    coded = coded.select("__doc", F.filter("raw", lambda h: h != empty).alias("hashes"))
    hits = _seed_rows(coded, ["__doc"], every).join(marks, "seed")
    hits = hits.select("__doc", "pos", F.explode("__where").alias("__w")).select("__doc", F.col("__w.__item").alias("__item"), (F.col("pos") - F.col("__w.__at")).alias("__shift")).distinct()
    lines, _ = small(hits.groupBy("__doc", "__item").agg(F.collect_set("__shift").alias("__shifts")).withColumnRenamed("__doc", "__d"))
    back = texts.join(lines, F.col("__doc").eqNullSafe(F.col("__d"))).select("__doc", "__item", "__shifts", words_of(F.col("__text")).alias("__tokens"))
    side, _ = small(items.select(F.col("__item").alias("__i"), "__words"))
    both = back.join(side, F.col("__item").eqNullSafe(F.col("__i"))).select("__doc", "__item", "__words", "__tokens", F.explode("__shifts").alias("__shift"))
    low = F.greatest(F.lit(0), -F.col("__shift"))
    high = F.least(F.size("__words"), F.size("__tokens") - F.col("__shift"))
    equal = F.transform(F.sequence(low, high - 1), lambda j: F.when(F.get("__words", j) == F.get("__tokens", j + F.col("__shift")), 1).otherwise(0))
    n_least = F.least(F.lit(least), F.size("__words"))
    found = both.select("__doc", "__item", (low + F.col("__shift")).alias("__base"), n_least.alias("__least"), _let(equal, lambda e: _window(e, n_least, share)).alias("__o"))
    found = found.where(F.col("__o.to") - F.col("__o.from") >= F.col("__least"))
    found = found.select("__doc", "__item", (F.col("__o.from") + F.col("__base")).cast("long").alias("doc_start"), (F.col("__o.to") - F.col("__o.from")).cast("long").alias("n_tokens"), F.col("__o.eq").cast("long").alias("n_equal"))
    top = found.groupBy("__doc", "__item").agg(F.max(F.struct("n_equal", (-F.col("doc_start")).alias("first"), "n_tokens")).alias("t"))
    return top.select(F.col("__doc").alias(id_col), F.col("__item").alias(item_col), (-F.col("t.first")).alias("doc_start"), F.col("t.n_tokens").alias("n_tokens"), F.col("t.n_equal").alias("n_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of docs, all columns, whose text overlaps with no item of the benchmark.

    Decided by texts, whatever the ids: a row's key is the digest of its text, so equal texts share their fate and null
    texts stay. options may name the text's column.
    """
    text = F.col(options.get("text_col", "text"))
    dirty, _ = small(overlaps(docs.select(F.md5(text.cast("binary")).alias("__key"), text), benchmark, id_col="__key", **options).select(F.col("__key").alias("__dirty")).distinct())
    return docs.join(dirty, F.md5(text.cast("binary")) == F.col("__dirty"), "left_anti")
