"""Extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the key's hash, and how many of them one step of the directory looks at.
BITS, STEP = 64, 12


def key_bits(key: Column) -> Column:
    """The first 64 bits of the key's MD5 as sixteen hexadecimal digits; null keys hash as the empty text."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4)


def binary(hexes: Column) -> Column:
    """Hexadecimal digits as bits, four characters for each."""
    out = hexes
    for i in range(16):  # placeholders keep digits 0 and 1 apart from bits
        out = F.replace(out, F.lit(f"{i:x}"), F.lit(f"{i:04b}".replace("0", "o").replace("1", "i")))
    return F.translate(out, "oi", "01")


def directory(sized: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """(prefix, depth, bytes, n_docs) of the shards for rows (bits, size).

    All shards start as one bucket without bits. A step sums sizes by the next `step` bits of the buckets that are
    still oversized; within it each prefix becomes a shard at the first depth at which its sum fits. Only buckets that
    are oversized at the step's end go on, so later steps read ever fewer rows. A bucket that no bit divides (one key
    over the limit, or one row over it) ends at the last bit and is chained over pages.
    """
    out, base, todo = [], 0, sized
    while True:
        top = min(BITS, base + step)
        leaves = cut(todo.groupBy(F.substring("bits", 1, top).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        # sums of every prefix from base to top, each from at most 2 ** step leaves of its bucket
        sums = leaves.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "p", "size", "n")
        sums = sums.groupBy(F.expr("substring(p, 1, depth)").alias("prefix"), "depth").agg(F.sum("size").alias("bytes"), F.sum("n").alias("n_docs"))
        fits = F.col("bytes") <= limit
        # a prefix is a shard if it fits (or has no more bits) and the prefix one bit shorter does not
        parent = sums.where(~fits).select(F.col("prefix").alias("__up"), F.col("depth").alias("__at"))
        new = sums.where(fits | (F.col("depth") == BITS)).join(parent, (F.expr("substring(prefix, 1, depth - 1)") == F.col("__up")) & (F.col("depth") - 1 == F.col("__at")), "left")
        new = new.where(F.col("__up").isNotNull() | (F.col("depth") == 0))
        if base:
            new = new.where(F.col("depth") > base)
        out.append(cut(new.select("prefix", "depth", "bytes", "n_docs")))
        over = leaves.where(F.col("size") > limit).select(F.col("p").alias("__over"))
        if top == BITS or over.isEmpty():
            break
        todo, base = todo.join(over, F.substring("bits", 1, top) == F.col("__over"), "left_semi"), top
    shards = out[0]
    for x in out[1:]:
        shards = shards.union(x)
    return shards


def shard(docs: DataFrame, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page): each row's shard, named by its hash-prefix bits ('' if one holds all).

    The sum of n_bytes of a shard is at most limit, unless its rows share one key: then page tells its files apart, and
    each page holds at most limit bytes, or one row that is larger alone. Null texts have 0 bytes; null ids share the
    key of the empty text; repeated rows are all kept; other columns are left out; an empty table gives no rows. Only
    the directory is shuffled or joined, never a text.
    """
    sized = docs.select(F.col(id_col).alias("__id"), _bytes(text_col).alias("n_bytes"), F.monotonically_increasing_id().alias("__turn"))
    return _assign(sized, limit).select(F.col("__id").alias(id_col), "n_bytes", "shard", "depth", "page")


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def _assign(sized: DataFrame, limit: int) -> DataFrame:
    """(__id, n_bytes, __turn, shard, depth, page) for rows (__id, n_bytes, __turn)."""
    keyed = cut(sized.select("__id", "n_bytes", binary(key_bits(F.col("__id"))).alias("bits"), "__turn"))
    shards = directory(keyed.select("bits", F.col("n_bytes").alias("size")), limit)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # 65 values at most
    # a row's shard is the one prefix of its bits that is in the directory: an equi-join on each depth that occurs
    probes = keyed.select("__id", "n_bytes", "__turn", F.explode(F.transform(F.array(*map(F.lit, sorted(depths))) if depths else F.array().cast("array<int>"), lambda d: F.struct(F.substring(F.col("bits"), F.lit(1), d).alias("prefix"), d.alias("depth")))).alias("__p"))
    found = probes.select("__id", "n_bytes", "__turn", "__p.*").join(shards.select("prefix", "depth", "bytes"), ["prefix", "depth"])
    found = found.select("__id", "n_bytes", "__turn", F.col("prefix").alias("shard"), F.col("depth").cast("long").alias("depth"), "bytes")
    if BITS not in depths:
        return found.select("__id", "n_bytes", "__turn", "shard", "depth", F.lit(0).cast("long").alias("page"))
    within = found.where(F.col("bytes") <= limit).select("__id", "n_bytes", "__turn", "shard", "depth", F.lit(0).cast("long").alias("page"))
    return within.union(_pages(cut(found.where(F.col("bytes") > limit)), limit))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of the rows of oversized shards, by running sums of bytes in two levels, so that no task has all rows of a key.

    Rows that lie wholly in one stretch of limit bytes make its even page; the row that reaches over a stretch's end
    is the odd page after it. So every page holds at most limit bytes or a single row.
    """
    part = F.shiftright("__turn", 33)  # the input partition
    sums = rows.groupBy("shard", part.alias("part")).agg(F.sum("n_bytes").alias("b"))
    ahead = sums.select(F.col("shard").alias("__s"), F.col("part").alias("__p"), (F.sum("b").over(Window.partitionBy("shard").orderBy("part")) - F.col("b")).alias("ahead"))
    spread = rows.withColumn("part", part).join(ahead, (F.col("shard") == F.col("__s")) & (F.col("part") == F.col("__p")))
    before = F.col("ahead") + F.sum("n_bytes").over(Window.partitionBy("shard", "part").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    at = spread.withColumn("before", before)
    over = F.col("before") % limit + F.col("n_bytes") > limit
    return at.select("__id", "n_bytes", "__turn", "shard", "depth", (2 * F.floor(F.col("before") / limit) + F.when(over, 1).otherwise(0)).cast("long").alias("page"))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as Parquet, one folder for each shard and page, and return the assignment of ids.

    Rows are numbered once and joined to their shard by that number, so null and repeated ids are written like any other.
    """
    numbered = cut(docs.withColumn("__turn", F.monotonically_increasing_id()))
    assigned = cut(_assign(numbered.select(F.col(id_col).alias("__id"), _bytes(text_col).alias("n_bytes"), "__turn"), limit))
    names = assigned.select(F.col("__turn").alias("__t"), F.concat(F.lit("s"), "shard").alias("shard"), "page")
    numbered.join(names, F.col("__turn") == F.col("__t")).drop("__turn", "__t").repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
    return assigned.select(F.col("__id").alias(id_col), "n_bytes", "shard", "depth", "page")


def shard_sql(limit: int) -> str:
    """The same over `documents` for DuckDB, where no key exceeds the limit: depths from 0 to 30 at once."""
    return f"""
with k as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
  substr(cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint::bit as varchar), 33, 32) as bits from documents),
s as (select d.depth, substr(bits, 1, d.depth) as prefix, sum(n_bytes) as bytes from k, (select unnest(range(31)) as depth) d group by all),
f as (select k.doc_id, k.n_bytes, min(s.depth) as depth from k join s on s.prefix = substr(k.bits, 1, s.depth) where s.bytes <= {limit} group by all)
select f.doc_id, f.n_bytes, substr(k.bits, 1, f.depth) as shard, cast(f.depth as bigint) as depth, cast(0 as bigint) as page
from f join k using (doc_id)"""
