"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, cut_and, splitmix

#: Width of a quantum in units of the normalised vectors; chance that a pair at the least cosine shares a table, at least;
#: random pairs of a vector over all tables, at most. Projections and tables follow from these and the counted vectors.
WIDTH, RECALL, RANDOM_PAIRS = 2.0, 0.97, 32.0
#: Rows of a bucket that are compared in one block of the cosine check.
BLOCK = 1024
#: Rows of a bucket that are held for the cheap test; all rows of larger buckets pass it.
HELD = 1 << 16
#: Differing signs, of 128, beyond which two vectors of a bucket are not looked at (18 +- 4 expected at cosine 0.9).
SIGNS = 40
_GRID, _STEP = 2.0**20, 2.0**12


def same_quantum(distance: float, width: float) -> float:
    """Chance that two points so far apart have one quantum of a random projection."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


def plan(n: int, least: float, width: float = WIDTH, recall: float = RECALL, most: float = RANDOM_PAIRS) -> tuple[int, int]:
    """(tables, projections) for n vectors: as few projections as keep random pairs (cosine 0) of a vector below `most`.

    A pair at the least cosine shares a table of k projections with chance p ** k, so log(1 - recall) / log(1 - p ** k)
    tables find it. Tables grow as about n ** 0.27, and the pairs that buckets hold in proportion to n.
    """
    near, far = same_quantum(math.sqrt(max(2 - 2 * least, 1e-9)), width), same_quantum(math.sqrt(2), width)
    for k in range(1, 200):
        tables = math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))
        if n * tables * far**k <= most:
            break
    return tables, k


class Hasher:
    """floor((a . v + b) / w) of fixed projections. Vectors and projections are on a grid, so sums are exact and do not depend on the batch."""

    def __init__(self, dim: int, tables: int, projections: int, width: float = WIDTH, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim, tables, projections])
        self.tables, self.projections = tables, projections
        self.a = np.round(rng.standard_normal((dim, tables * projections)) * _STEP)
        self.b = np.floor(rng.random(tables * projections) * width * _GRID * _STEP)
        self.w = width * _GRID * _STEP
        self.s = np.round(rng.standard_normal((dim, 128)) * _STEP)
        self.odd = rng.integers(1, 2**63, projections, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, unit: np.ndarray, first: int | None = None) -> np.ndarray:
        """A 64-bit bucket key for each vector and table, or for the first tables alone."""
        n = self.tables if first is None else first
        q = np.floor((np.round(unit * _GRID) @ self.a[:, : n * self.projections] + self.b[: n * self.projections]) / self.w).astype(np.int64).astype(np.uint64)
        q = q.reshape(len(unit), n, self.projections)
        return splitmix((q * self.odd).sum(2, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        bits = np.packbits(np.round(unit * _GRID) @ self.s > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.int64).reshape(len(unit), 2)


_hashers: dict[tuple, Hasher] = {}


def hasher(*args) -> Hasher:  # noqa: ANN002
    if args not in _hashers:
        _hashers[args] = Hasher(*args)
    return _hashers[args]


def unit_vectors(raw: list[bytes]) -> np.ndarray:
    """Rows of doubles, scaled to length 1 in double precision (first by their largest component, so that squares stay finite)."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _marked(key: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Rows, sorted by key, that have another row of their key within SIGNS differing signs. Looks at pairs one shift at a time."""
    mark = np.zeros(len(key), bool)
    at, shift = np.arange(len(key) - 1), 1
    run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    while len(at):
        if shift & (shift - 1) == 0 and shift > 1:  # rows of runs that are marked throughout are done
            at = at[np.bincount(run, weights=~mark)[run[at]] > 0]
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        open_ = ~(mark[at] & mark[at + shift])
        some = at[open_]
        near = np.bitwise_count((sign[some] ^ sign[some + shift]).view(np.uint64)).sum(1) <= SIGNS  # of signed numbers it would count the absolute value
        mark[some[near]] = mark[some[near] + shift] = True
        shift += 1
    return mark


def vector_links(vectors: DataFrame, least: float = 0.9, tables: int | None = None, projections: int | None = None, width: float = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are first taken together as one class with a count. Class representatives are hashed into `tables`
    tables of `projections` (by default those of plan() for the counted classes); a cheap test of signs leaves the rows of a bucket that may have a partner there; buckets are cut into
    blocks, and each pair of blocks checks its cosines in double precision. A pair counts in the first table that it
    shares, so it counts once; blocks return counts and a spanning set of links, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have 0 links and are their own component.
    Vectors of different lengths link with nothing of another length. Rows with one id are one vector each, in a shared
    component; null ids link with nothing. Other columns are left out; an empty table gives no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("__v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("__v")).select("id", F.when(F.coalesce(good, F.lit(False)), v).alias("__v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(x, np.float64) + 0.0 if x is not None else None for x in b.column(1).to_pylist()]
            raw = [None if x is None else x.tobytes() for x in raw]
            digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "raw"])

    coded = rows.mapInArrow(encode, f"id {kind}, digest binary, raw binary")
    slim = cut(coded.select(F.col("id").cast("long").alias("id"), "digest"))
    classes, (n_classes,) = cut_and(slim.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    if tables is None or projections is None:
        tables, projections = plan(n_classes, least, width)
    # one row of each class keeps its vector
    reps = coded.where("digest is not null").select("digest", F.col("id").cast("long").alias("__id"), "raw").join(classes.select(F.col("digest").alias("__d"), "rep", "n"), (F.col("digest") == F.col("__d")) & (F.col("__id") == F.col("rep")))
    reps = cut(reps.groupBy("digest").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.first("raw").alias("raw")))

    def slim_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, digests = b.column("raw").to_pylist(), b.column("digest").to_pylist()
            for size in sorted({len(r) for r in raws}):
                mine = [i for i, r in enumerate(raws) if len(r) == size]
                for lo in range(0, len(mine), 2048):
                    part = mine[lo : lo + 2048]
                    u, h = unit_vectors([raws[i] for i in part]), hasher(size // 8, tables, projections, width)
                    s = np.repeat(h.signs(u), tables, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(h.keys(u).ravel() ^ np.int64(size)), pa.array([digests[i] for i in part for _ in range(tables)], pa.binary()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=["t", "key", "digest", "s0", "s1"])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key. Of a run that is cut by the memory bound every row passes."""
        held, whole = None, None  # rows that are not done yet; the run that all rows of pass
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = held.column("key").to_numpy()
            done = int(np.searchsorted(np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))), np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))[-1])) if len(key) else 0
            if done == 0 and len(key) < HELD:
                continue
            if done == 0:
                whole, done = key[0], len(key)
                yield from held.select(["t", "key", "digest"]).combine_chunks().to_batches()
                held = None
                continue
            yield from test(held.slice(0, done), whole)
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield from test(held, whole)

    def test(part: pa.Table, whole: int | None) -> list[pa.RecordBatch]:
        key = part.column("key").to_numpy()
        mark = _marked(key, np.stack([part.column("s0").to_numpy(), part.column("s1").to_numpy()], 1))
        if whole is not None:
            mark |= key == whole
        return part.select(["t", "key", "digest"]).filter(pa.array(mark)).combine_chunks().to_batches()

    dealt = reps.mapInArrow(slim_keys, "t int, key long, digest binary, s0 long, s1 long").repartition("t", "key").sortWithinPartitions("t", "key")
    left = cut(dealt.mapInArrow(survivors, "t int, key long, digest binary"))
    buckets = left.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).select(F.col("t").alias("__t"), F.col("key").alias("__k"), "nb")
    mine = left.join(buckets, (F.col("t") == F.col("__t")) & (F.col("key") == F.col("__k"))).select("t", "key", "nb", F.col("digest").alias("__dig"), F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int").alias("own"))
    spread = mine.select("t", "key", "__dig", "own", F.explode(F.expr("transform(sequence(0, nb - 1), j -> struct(least(own, j) as i, greatest(own, j) as j))")).alias("p")).select("t", "key", "__dig", "own", "p.*")
    pairs = spread.join(reps.select("digest", "rep", "n", "raw"), F.col("__dig") == F.col("digest")).select("t", "key", "i", "j", "own", "rep", "n", "raw")

    def check(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        raws = group.column("raw").to_pylist()
        size = len(raws[0])
        own, rep, n = (group.column(c).to_numpy() for c in ("own", "rep", "n"))
        order = np.lexsort((rep, own))
        u, own, rep, n = unit_vectors([raws[k] for k in order]), own[order], rep[order], n[order]
        split = int((own == i).sum()) if i != j else 0
        left_, right = (slice(0, split), slice(split, None)) if i != j else (slice(None), slice(None))
        near = u[left_] @ u[right].T >= least
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        # of these, the pairs that no earlier table holds
        rows, cols = np.unique(a), np.unique(b)
        fresh = near[np.ix_(rows, cols)]
        if t and len(rows):
            h = hasher(size // 8, tables, projections, width)
            one, two = np.ascontiguousarray(h.keys(u[left_][rows], t).T), np.ascontiguousarray(h.keys(u[right][cols], t).T)
            for earlier in range(t):
                fresh &= one[earlier][:, None] != two[earlier][None, :]
        count = np.zeros(len(rep))
        np.add.at(count, rows, fresh @ n[right][cols])
        np.add.at(count, cols + split, fresh.T @ n[left_][rows])
        b = b + split
        root = np.arange(len(rep))
        while len(a):  # smallest row reachable inside the block
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        touched = np.zeros(len(rep), bool)
        touched[a] = touched[b] = True
        return pa.table({"rep": pa.array(rep[touched]), "root": pa.array(rep[root[touched]]), "n_links": pa.array(count[touched].astype(np.int64))})

    counted = cut(pairs.groupBy("t", "key", "i", "j").applyInArrow(check, "rep long, root long, n_links long"))
    links = counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    same_id = slim.where("digest is not null").join(classes, "digest").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    groups = components(counted.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(same_id))
    named = classes.join(links.withColumnsRenamed({"rep": "__r"}), F.col("rep") == F.col("__r"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("digest").alias("__d"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = slim.join(named, F.col("digest") == F.col("__d"), "left")
    comp = F.coalesce("component_id", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))
