"""Exact Jaccard join of word shingles by a token-group matrix.

1. Equal shingle sets become one class, represented by its smallest id.
2. Classes that agree on several minima of hashed shingles are checked against a few leaders of theirs; what links is a
   group. Groups so hold similar documents, and need no pairs within. The leaders are those first in several orders of
   the ids, since one of them may be too far from the others.
3. The matrix: the tokens that the members of each group have in their prefixes, united by group. Prefixes follow one
   global order, rare tokens first, and are longer than the least by n // SLACK tokens, so that a pair that links has at
   least that many of them in common, early enough in both orders to leave room for the rest of the overlap. A
   document's bound for a group is how many such tokens of its prefix the group's union holds; groups below the bound
   stay closed.
4. Open groups: their members, in blocks of one size class, meet the documents that qualify; blocks whose union holds
   too few of a document's tokens are skipped, all others are compared exactly.
5. Components over all links found.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, runs, small, splitmix, text_blocks

BLOCK_BYTES = 800_000
#: Texts beyond so many bytes are shingled in parts that overlap by a shingle less a word, so memory doesn't follow a text's length.
PART_BYTES = 8_000_000
#: Minima of a set that grouping looks at, and how many must agree with the leader.
MINIMA, AGREE = 8, 2
#: Prefixes are longer than the least by one token for so many.
SLACK = 100
#: Each order of ids is by an id's bits after exclusive or with one of these; its first is a leader.
LEADERS = (0, 0x2AAAAAAAAAAAAAAA, 0x1999666699996666, 0x0F1E2D3C4B5A6978)
#: Documents, and shingles, of a block on either side of a comparison (one document at least).
SIDE, SIDE_SHINGLES = 256, 400_000
#: A block of documents reports the tokens that so many different sets of it hold. Reports are summed by hash class;
#: every task knows the classes' sums as bytes, so what it knows is of one size whatever the input.
REPORT, CLASS_BITS = 2, 20
#: Prefix tokens move as their low bytes: equal tokens stay equal, and different ones that become equal only cost a comparison.
TOKEN_BYTES = 5
#: Tokens that are packed at a time, and tokens of a bucket of the matrix, about.
CELLS, BUCKET_CELLS = 500_000, 1 << 20

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 1024, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMUM = _rng.integers(1, 2**63, MINIMA, np.int64).astype(np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE, _WORD = re.compile("[\t-\r ]"), re.compile("[^\t-\r ]+")


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): hashed k-word shingles of all texts in order, with repeats, and where each text's begin (one more at the end).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of 1 to k - 1 words has one shingle, the
    whole sequence; null and wordless texts have none.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    end = np.cumsum([len(r) + 1 for r in raw])
    values = _BYTE[buf]
    solid = values != 0
    first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(buf))
    place[first[0] :] -= np.repeat(first, np.diff(np.concatenate((first, [len(buf)]))))
    word = np.add.reduceat(values * _PLACE[place & 1023], first)
    size = np.add.reduceat(solid, first, dtype=np.int64)
    for i in np.flatnonzero(size > 1024):  # places repeat there
        word[i] = int.from_bytes(hashlib.blake2b(buf[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    word = splitmix(word)
    upto = np.searchsorted(first, end)  # words up to the end of each text
    n = np.diff(np.concatenate(([0], upto)))
    mixed = np.zeros(len(word), np.uint64)
    for j in range(k):
        mixed[: len(word) - j] += word[j:] * _PLACE[j]
    doc = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(upto, n) - np.arange(len(word))
    full = left >= k
    short = np.flatnonzero((n > 0) & (n < k))
    keep = full.copy()
    for d in short:
        i = upto[d] - n[d]
        mixed[i] = (word[i : i + n[d]] * _PLACE[100 : 100 + n[d]]).sum(dtype=np.uint64) + np.uint64(n[d])
        keep[i] = True
    return splitmix(mixed[keep]), np.searchsorted(doc[keep], np.arange(len(texts) + 1))


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    long = {i: t for i, t in enumerate(texts) if t is not None and len(t) > PART_BYTES // 4 and len(t.encode("utf-8", "surrogatepass")) > PART_BYTES}
    h, at = shingles([None if i in long else t for i, t in enumerate(texts)], k)
    out = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    for i, t in long.items():
        out[i] = _long_set(t, k)
    return out


def _long_set(text: str, k: int) -> np.ndarray:
    """The set of a long text, shingled in parts of at least k words each, the last k - 1 words of one being the first of the next."""
    found, tail, at = np.zeros(0, np.uint64), "", 0
    while at < len(text):
        gap = _SPACE.search(text, at + PART_BYTES // 4)
        end = gap.start() if gap else len(text)
        part = f"{tail} {text[at:end]}"
        words = _WORD.findall(part)
        at = end
        if len(words) >= k or at >= len(text):
            if len(words) >= k or not len(found):  # else all its words were in the part before
                h, _ = shingles([part], k)
                found = np.union1d(found, h)
            words = words[len(words) - k + 1 :] if k > 1 else []
        tail = " ".join(words)
    return found


def need(n: int, percent: int) -> int:
    """Least intersection with a set of n that a link may have: ceil(percent / 100 x n)."""
    return (percent * n + 99) // 100


def slack(n: int) -> int:
    """How many prefix tokens two linked sets must share, the smaller of which has n tokens."""
    return n // SLACK + 1


def _sketch(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, texts in text_blocks(b.column(1), BLOCK_BYTES):
                own = sets(texts, k)
                keys = [_minima(s) for s in own]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
                every = np.sort(np.concatenate([*dict(zip(digests, own, strict=True)).values()]))
                token, count = _counts(every)
                token, count = token[count >= REPORT], count[count >= REPORT]
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, m), pa.array([len(s) for s in own], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array([token.tobytes(), *[None] * (m - 1)], pa.binary()), pa.array([count.astype(np.int64).tobytes(), *[None] * (m - 1)], pa.binary())],
                    names=["id", "n", "digest", "keys", "tokens", "counts"])

    return run


def _minima(s: np.ndarray) -> list[int]:
    return [int(splitmix(s ^ m).min().view(np.int64)) for m in _MINIMUM] if len(s) else []


def _counts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    lead = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[lead], np.diff(np.concatenate((lead, [len(ordered)])))


def _class_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, count) of a task's reports, each class once for each block of reports."""
    for b in batches:
        for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            of, at = np.unique(_class_of(np.frombuffer(t, np.uint64)), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(np.bincount(at, weights=np.frombuffer(c, np.int64)).astype(np.int64))], names=["of", "c"])


def _pack(group: pa.Table) -> pa.Table:
    """256th part of all classes as one row of bytes: log2 of each class's sum."""
    of, c = group.column("of").to_numpy(), group.column("c").to_numpy()
    out = np.zeros(1 << (CLASS_BITS - 8), np.uint8)
    out[of & (len(out) - 1)] = np.log2(np.maximum(c, 1)).astype(np.uint8)
    return pa.table({"part": pa.array([int(of[0]) >> (CLASS_BITS - 8)], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})


def token_levels(raw: DataFrame) -> np.ndarray:
    """How often the tokens of each hash class occur, as far as blocks report it: log2 by class, 2 ** CLASS_BITS bytes at any size of the input."""
    sums = raw.where("length(tokens) > 0").select("tokens", "counts").mapInArrow(_sums, "of int, c long").groupBy("of").agg(F.sum("c").alias("c"))
    parts = sums.groupBy(F.shiftright("of", CLASS_BITS - 8).alias("part")).applyInArrow(_pack, "part int, levels binary").collect()  # 256 rows at most
    out = np.zeros(1 << CLASS_BITS, np.uint8)
    for r in parts:
        out[r["part"] << (CLASS_BITS - 8) : (r["part"] + 1) << (CLASS_BITS - 8)] = np.frombuffer(r["levels"], np.uint8)
    return out


def _narrow(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _wide(narrow: np.ndarray) -> np.ndarray:
    out = np.zeros((len(narrow) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = narrow.reshape(-1, TOKEN_BYTES)
    return out.view("<i8")[:, 0]


def _prefixes(k: int, percent: int, levels: np.ndarray):  # noqa: ANN202
    """(q, n, tokens) of each document: its number of shingles and the tokens of its prefix, in order, TOKEN_BYTES each.

    The order is by the level of a token's class, then by token: the same for all documents, so any levels are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in text_blocks(b.column(1), BLOCK_BYTES):
                out, sizes = [], []
                for s in sets(texts, k):
                    n = len(s)
                    out.append(s[np.argsort(levels[_class_of(s)], kind="stable")][: min(n, n - need(n, percent) + slack(n))])
                    sizes.append(n)
                tokens = pa.array([_narrow(t) for t in out], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes, pa.int32()), tokens], names=["q", "n", "tokens"])

    return run


def _packed(cells: np.ndarray) -> bytes:
    """Columns of numbers by their bytes, all first ones, all second ones and so on, so that what hardly changes takes hardly any room."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(cells, "<i8").view(np.uint8).reshape(len(cells), -1, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def _unpacked(cells: bytes, columns: int, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(cells, columns * rows * 8, asbytes=True), np.uint8)
    return planes.reshape(columns, 8, rows).transpose(0, 2, 1).copy().view("<i8")[:, :, 0]


def _deal(buckets: int):  # noqa: ANN202
    """From rows (q, n, g, gs, tokens): rows (bucket, size, cells), a bucket's tokens with all that _matrix needs to know of them.

    Cells are (token, step of q, n, place in q's order, g - q, gs); steps and differences may wrap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("tokens")).to_numpy() // TOKEN_BYTES
            q, n, g, gs = (b.column(c).to_numpy().astype(np.int64) for c in ("q", "n", "g", "gs"))
            for i, j in runs(sizes.tolist(), CELLS):
                token = _wide(np.frombuffer(b"".join(b.column("tokens").slice(i, j - i).to_pylist()), np.uint8))
                ends = np.cumsum(sizes[i:j])
                doc, at = np.repeat(np.arange(i, j), sizes[i:j]), np.arange(len(token)) - np.repeat(ends - sizes[i:j], sizes[i:j])
                of = token & (buckets - 1)
                order = np.argsort(of, kind="stable")
                of, token, doc, at = of[order], token[order], doc[order], at[order]
                lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
                stop = np.concatenate((lead[1:], [len(of)])) if len(of) else of
                cells = []
                for x, y in zip(lead, stop, strict=True):
                    d = doc[x:y]
                    cells.append(_packed(np.stack([token[x:y], np.diff(q[d], prepend=0), n[d], at[x:y], g[d] - q[d], gs[d]])))
                yield pa.RecordBatch.from_arrays([pa.array(of[lead], pa.int32()), pa.array(stop - lead, pa.int32()), pa.array(cells, pa.binary())], names=["bucket", "size", "cells"])

    return run


def prefix_tokens(texts: DataFrame, side: DataFrame, fits: bool, k: int, percent: int, levels: np.ndarray, buckets: int) -> DataFrame:
    """Rows (bucket, size, cells) of the prefix tokens of the documents in side (__m, g, gs), as _deal packs them.

    Where side isn't small enough for a broadcast, the prefixes move to it, not the texts.
    """
    ids, few = (side, True) if fits else small(side.select("__m").distinct())
    if few:
        texts = texts.join(ids, F.col("id") == F.col("__m"), "left_semi")
    own = texts.where("id is not null").mapInArrow(_prefixes(k, percent, levels), "q long, n int, tokens binary")
    placed = own.join(side, F.col("q") == F.col("__m")).select("q", "n", "g", "gs", "tokens")
    return placed.mapInArrow(_deal(buckets), "bucket int, size int, cells binary")


def _matrix(percent: int):  # noqa: ANN202
    """From rows of _deal sorted by bucket: (q, n, g) for each token of q that another group's prefix union holds; q is of the smaller group."""

    def fits(n: np.ndarray, rest: np.ndarray, other: np.ndarray, other_rest: np.ndarray, spare: int = 0) -> np.ndarray:
        """Can this be one of the first shared tokens of a link? Of the first slack() ones, each leaves room for the rest of the overlap."""
        least, most = np.minimum(n, other).astype(np.int64), np.maximum(n, other).astype(np.int64)
        overlap = -((-percent * (least + most)) // (100 + percent))
        return (100 * least >= percent * most) & (np.minimum(rest, other_rest) + slack(least) + spare >= overlap)

    def pairs(q: np.ndarray, n: np.ndarray, rest: np.ndarray, g: np.ndarray, gs: np.ndarray) -> list[np.ndarray]:
        """One token's rows. A row meets each other group once, if a member of the group could fit."""
        order = np.lexsort((n, g))
        q, n, rest, g, gs = q[order], n[order], rest[order], g[order], gs[order]
        lead = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        own, size = g[lead], gs[lead]
        stop = np.concatenate((lead[1:], [len(g)]))
        out = []
        for x in range(len(own)):  # group x as the larger one
            ask = np.flatnonzero((gs < size[x]) | ((gs == size[x]) & (g > own[x])))
            if not len(ask):
                continue
            there = n[lead[x] : stop[x]]
            low = np.searchsorted(there, (percent * n[ask].astype(np.int64) + 99) // 100)
            ask, low = ask[low < len(there)], low[low < len(there)]
            # the smallest member that is large enough needs the least overlap; the group's largest rest allows the most
            ask = ask[fits(n[ask], rest[ask], there[low], np.full(len(ask), rest[lead[x] : stop[x]].max()), 1)]  # 1: of rounding
            out.append(np.stack([q[ask], n[ask].astype(np.int64), np.full(len(ask), own[x])]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, q, n, at, g, gs = np.concatenate(parts, axis=1)
            order = np.argsort(token, kind="stable")
            token = token[order]
            again = token[1:] == token[:-1]
            twice = np.concatenate((again, [False])) | np.concatenate(([False], again))
            order, token = order[twice], token[twice]
            q, n, rest, g, gs = q[order], n[order], (n - 1 - at)[order], g[order], gs[order]  # rest: tokens that come later in q's order
            if not len(token):
                return
            lead = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            stop = np.concatenate((lead[1:], [len(token)]))
            mixed = np.minimum.reduceat(g, lead) != np.maximum.reduceat(g, lead)
            two = lead[mixed & (stop - lead == 2)]
            swap = (gs[two] > gs[two + 1]) | ((gs[two] == gs[two + 1]) & (g[two] < g[two + 1]))
            a, b = np.where(swap, two + 1, two), np.where(swap, two, two + 1)  # a asks, b is of the larger group
            fit = fits(n[a], rest[a], n[b], rest[b])
            out = [np.stack([q[a[fit]], n[a[fit]].astype(np.int64), g[b[fit]]])]
            for x in np.flatnonzero(mixed & (stop - lead > 2)):
                part = slice(lead[x], stop[x])
                out += pairs(q[part], n[part], rest[part], g[part], gs[part])
            rows = np.concatenate(out, axis=1)
            for lo in range(0, rows.shape[1], 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(r[lo : lo + (1 << 17)]) for r in rows], names=["q", "n", "g"])

        held, last = [], None
        for b in batches:
            for bucket, size, cells in zip(*(b.column(c).to_pylist() for c in ("bucket", "size", "cells")), strict=True):
                if held and bucket != last:
                    yield from emit(held)
                    held = []
                part, last = _unpacked(cells, 6, size), bucket
                part[1] = np.cumsum(part[1])
                part[4] += part[1]
                held.append(part)
        if held:
            yield from emit(held)

    return run


def compare(queries: list[np.ndarray], members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(query, member) of all links of a block. The block stays closed to a query of which its union holds too few tokens."""
    union, owner = np.concatenate(members) if members else np.zeros(0, np.uint64), np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(union, kind="stable")
    union, owner = union[order], owner[order]
    token, count = _counts(union)
    lead = np.cumsum(count) - count
    size = np.array([len(m) for m in members], np.int64)
    out = []
    for i, s in enumerate(queries):
        at = np.minimum(np.searchsorted(token, s), max(0, len(token) - 1))
        at = at[token[at] == s] if len(token) else at[:0]
        if not len(s) or len(at) < need(len(s), percent):
            continue
        c = count[at]
        rows = np.repeat(lead[at] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(owner[rows], minlength=len(members))
        out += [(i, int(m)) for m in np.flatnonzero(100 * both >= percent * (len(s) + size - both))]
    return out


def _open(k: int, percent: int):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        ids, asks, texts = group.column("id").to_pylist(), group.column("asks").to_pylist(), group.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], asks[i], texts[i] or ""))
        own = sets([texts[i] for i in order], k)
        q, m = ([x for x, i in enumerate(order) if asks[i] is want] for want in (True, False))
        root = {ids[i]: ids[i] for i in order}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        touched = set()
        for a, b in compare([own[x] for x in q], [own[x] for x in m], percent):
            a, b = ids[order[q[a]]], ids[order[m[b]]]
            touched |= {a, b}
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in sorted(touched)]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    return run


def _blocks(rows: DataFrame, *by: str) -> DataFrame:
    """(by, nb): into how many blocks the documents of a group are cut, by their number and by their shingles."""
    return rows.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("n") / SIDE_SHINGLES)).cast("int").alias("nb"))


def _links(tasks: DataFrame, texts: DataFrame, k: int, percent: int, by: list[str]) -> DataFrame:
    """Links (a, b), a spanning set of each block, for tasks (by, id, asks); each block brings its texts once."""
    side, fits = small(tasks.withColumnRenamed("id", "__id"))
    if not fits:
        ids, _ = small(side.select(F.col("__id").alias("__t")).distinct())
        texts = texts.join(ids, F.col("id") == F.col("__t"), "left_semi")
    rows = texts.join(side, F.col("id") == F.col("__id")).select(*by, "id", "asks", "text")
    return rows.groupBy(*by).applyInArrow(_open(k, percent), "a long, b long").where("a <> b").distinct()


def open_leaders(candidates: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between candidates (q, n, g) and the leaders g of their groups; a group's candidates are cut into blocks."""
    blocks, _ = small(_blocks(candidates, "g").withColumnRenamed("g", "__g"))
    ask = candidates.join(blocks, F.col("g") == F.col("__g")).select("g", F.pmod(F.xxhash64("q"), F.col("nb")).cast("int").alias("s"), F.col("q").alias("id"), F.lit(True).alias("asks"))
    lead = blocks.select(F.col("__g").alias("g"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("s"), F.col("__g").alias("id"), F.lit(False).alias("asks"))
    return _links(ask.union(lead), texts, k, percent, ["g", "s"])


def open_groups(candidates: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b), a spanning set of each block, between candidates (q, n, g) and members (g, m, n).

    Members of a group are cut into size classes and those into blocks, queries of a group into blocks as well; a task
    is one block against another, and each brings its texts once.
    """
    base = -math.log(percent / 100 - 0.001)
    level = F.floor(F.log(F.col("n").cast("double")) / base).cast("int")
    asked, _ = small(_blocks(candidates, "g").select(F.col("g").alias("__g"), F.col("nb").alias("nq")))
    mine = members.join(asked, F.col("g") == F.col("__g")).select("g", "m", "n", level.alias("level"), "nq")
    per, _ = small(_blocks(mine, "g", "level"))
    mine = mine.join(per, ["g", "level"]).select("g", "level", F.pmod(F.xxhash64("m"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("s"), F.col("m").alias("id"), F.lit(False).alias("asks"))
    ask = candidates.join(asked, F.col("g") == F.col("__g")).select("g", "q", F.explode(F.array(level - 1, level, level + 1)).alias("level"), F.pmod(F.xxhash64("q"), F.col("nq")).cast("int").alias("s"))
    ask = ask.join(per, ["g", "level"]).select("g", "level", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), "s", F.col("q").alias("id"), F.lit(True).alias("asks"))
    return _links(mine.join(ask.select("g", "level", "b", "s").distinct(), ["g", "level", "b", "s"], "left_semi").union(ask), texts, k, percent, ["g", "level", "b", "s"])


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two rows link if 100 x intersection >= percent x union of their k-word shingles.

    Null, empty and wordless texts: no shingles, linked with nothing, their own component. Equal texts under many ids
    are one class, so groups of copies cost one member. Rows that repeat an id are nodes of one document: their
    components are one. Null ids link with nothing and have a null component. Other columns are left out, whatever
    their names; an empty table gives no rows. Whole texts; no link between different sets is lost.
    """
    if not 10 <= percent <= 100:
        raise ValueError("percent must be from 10 to 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    raw = cut(texts.mapInArrow(_sketch(k), "id long, n long, digest binary, keys array<long>, tokens binary, counts binary"))
    rows = raw.select("id", "n", "digest")
    # sets this small link only with equal sets
    least = next(n for n in range(1, 1001) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
    known = raw.where("id is not null and n > 0")
    classes = cut(known.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys")))
    large = classes.where(F.col("n") >= least).select("rep", "n", "keys")

    # groups
    keyed = large.select("rep", "n", F.posexplode("keys").alias("j", "key")).repartition("j", "key")  # rows are slimmer than partial leaders
    firsts = [F.min(F.struct(F.col("rep").bitwiseXOR(F.lit(m)).alias("x"), "n")) for m in LEADERS]
    firsts = F.array_distinct(F.array(*(F.struct(f["x"].bitwiseXOR(F.lit(m)).alias("g"), f["n"].alias("gn")) for f, m in zip(firsts, LEADERS, strict=True))))
    leaders = keyed.groupBy("j", "key").agg(firsts.alias("gs"), F.count("*").alias("c")).where("c > 1").select("j", "key", "gs")
    agree = keyed.join(leaders, ["j", "key"]).select("rep", "n", F.inline("gs")).where("rep <> g")
    agree = agree.where(100 * F.least("n", "gn") >= percent * F.greatest("n", "gn"))  # by size alone the others can't link
    near = agree.groupBy("rep", "n", "g").count().where(F.col("count") >= AGREE).select(F.col("rep").alias("q"), "n", "g")
    sizes = large.groupBy("rep").agg(F.max("n").alias("n"))
    grouped = components(open_leaders(cut(near), texts, k, percent))
    nodes = cut(sizes.join(grouped, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("m"), "n", F.coalesce("component", "rep").alias("g")))
    counts = nodes.groupBy("g").agg(F.count("*").alias("gs")).select(F.col("g").alias("__g"), "gs")
    side, fits = small(nodes.join(counts, F.col("g") == F.col("__g")).select(F.col("m").alias("__m"), "g", "gs"))
    levels = token_levels(raw)

    # the matrix, and what qualifies
    tokens = nodes.agg(F.sum(F.col("n") * (101 - percent) / 100 + 2)).first()[0]
    prefixes = prefix_tokens(texts, side, fits, k, percent, levels, 1 << max(8, (int(tokens or 0) // BUCKET_CELLS).bit_length()))
    hits = prefixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_matrix(percent), "q long, n long, g long")
    least_n = F.floor((F.col("n") * percent + 99) / 100)
    found = hits.groupBy("q", "n", "g").count().where(F.col("count") >= F.floor(least_n / SLACK) + 1).select("q", "n", "g")
    found = cut(found)
    second = open_groups(found, nodes.select("g", "m", "n"), texts, k, percent)

    # repeated ids with different texts tie their classes together
    reps = known.select("id", "digest").join(classes.select("digest", "rep"), "digest")
    ties = reps.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    every = components(nodes.select(F.col("m").alias("a"), F.col("g").alias("b")).where("a <> b").union(second).union(ties))
    named = classes.select(F.col("digest").alias("__d"), "rep").join(every, F.col("rep") == F.col("node"), "left").select("__d", F.coalesce("component", "rep").alias("__c"))
    out = rows.join(named, (F.col("digest") == F.col("__d")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("__c", "id").alias("component_id"))
