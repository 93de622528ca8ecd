"""Operators on pairs against brute force."""

import pathlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, embed_dedup, entry_queries, jaccard_join
from lexmill.llm.common import components

from .conftest import LONG, SF


def roots(nodes, links):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1)]
    real = [x for x in links if x[0] is not None]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in real for x in p}, real)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in real)}


def shingle_set(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, percent):
    own = {i: shingle_set(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(own, 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    return {i: (len(s), roots(own, links)[i]) for i, s in own.items()}


def family(seed):
    """Near copies at similarities around the threshold, shared passages, and texts without relatives."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 12, 60, 150, 400]))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        out.append(" ".join(base + passage))
        out.append(" ".join(passage + base[:20]))
    return [*enumerate(out)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 4, 85), (1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_jaccard(docs, seed, k, percent):
    rows = family(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_jaccard_of_all(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in entry_queries.op8_ngram_jaccard_join(spark, SF).collect()} == brute(rows, 4, 85)


def test_jaccard_without_broadcasts(docs, odd, monkeypatch):
    measured = jaccard_join.small
    monkeypatch.setattr(jaccard_join, "small", lambda df: measured(df, 0))
    rows = family(3) + [(1000 + i, t) for i, t in odd if i is not None and i != 4]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs([*rows, (None, "nobody")])).where("doc_id is not null").collect()}
    assert got == brute(rows, 4, 85)


def shuffled(spark):
    """Bytes written to shuffles, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_matrix_moves_little(spark, docs):
    """Below 10 bytes a token with its document and group."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))) for i in range(400)]
    texts = docs(rows).coalesce(1).select(F.col("doc_id").alias("id"), "text").checkpoint()
    side = F.broadcast(texts.select(F.col("id").alias("__m"), F.col("id").alias("g"), F.lit(1).alias("gs")))
    tokens = 400 * (597 - jaccard_join.need(597, 85) + jaccard_join.slack(597))
    dealt = jaccard_join.prefix_tokens(texts, side, True, 4, 85, np.zeros(1 << jaccard_join.CLASS_BITS, np.uint8), 8).repartition("bucket")
    assert sum(r["size"] for r in dealt.select("size").collect()) == tokens
    was = shuffled(spark)
    assert dealt.mapInArrow(jaccard_join._matrix(85), "q long, n long, g long").count() == 0
    assert sum(v for k, v in shuffled(spark).items() if k not in was) < 10 * tokens


def test_matrix_from_packed_tokens():
    """Any ids pack, in several pieces; tokens that share their low bytes only are met as well."""
    import pyarrow as pa

    low, far = 7, 7 + (1 << 8 * jaccard_join.TOKEN_BYTES)
    rows = [(2**63 - 1, 6, -(2**63), 2, [low, 1]), (-(2**63), 6, -(2**63), 2, [2, low]), (5, 6, 5, 1, [far, 3]), (6, 6, 6, 1, [4])]
    q, n, g, gs, tokens = zip(*rows)
    narrow = [jaccard_join._narrow(np.array(t, np.uint64)) for t in tokens]
    placed = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 2], t) for x, t in ((q, pa.int64()), (n, pa.int32()), (g, pa.int64()), (gs, pa.int64()), (narrow, pa.binary()))], names=["q", "n", "g", "gs", "tokens"]) for i in (0, 2)]
    dealt = pa.Table.from_batches(jaccard_join._deal(256)(iter(placed))).sort_by("bucket")
    assert sum(dealt["size"].to_pylist()) == 7
    got = [r for b in jaccard_join._matrix(85)(iter(dealt.to_batches())) for r in zip(*(b.column(c).to_pylist() for c in ("q", "n", "g")))]
    assert got == [(5, 6, -(2**63))]


def test_leaders_of_other_sizes_are_not_asked(docs, monkeypatch):
    """A text inside one twice as long agrees on minima, but is no candidate of its group."""
    asked, real = [], jaccard_join.open_leaders
    monkeypatch.setattr(jaccard_join, "open_leaders", lambda near, *a: asked.extend(map(tuple, near.collect())) or real(near, *a))
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:200])), (3, " ".join([*words[:199], "x"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(rows)).collect()}
    assert got == brute(rows, 4, 85)
    assert asked and all({q, g} == {2, 3} for q, _, g in asked)


def test_jaccard_edges(docs, odd):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(docs(odd)).collect())
    assert len(got) == len(odd)
    assert [x for x in got if x[0] in ("1", "2", "3")] == [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3")]
    assert [x for x in got if x[0] == "4"] == [("4", 1, "4")] * 2 and [x for x in got if x[0] == "6"][0][2] == "5"
    assert sorted(x[1:] for x in got if x[0] == "None") == [(0, "None"), (1, "None")]
    assert jaccard_join.jaccard_components(docs([])).count() == 0


def test_jaccard_repeated_id(docs):
    got = jaccard_join.jaccard_components(docs([(5, "a b c d e"), (2, "a b c d e"), (5, "v w x y z"), (9, "v w x y z")])).collect()
    assert {r.component_id for r in got} == {2}


def test_near_duplicate_stage_keeps_texts_compressed(spark, docs):
    """What the stage leaves in the shared folder is below half of the texts."""
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    disk = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    rng, before = random.Random(9), disk()
    rows = [(i, " ".join(f"word{rng.randrange(3000)}" for _ in range(3000))) for i in range(150)] + [(200, None), (None, "")]
    left = corpus_pipeline.near_duplicate_stage(spark, docs([*rows, (300, rows[0][1])]), "")
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, _ in rows)
    assert disk() - before < sum(len(t or "") for _, t in rows) / 2


def test_large_group_of_near_copies(docs):
    """More members than a block holds, and an outsider that links with one of them."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    near = rows[599][1].split()
    near[0] = near[-1] = "y"
    rows += [(700, " ".join(near)), (701, "nothing like it at all my friend")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(rows)).collect()}
    want = brute(rows, 4, 85)
    assert got == {k: v[1] for k, v in want.items()}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, digest string").repartition(3)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for j in range(15):
            rows.append((len(rows), (centre + rng.standard_normal(32) * (0.01, 0.03, 0.06)[j % 3]).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [2 * x for x in rows[1][1]])]
    got = {r.vec_id: r for r in embed_dedup.vector_links(vectors(spark, rows)).collect()}
    v = np.array([np.array(x, np.float32).astype(float) for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    ids = [i for i, _ in rows]
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(1)))
    assert found >= 0.97 * near.sum()
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert np.mean([got[i].component_id == want[i] for i in ids]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("n", [500, 2000, 8000])
def test_bucket_pairs_of_a_vector_do_not_grow(n):
    """Random vectors: pairs a vector in all buckets stay at the stated bound, and the stated chance is that of the hash."""
    tables, k = embed_dedup.plan(n, 0.9)
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    h = embed_dedup.Hasher(64, tables, k)
    keys = np.sort(h.keys(v), axis=0)
    pairs = 0
    for column in keys.T:
        size = np.diff(np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1], [True]))))
        pairs += (size * (size - 1)).sum()
    assert pairs / n <= 2 * embed_dedup.RANDOM_PAIRS
    side = rng.standard_normal((n, 64))
    side -= (side * v).sum(1)[:, None] * v
    near = 0.9 * v + np.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1)[:, None]
    assert np.mean((h.keys(v) == h.keys(near)).any(1)) > 0.95


def test_embedding_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.01]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.vector_links(vectors(spark, rows)).collect())
    assert got == sorted([*((str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 10)), ("7", 3, "7", True), ("7", 3, "7", True), ("8", 3, "7", False), ("9", 3, "7", False), ("None", 0, "None", False)])
    assert embed_dedup.vector_links(vectors(spark, [])).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    """Buckets of several blocks, and runs beyond what a task holds, give the same."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 2] + rng.standard_normal(8) * 0.02).tolist()) for i in range(120)]
    want = sorted(map(tuple, embed_dedup.vector_links(vectors(spark, rows), tables=6, projections=4).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    assert sorted(map(tuple, embed_dedup.vector_links(vectors(spark, rows), tables=6, projections=4).collect())) == want
    assert {r[1] for r in want} == {59}


def test_decontamination(spark, docs):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((40, 25, 18, 6))] + [(4, "solo"), (8, None), (9, ""), (None, " ".join(rng.choice(words) for _ in range(30)))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    text = dict(items)

    def noise(n):
        return " ".join(f"n{rng.randrange(999)}" for _ in range(n))

    def changed(t, step):
        return " ".join("zz" if i % step == step - 1 else w for i, w in enumerate(t.split()))

    rows = [(0, noise(50) + " " + text[0].upper() + ", " + noise(9)), (1, changed(text[0], 7)), (2, changed(text[1], 5)), (3, " ".join(text[0].split()[10:26])), (4, noise(80)), (5, text[3] + " x"), (6, " ".join(text[1].split()[:8])), (7, None), (8, ""), (9, text[2] + " " + text[2]), (None, text[None]), (None, text[None]), (11, LONG + text[1]), (12, "a Solo song")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs(rows), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 0), (5, 3), (9, 2), (None, None), (11, 1), (12, 4)}
    assert (got[0, 0].doc_start, got[0, 0].n_tokens, got[0, 0].n_equal) == (50, 40, 40) and got[9, 2].doc_start == 0
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(docs(rows), bench).collect()) == ["4", "6", "7", "8"]
    assert decontaminate.overlaps(docs([]), bench).count() == 0 and decontaminate.overlaps(docs(rows), bench.where("false")).count() == 0


def windows(words, tokens, shift):
    """Most equal tokens of a window along one alignment that is long and equal enough, None without one."""
    e = [tokens[j + shift] == w if 0 <= j + shift < len(tokens) else None for j, w in enumerate(words)]
    sums = [(sum(e[a:b]), b - a) for a in range(len(e)) for b in range(a + min(13, len(e)), len(e) + 1) if None not in e[a:b]]
    return max((n for n, size in sums if 5 * n >= 4 * size), default=None)


def test_decontamination_with_changes_anywhere(spark, docs):
    """Items of 12 to 20 tokens with changes at every position or pair of positions, against all windows."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (12, 13, 15, 20)}
    places = [(n, p) for n in items for p in combinations(range(n), 1)] + [(13, p) for p in combinations(range(13), 2)] + [(15, (2, 7, 12)), (20, (0, 1, 18, 19)), (20, (0, 1, 2, 17, 18, 19)), (20, tuple(range(0, 20, 3)))]
    rows, want = [], {}
    for i, (n, p) in enumerate(places):
        tokens = [f"x{k}" for k in range(i % 3)] + ["zz" if k in p else w for k, w in enumerate(items[n])] + ["y"] * (i % 2)
        rows.append((i, " ".join(tokens)))
        if (best := windows(items[n], tokens, i % 3)) is not None:
            want[i] = (n, best)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontaminate.overlaps(docs(rows), bench).collect()
    assert {r.doc_id: (r.item_id, r.n_equal) for r in got} == want and len(got) == len(want) < len(rows)
    assert all(r.n_tokens >= min(13, r.item_id) and 5 * r.n_equal >= 4 * r.n_tokens for r in got)


def test_decontamination_seeds(spark):
    """All places of all masks, none of null or too short lists; equal seeds only for equal tokens under the mask."""
    rng = random.Random(8)
    rows = dict(enumerate([None, [], [1], [1, 1], [2, 1] * 3, [*range(9)], [*range(10)], [rng.randrange(3) for _ in range(400)]]))
    df = spark.createDataFrame(list(rows.items()), "k long, hashes array<long>")
    masks = [*decontaminate.MASKS, "1", "111111"]
    got = decontaminate._seed_rows(df, ["k"], masks).collect()
    want = sorted((k, i, (m, *(h[i + j] for j, c in enumerate(mask) if c == "1"))) for k, h in rows.items() if h for m, mask in enumerate(masks) for i in range(len(h) - len(mask) + 1))
    assert sorted((r.k, r.pos) for r in got) == [x[:2] for x in want]
    assert len({r.seed for r in got}) == len({x[2] for x in want})
    pairs = Counter(Counter(r.seed for r in got).values()), Counter(Counter(x[2] for x in want).values())
    assert pairs[0] == pairs[1]


def test_decontamination_seeds_are_compiled(spark, docs):
    """No plan that the operator runs makes seeds inside a lambda, which Spark interprets token by token."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "solo")], "item_id long, text string")
    assert decontaminate.overlaps(docs([(1, "a " + bench.first().text), (2, "b solo")]), bench).count() == 2
    bus.waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size())) if e.executionId() not in seen]
    seeds = [line for plan in plans for line in plan.splitlines() if re.search(r"xxhash64\(hashes", line)]
    assert len(seeds) > 1 and not [line for line in seeds if "lambda" in line]


def test_decontamination_of_all(spark):
    found = {(r.doc_id, r.item_id) for r in entry_queries.op5_benchmark_decontamination(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text} <= found


def test_pipeline(spark):
    """Each stage against its operator's own rows, and the whole against the sequence of stages."""
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
        docs, names = kept, name
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()} and names
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_stages_with_odd_rows(spark, docs, odd):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, []):
            assert stage(spark, docs(rows), SF).count() <= (len(rows) if name != "packing" else 10**6), name


def test_quality_stage_drops_what_the_classifier_rejects(spark, docs):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    model = corpus_pipeline.crf_quality.train(base, spark.read.parquet(f"{SF}/labels.parquet"))
    want = corpus_pipeline.crf_quality.quality(base, model).where("predicted = 1")
    assert sorted(r.doc_id for r in corpus_pipeline.quality_stage(spark, base, SF).collect()) == sorted(r.doc_id for r in want.collect())


def test_stages_decide_by_row(spark, docs):
    """Null and repeated ids: a bad row takes no other with it, and of exact repeats one stays."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item), (None, "clean one two three four five"), (7, item), (7, "other six seven eight nine ten"), (8, "p q r s t u v"), (8, "p q r s t u v"), (None, "P q r s t u v")]
    left = corpus_pipeline.decontamination_stage(spark, docs(rows), SF)
    assert sorted(str(r.doc_id) + r.text[:5] for r in left.collect()) == ["7other", "8p q r", "8p q r", "NoneP q r", "Noneclean"]
    once = corpus_pipeline.near_duplicate_stage(spark, docs(rows), SF)
    assert sorted(str(r.doc_id) + r.text[:5] for r in once.collect()) == sorted(["7" + item[:5], "7other", "8p q r", "Noneclean"])
