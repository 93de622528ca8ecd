"""Operators that give a row for each row: edge cases, and the libraries or brute force they must agree with."""

import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm import crf_quality, entry_queries, html_extract, license_scan, packing, sharding, token_counts, toxicity
from lexmill.llm.pretokens import Encoder, encoder, vocabulary_path

from .conftest import LONG, SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts(spark, docs, odd, library):
    got = token_counts.token_counts(docs(odd)).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(docs([])).count() == 0


def test_token_counts_of_all(spark, library):
    got = {r.doc_id: r.n_tokens for r in entry_queries.op10_token_counts(spark, SF).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts(spark).items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(docs, name):
    rows = [(1, "Hello world, hello"), (2, None)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(rows), name).collect()}
    assert got[1] == len(Encoder(vocabulary_path(name)).whole("Hello world, hello")) and got[2] == 0


def test_pieces_are_the_library_s(library):
    e = encoder(vocabulary_path("byte_bpe_50k.json"))
    for t in ("a  b\n\n c", "it's we'll 'S", "x²½ ª\xa0\xa0y ", "中文 العربية", "<|endoftext|>\n<|endoftext", "a\x0b\x85b", "​x", "  \t"):
        p = e.pieces(t)
        ids = e.whole(t) if p is None else [i for x in p for i in np.frombuffer(e.learn_ids({x})[x], "<u4")]
        assert ids == library.encode(t, add_special_tokens=False).ids, t


def check_packed(rows, want, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing(spark, docs, library):
    rows = [(1, None), (2, ""), (3, "one two three"), (5, LONG), (7, "<|endoftext|> x")]
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    check_packed(packing.pack(docs(rows)).collect(), want, 2048)
    check_packed(packing.pack(docs(rows), capacity=16).collect(), want, 16)
    assert packing.pack(docs([])).count() == 0
    assert packing.pack(docs([(None, "x"), (None, "x")])).count() >= 2


def test_harmonic_keeps_documents_whole():
    """Documents of a few hundred ids: few cuts, no padding, and what a worker holds is bounded."""
    rng = np.random.default_rng(2)
    bins, rows, want = packing.Harmonic(2048, 3), [], {}
    for doc in range(3000):
        n = int(rng.choice([1, 30, 200, 400, 900, 1500, 2048, 5000])) + int(rng.integers(0, 60))
        want[doc] = rng.integers(0, 50_000, n).astype("<u4")
        rows += bins.put(doc, want[doc].tobytes())
        assert len(bins.gaps) <= packing.WAITING + 1 and len(bins.open) <= packing.CLASSES
    rows += bins.rest()
    pieces = [SimpleNamespace(**dict(zip(packing.COLUMNS, r))) for r in rows]
    check_packed(pieces, {k: v.tolist() for k, v in want.items()}, 2048)
    one = Counter(r.doc_id for r in pieces)
    short = [d for d, v in want.items() if len(v) <= 2048]
    assert np.mean([one[d] == 1 for d in short]) > 0.7 and len(pieces) / len(want) < 2.5
    assert len({r.sequence_id for r in pieces}) <= sum(map(len, want.values())) // 2048 + 12


def test_packing_of_all(spark, library):
    check_packed(entry_queries.op7_packing(spark, SF).collect(), {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark).items()}, 2048)


def test_licenses(spark, docs, odd):
    mit = dict(license_scan.known_licenses()[::-1])["MIT"]
    rows = [*odd, (23, "The MIT License (MIT)\nCopyright 2001-2004 A. Body\n\n" + mit), (24, "program program licence while catalog center"), (25, "programme programme license whilst catalogue centre"), (20, "Copyright (c) 1999 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE")), (21, mit + " and more"), (22, "released UNDER the  mit licence")]
    got = license_scan.license_scan(docs(rows), license_scan.license_table(spark)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.license_id for r in got if r.doc_id and r.doc_id >= 20} == {20: "MIT", 21: None, 22: "MIT-line", 23: "MIT", 24: None, 25: None}
    assert len({r.digest for r in got if r.doc_id in (24, 25)}) == 1  # equivalent spellings next to one another
    assert all(r.license_id is None for r in got if r.doc_id is None or r.doc_id < 20)
    assert license_scan.license_scan(docs([]), license_scan.license_table(spark)).count() == 0


def test_known_licenses(spark):
    """Each known text is found by its own name, and no two licences share a digest."""
    known = license_scan.known_licenses()
    rows = [(i, "\ufeff" + text.replace("\n", "\r\n").upper()) for i, (_, text) in enumerate(known)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.license_scan(df, license_scan.license_table(spark)).collect()}
    assert [got[i] for i in range(len(known))] == [name for name, _ in known]
    assert len({name for name, _ in known}) >= 25


@pytest.mark.parametrize("name", ["op1_license_scans", "op6_sharding"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = entry_queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({entry_queries.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


def test_sharding(docs, odd):
    rows = [*odd, *((i, "w" * (i % 50)) for i in range(100, 400))]
    got = sharding.shard(docs(rows), 500).collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    for r in got:
        assert len(r.shard) == r.depth
        by[r.shard] += r.n_bytes
    for s, total in by.items():
        keys = {r.doc_id for r in got if r.shard == s and r.n_bytes}
        assert total <= 500 or len(keys) == 1
    assert not any(a != b and b.startswith(a) for a in by for b in by)  # prefixes partition the keys
    deep = {s[:-1] for s in by if s}
    assert all(sum(v for k, v in by.items() if k.startswith(p)) > 500 for p in deep)  # only oversized buckets split
    assert sharding.shard(docs([]), 500).count() == 0
    assert {r.shard for r in sharding.shard(docs([(1, "a"), (2, None)]), 500).collect()} == {""}


def test_pages_hold_the_limit(docs):
    """One key with most rows, and a row over the limit: every page is within the limit or has one row."""
    sizes = [(7, "w" * (i * 37 % 200)) for i in range(400)] + [(7, "x" * 5000), (None, "y" * 1500), (None, "z" * 900), (3, "a")]
    got = sharding.shard(docs(sizes), 2000).collect()
    assert len(got) == len(sizes)
    pages = defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r.n_bytes)
    assert all(sum(v) <= 2000 or len(v) == 1 for v in pages.values())
    assert len(pages) <= 2 * sum(len(t) for _, t in sizes) // 2000 + 4


def test_shard_files(spark, docs, tmp_path):
    rows = [(i, "w" * 20) for i in range(60)]
    assigned = sharding.write_shards(docs(rows), str(tmp_path / "s"), 300)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 60 and sorted(r.doc_id for r in back.collect()) == [*range(60)]
    odd_ids = [(1, "a"), (1, "b"), (None, "c"), (None, "c")]
    sharding.write_shards(docs(odd_ids), str(tmp_path / "t"), 300)
    assert sorted(str(r.doc_id) + r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["1a", "1b", "Nonec", "Nonec"]
    assert assigned.select("shard").distinct().count() == back.select("shard").distinct().count() > 1


def test_quality_by_brute_force():
    """Marginals of short chains against the sum over all labellings."""
    rng = np.random.default_rng(1)
    n = np.array([1, 4, 3])
    x = rng.standard_normal((8, crf_quality.N_FEATURES))
    model = crf_quality.Field(rng.standard_normal(crf_quality.N_FEATURES) * 0.3, rng.standard_normal((2, 2)))
    got, e, start = model.marginals(x, n), x @ model.weights, 0
    for k in n:
        total, good = 0.0, np.zeros(k)
        for code in range(2**k):
            y = [code >> i & 1 for i in range(k)]
            w = np.exp(sum(e[start + i] * y[i] for i in range(k)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[start : start + k], good / total)
        start += k


def test_quality(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = crf_quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    scored = crf_quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    got = crf_quality.quality(docs(odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert crf_quality.quality(docs([]), model).count() == 0
    alone = crf_quality.score_texts(["A b.\nC d."], model)
    assert np.allclose(crf_quality.score_texts(["x", "A b.\nC d.", ""], model)[1], alone)
    flat = crf_quality.train(docs([]), labels)
    assert set(crf_quality.score_texts(["a", "b c"], flat).tolist()) == {0.5}


def test_quality_labels_lines(spark):
    """A good document with a block of junk in it: low marginals in the block, high ones elsewhere."""
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    model = crf_quality.train(docs, spark.read.parquet(f"{base}/labels.parquet"))
    held = docs.join(spark.read.parquet(f"{base}/labels.parquet").where("toxic = 0"), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").orderBy("doc_id").collect()
    junk = [x for r in held if not r.quality for x in r.text.split("\n") if x.count("!!") + x.count("***") + x.count("$$$") > 5][:12]
    good = [[x for x in r.text.split("\n") if len(x.split()) > 3] for r in held if r.quality]
    inside, outside = [], []
    for lines in [g for g in good if len(g) >= 6][:12]:
        p = crf_quality.line_marginals("\n".join([*lines[:3], *junk[:3], *lines[3:6]]), model)
        inside += p[3:6].tolist()
        outside += [*p[:3].tolist(), *p[6:9].tolist()]
    assert len(junk) >= 3 and np.mean(inside) < 0.4 and np.mean(outside) > 0.8


def test_toxicity(spark, docs, odd):
    base = "/root/testdata/sf0.01"
    labels, table = spark.read.parquet(f"{base}/labels.parquet"), spark.read.parquet(f"{base}/documents.parquet")
    model = toxicity.train(table, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = toxicity.toxicity(docs(odd), model).collect()
    assert len(got) == len(odd) and len({r.severity for r in got if r.doc_id in (1, 2, 3)}) == 1
    rows = toxicity.toxicity(table, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r.toxic for r in rows if not r.label]
    assert np.mean(clean) < 0.03  # of 351 rows, some labelled clean by chance
    bad = re.compile(r"\b(?:idiot|clown|moron|pathetic|worthless|loser|disgusting|stupid|trash|scum)\b", re.I)
    words = {r.doc_id: len(bad.findall(r.text)) for r in table.collect()}
    assert np.mean([r.toxic for r in rows if words[r.doc_id] > 3]) > 0.9
    assert toxicity.toxicity(docs([]), model).count() == 0
    assert toxicity.train(docs([]), labels).weights == {}


def test_ordinal_gradient_finds_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 300)
    w, cut = toxicity.fit_ordinal(np.arange(300), np.zeros(300, int), x.astype(float), (300, 1), np.minimum(x, 2))
    assert w[0] > 0 and cut[0] < cut[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>{open}<h1>{title}</h1>
<p>First &amp; <b>bold</b>&nbsp;text<br>next line<p>Second   <i>par</i>agraph &#x41;{more}</p><form><input> Sign up <button>Go</button></form><div class="ad">Buy</div>
{close}<section class="comments"><p>Nice one!</p></section><aside>Side</aside><footer>Foot</footer></body></html>"""


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_html(spark, open_, close):
    rows = [(i, f"http://h.example/{i}", PAGE.format(open=open_, close=close, title=f"Title {i}", more=f" nr {i}")) for i in range(5)]
    rows += [(10, "http://h.example/n", None), (11, None, ""), (None, "http://o.example/", "plain <p>text</p>"), (12, "http://h.example/12", "<article><p>cut off <b>here")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, __host string, n_chars long")).collect()}
    for i in range(5):
        assert got[i].text == f"Title {i} First & bold text next line Second paragraph A nr {i}"
    assert got[10].text == "" and got[11].text == "" and got[12].text == "cut off here" and got[None].text == "plain text"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TOOLS = '<html><body><div class="a1"><p>{3}</p></div><{0}><h1>Head {1}</h1><div class="tool{2}"><p>Read more on our site</p></div><p>Same words</p><p>Body {1} of the text</p></{0}><div class="b1"><ul><li>{1}</li></ul></div></body></html>'


def test_html_template_text_of_articles(monkeypatch):
    """A box that recurs on all pages of a host leaves the article, a paragraph that recurs among others stays; without deduction the box stays."""
    pages = [html_extract.parse(TOOLS.format("article", i, "box", "Top")) for i in range(6)]
    want = [f"Head {i} Same words Body {i} of the text" for i in range(6)]
    assert html_extract.main_texts(pages) == want
    monkeypatch.setattr(html_extract, "deduce", lambda _: html_extract.Template())
    assert html_extract.main_texts(pages) == [w.replace(" Same", " Read more on our site Same") for w in want]


def test_html_by_template_alone(monkeypatch):
    """No article, main or telling names, and no element around the article: slots tell it from text that recurs and from short lists."""
    body = "".join(f"<p>{{0}} sentence {k} of the page and its story</p>" for k in range(6))
    page = '<body><div class="q1"><p>Our site</p><p>All rights</p></div><h1>On {0}</h1>' + body + '<div class="q2"><p>Terms and more</p></div></body>'
    pages = [html_extract.parse(page.format(f"w{i}")) for i in range(8)]
    want = [f"On w{i} " + " ".join(f"w{i} sentence {k} of the page and its story" for k in range(6)) for i in range(8)]
    assert html_extract.main_texts(pages) == want
    monkeypatch.setattr(html_extract, "deduce", lambda _: html_extract.Template())
    assert html_extract.main_texts(pages) != want


def test_html_classes_are_valid():
    """Against brute force: a class's tokens come in one order, time after time, within one slot of the class around it."""
    pages = [html_extract.parse("<body><h1>T</h1><ul>" + f"<li><b>x</b><i>{i}</i></li>" * n + f"</ul><p>p{i}</p></body>") for i, n in enumerate((2, 5, 3, 1))]
    t = html_extract.deduce(pages)
    assert len(t.classes) == 2 and t.parents[0] == (-1, 0) and t.parents[1][0] == 0
    for order, (parent, slot) in zip(t.classes, t.parents):
        for p in pages:
            seen = [x for x in p.tokens if x in order]
            assert seen == list(order) * (len(seen) // len(order))
            if parent >= 0:
                a, b = (p.tokens.index(t.classes[parent][slot + d]) for d in (0, 1))
                assert all(a < i < b for i, x in enumerate(p.tokens) if x in order)
    assert {x.split(">")[-1] for x in t.classes[1] if x[0] != "="} == {"li", "b", "i"}


def test_html_deep_nesting():
    page = html_extract.parse("<div>" * 20_000 + "deep" + "</div>" * 20_000)
    assert html_extract.main_texts([page]) == ["deep"]


def test_html_copies_keep_their_text(spark):
    page = PAGE.format(open="<article>", close="</article>", title="Same", more="")
    got = html_extract.extract(spark.createDataFrame([(i, "http://h.example/", page) for i in range(70)], "page_id long, url string, html string")).collect()
    assert len(got) == 70 and {r.text for r in got} == {"Same First & bold text next line Second paragraph A"}


@pytest.mark.parametrize("name", ["post category-social", "article has-comments", "widget", "related"])
@pytest.mark.parametrize("tag", ["article", "main", "div itemprop=articleBody"])
def test_html_names_dont_drop_articles(name, tag):
    """Names on an article, on what holds it, on headings and as a part of a name drop nothing."""
    end = tag.split()[0]
    page = f'<body><div class="site-content no-sidebar widget"><{tag} class="{name}"><h2 id="social">One</h2><section id="related-work"><p>Two</p></section><div class="ad">Buy</div></{end}></div><div class="widget">Out</div></body>'
    assert html_extract.main_texts([html_extract.parse(page)]) == ["One Two"]


def test_html_names_never_empty_a_page():
    pages = [html_extract.parse(f'<body><article><div class="widget"><p>Text {i}</p></div></article></body>') for i in range(3)]
    assert html_extract.main_texts(pages) == [f"Text {i}" for i in range(3)]


@pytest.mark.parametrize("other", ["", "<article>Else</article>"])
def test_html_div_layout_keeps_all_slots(other):
    """Headings, lists, tables and quotes that occur once a page, on a host without articles and beside one."""
    page = '<body><div class="top">Site</div><div class="content"><h1>H{0}</h1><p>P{0} is the longest text</p><p>Q{0}</p><h2>S{0}</h2><ul><li>L{0}</li></ul><table><tr><td>T{0}</td></tr></table><blockquote>B{0}</blockquote></div><div class="bottom">Bye</div></body>'
    bare = page.replace('<div class="content">', "").replace("</blockquote></div>", "</blockquote>")
    for html in (page, bare):
        got = html_extract.main_texts([html_extract.parse(h) for h in [html.format(i) for i in range(5)] + [other] * bool(other)])
        assert got[:5] == [f"H{i} P{i} is the longest text Q{i} S{i} L{i} T{i} B{i}" for i in range(5)]
