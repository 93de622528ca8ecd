"""Quality by a linear-chain conditional random field over the lines of a document.

Labels are of documents, the field's are of lines. A line starts with its document's label. So that chains change label,
the field is also fitted on spliced chains: a run of lines of a document of one label inside a document of the other,
each line with the label it came with. After a first fit, lines that contradict their document's label clearly take the
other one, as long as lines with the document's label keep the larger part of its length; then the field is fitted anew.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, text_blocks

#: Labelled documents that the model is fitted on at most: those with the smallest hash of their id; and their lines at
#: most, so that the one task that fits holds no more (a document that would exceed them is left out of the fit).
TRAIN_DOCS, TRAIN_LINES = 4000, 100_000
#: Chance, by a first fit, of its document's label below which a line takes the other label.
CONTRADICTS = 0.05
BLOCK_CHARS = 300_000
BASE = ("upper", "symbol", "bar", "digit", "stop", "bang", "twin", "copies", "words", "short", "seen", "length", "foreign", "other", "comma")
N_BASE = len(BASE)
N_FEATURES = 3 * N_BASE + 3


def _classes() -> np.ndarray:
    """Class of each code point below 2**16: 0 space, 1 lower, 2 upper, 3 digit, 4 bar, 5 bang, 6 stop, 7 comma, 8 symbol, 9 other."""
    out = np.full(65537, 9, np.uint8)
    for i in range(65536):
        kind = unicodedata.category(chr(i))
        out[i] = 0 if chr(i).isspace() else 2 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 3 if kind[0] == "N" else 8 if kind[0] in "PS" else 9
    for i, chars in ((4, "|"), (5, "!?"), (6, ".:;"), (7, ",'’-\"()")):
        out[[ord(x) for x in chars]] = i
    out[65536] = 1  # beyond the basic plane
    return out


_tables: dict[str, np.ndarray] = {}


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables:
        rng = np.random.default_rng(7)
        _tables["class"] = _classes()
        mix = rng.integers(1, 2**63, 65537, np.int64).astype(np.uint64) | np.uint64(1)
        mix[_tables["class"] == 0] = 0
        _tables["mix"], _tables["power"] = mix, rng.integers(1, 2**63, 64, np.int64).astype(np.uint64) | np.uint64(1)
    return _tables["class"], _tables["mix"], _tables["power"]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines of each text) of the lines that have more than white space; a text without any has one empty line."""
    cls_of, mix, power = _table()
    joined = "\n".join(texts) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 65536)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n_lines = len(ends)
    last = np.cumsum([len(t) + 1 for t in texts]) - 1  # where each text's own end of line stands
    doc_of = np.searchsorted(last, ends)
    line_of = np.repeat(np.arange(n_lines), ends - starts + 1)
    cls = cls_of[codes]
    counts = np.bincount(line_of * 10 + cls, minlength=n_lines * 10).reshape(n_lines, 10).astype(np.float64)
    foreign = np.bincount(line_of, weights=codes > 127, minlength=n_lines)
    solid = cls != 0
    first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    words = np.zeros(n_lines)
    twin = np.zeros(n_lines)
    copies = np.zeros(n_lines)
    line_hash = np.zeros(n_lines, np.uint64)
    if len(first):
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.concatenate((first, [len(codes)]))))[: len(codes)] if first[0] == 0 else np.concatenate((np.zeros(first[0], np.int64), np.arange(first[0], len(codes)) - np.repeat(first, np.diff(np.concatenate((first, [len(codes)]))))))
        h = np.add.reduceat(mix[codes] * power[place & 63], first)
        at = line_of[first]
        words = np.bincount(at, minlength=n_lines).astype(np.float64)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (at[1:] == at[:-1])))
        twin = np.bincount(at, weights=same, minlength=n_lines)
        key = h * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key, kind="stable")
        copies = np.bincount(at[order], weights=np.concatenate(([False], key[order][1:] == key[order][:-1])), minlength=n_lines)
        lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        inner = np.arange(len(at)) - np.repeat(lead, np.diff(np.concatenate((lead, [len(at)]))))
        line_hash[at[lead]] = np.add.reduceat(h * power[inner & 63], lead)
    full = words > 0
    key = line_hash + doc_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    seen = np.zeros(n_lines)
    seen[order] = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    length = counts[:, 1:].sum(1)
    letters = counts[:, 1] + counts[:, 2]
    per_char, per_word = 1 / np.maximum(length, 1), 1 / np.maximum(words, 1)
    x = np.stack([counts[:, 2] / np.maximum(letters, 1), counts[:, 8] * per_char * 3, counts[:, 4] * per_word, counts[:, 3] * per_char * 2, counts[:, 6] * per_word, counts[:, 5] * per_word, twin * per_word, copies * per_word, np.log1p(words) / 5, words < 4, seen, length * per_word / 10, foreign * per_char, counts[:, 9] * per_char, counts[:, 7] * per_word], 1)
    x = np.minimum(x, 3)
    n_full = np.bincount(doc_of, weights=full, minlength=len(texts)).astype(np.int64)
    keep = full | ((n_full[doc_of] == 0) & np.isin(np.arange(n_lines), np.searchsorted(ends, last)))
    return x[keep], np.maximum(length[keep], 1), np.maximum(n_full, 1)


def with_neighbours(x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after within its document, and a constant and two flags for the ends."""
    start = np.cumsum(n_lines) - n_lines
    out = np.zeros((len(x), N_FEATURES))
    out[:, :N_BASE] = x
    out[1:, N_BASE : 2 * N_BASE] = x[:-1]
    out[:-1, 2 * N_BASE : 3 * N_BASE] = x[1:]
    end = start + n_lines - 1
    out[start, N_BASE : 2 * N_BASE] = 0
    out[end, 2 * N_BASE : 3 * N_BASE] = 0
    out[start, -3] = 1
    out[end, -2] = 1
    out[:, -1] = 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the label good against bad, the four transition scores (from, to), and the calibration of the score."""

    weights: np.ndarray
    moves: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, n_lines: np.ndarray, pairs: bool = False):  # noqa: ANN201
        """P(good) of each line by forward-backward; with pairs also the log of Z and the expected moves of each document."""
        start, emit = np.cumsum(n_lines) - n_lines, x @ self.weights
        order = np.argsort(-n_lines, kind="stable")
        start, n = start[order], n_lines[order]
        live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # documents with a line t
        e = np.stack([np.zeros_like(emit), emit], 1)
        fore, back = e.copy(), np.zeros_like(e)
        lse = np.logaddexp
        for t in range(1, len(live)):
            at = start[: live[t]] + t
            p = fore[at - 1]
            fore[at, 0] += lse(p[:, 0] + self.moves[0, 0], p[:, 1] + self.moves[1, 0])
            fore[at, 1] += lse(p[:, 0] + self.moves[0, 1], p[:, 1] + self.moves[1, 1])
        for t in range(len(live) - 1, 0, -1):
            at = start[: live[t]] + t
            q = back[at] + e[at]
            back[at - 1, 0] = lse(q[:, 0] + self.moves[0, 0], q[:, 1] + self.moves[0, 1])
            back[at - 1, 1] = lse(q[:, 0] + self.moves[1, 0], q[:, 1] + self.moves[1, 1])
        both = fore + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        if not pairs:
            return good
        z = np.repeat(lse(*both[np.cumsum(n_lines) - n_lines].T), n_lines)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(n_lines) - n_lines] = False
        to = np.flatnonzero(inner)
        expected = np.array([[np.exp(fore[to - 1, a] + self.moves[a, b] + e[to, b] + back[to, b] - z[to]).sum() for b in (0, 1)] for a in (0, 1)])
        return good, z[np.cumsum(n_lines) - n_lines].sum(), expected

    def score(self, x: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, calibrated."""
        if not len(n_lines):
            return np.zeros(0)
        start = np.cumsum(n_lines) - n_lines
        mean = np.add.reduceat(self.marginals(with_neighbours(x, n_lines), n_lines) * length, start) / np.add.reduceat(length, start)
        m = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale * np.log(m / (1 - m)) + self.shift)))


def splice(x: np.ndarray, length: np.ndarray, n_lines: np.ndarray, line_good: np.ndarray, good: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, labels, lines of each chain): each document once with a run of lines of a document of the other label put into it.

    rows are indices of lines; a run is at most as long as the document that takes it.
    """
    rng = np.random.default_rng(seed)
    start = np.cumsum(n_lines) - n_lines
    sides = [np.flatnonzero(good == side) for side in (False, True)]
    rows, sizes = [], []
    for d in range(len(n_lines)):
        other = sides[0 if good[d] else 1]
        o = other[rng.integers(len(other))]
        k = int(rng.integers(1, min(n_lines[o], n_lines[d]) + 1))
        begin, at = start[o] + int(rng.integers(0, n_lines[o] - k + 1)), start[d] + int(rng.integers(0, n_lines[d] + 1))
        rows.append(np.concatenate((np.arange(start[d], at), np.arange(begin, begin + k), np.arange(at, start[d] + n_lines[d]))))
        sizes.append(len(rows[-1]))
    rows = np.concatenate(rows)
    return rows, line_good[rows], np.array(sizes, np.int64)


def _climb(f: np.ndarray, y: np.ndarray, n_lines: np.ndarray, theta: np.ndarray, steps: int, decay: float) -> np.ndarray:
    """Penalised likelihood of line labels y in chains. Full-batch Adam, so ties and order play no part."""
    to = np.ones(len(f), bool)
    to[np.cumsum(n_lines) - n_lines] = False
    to = np.flatnonzero(to)
    seen = np.bincount(2 * y[to - 1].astype(int) + y[to].astype(int), minlength=4).astype(np.float64)
    m, v = 0.0, 0.0
    for step in range(1, steps + 1):
        p, _, expected = Field(theta[:-4], theta[-4:].reshape(2, 2)).marginals(f, n_lines, pairs=True)
        grad = (np.concatenate((f.T @ (p - y), expected.ravel() - seen)) + decay * theta) / len(n_lines)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def fit(x: np.ndarray, length: np.ndarray, n_lines: np.ndarray, good: np.ndarray, steps: int = 120, decay: float = 2.0) -> Field:
    """A field of lines, fitted as the module says, and the calibration of its document score."""
    if len(set(good.tolist())) < 2:
        base = 0.0 if not len(good) else (4.0 if good[0] else -4.0)
        return Field(np.concatenate((np.zeros(N_FEATURES - 1), [base])), np.zeros((2, 2)))
    start = np.cumsum(n_lines) - n_lines
    own, theta = np.repeat(good, n_lines), np.zeros(N_FEATURES + 4)
    y = own.copy()
    for turn in range(2):
        rows, labels, sizes = splice(x, length, n_lines, y, good)
        chains = np.concatenate((with_neighbours(x, n_lines), with_neighbours(x[rows], sizes)))
        theta = _climb(chains, np.concatenate((y, labels)).astype(np.float64), np.concatenate((n_lines, sizes)), theta, steps, decay)
        if turn == 0:
            p = Field(theta[:-4], theta[-4:].reshape(2, 2)).marginals(chains[: len(x)], n_lines)
            turned = np.where(own, p, 1 - p) < CONTRADICTS
            kept = np.add.reduceat(np.where(turned, 0, length), start) > np.add.reduceat(length, start) / 2
            y = own ^ (turned & np.repeat(kept, n_lines))
    model = Field(theta[:-4], theta[-4:].reshape(2, 2))
    # calibration of the aggregated score on the same rows, both labels with one weight, since bad documents are few
    share = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    s = np.clip(model.score(x, length, n_lines), 1e-6, 1 - 1e-6)
    z, a, b = np.log(s / (1 - s)), 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q, w = share * (p - good), share * p * (1 - p) + 1e-6
        g = np.array([(q * z).mean() + 1e-3 * (a - 1), q.mean() + 1e-3 * b])
        h = np.array([[(w * z * z).mean() + 1e-3, (w * z).mean()], [(w * z).mean(), w.mean() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
        if np.abs(move).max() < 1e-6:
            break
    return Field(model.weights, model.moves, float(max(a, 0.05)), float(b))


def held_out(column: str = "doc_id"):  # noqa: ANN201
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field fitted on at most `most` labelled documents with `most_lines` lines outside the held-out fold.

    Features are made where the documents are and go to one task that fits; the driver gets the weights alone. Null
    labels and ids are left out; of repeated labels of one id the largest holds. Without rows of both labels the score
    is constant.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = chosen.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, rank = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, j, texts in text_blocks(b.column(1), BLOCK_CHARS):
                x, length, n = line_features([t or "" for t in texts])
                at = np.cumsum(n) - n
                rows = [(y[i + d], rank[i + d], x[a : a + k].astype(np.float32).tobytes(), length[a : a + k].astype(np.float64).tobytes()) for d, (a, k) in enumerate(zip(at, n, strict=True)) if k <= most_lines]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["y", "rank", "x", "len"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of rank; of one document given twice all rows count."""
        rows, lines = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) < most and lines + len(r[3]) // 8 <= most_lines:
                    rows.append(r)
                    lines += len(r[3]) // 8
        model = _fit_rows([(y, x, n) for y, _, x, n in rows])
        yield pa.RecordBatch.from_pydict({"field": pa.array([np.concatenate((model.weights, model.moves.ravel(), [model.scale, model.shift])).tolist()], pa.list_(pa.float64()))})

    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # most rows
    rows = found.select("__y", "__text", F.xxhash64("__id").alias("__rank")).mapInArrow(run, "y int, rank long, x binary, len binary")
    weights = rows.repartition(1).sortWithinPartitions("rank", "y", "x", "len").mapInArrow(one, "field array<double>").collect()  # one row
    if not weights:
        return _fit_rows([])
    w = np.array(weights[0][0])
    return Field(w[:-6], w[-6:-2].reshape(2, 2), float(w[-2]), float(w[-1]))


def _fit_rows(rows: list[tuple[int, bytes, bytes]]) -> Field:
    if not rows:
        return fit(np.zeros((0, N_BASE)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    n = np.array([len(r[2]) // 8 for r in rows])
    return fit(np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, N_BASE).astype(np.float64), np.frombuffer(b"".join(r[2] for r in rows)), n, np.array([r[0] > 0 for r in rows]))


def line_marginals(text: str, model: Field) -> np.ndarray:
    """P(good) of each line of a text that has more than white space."""
    x, _, n = line_features([text])
    return model.marginals(with_neighbours(x, n), n)


def score_texts(texts: list[str], model: Field) -> np.ndarray:
    return np.concatenate([model.score(*line_features(texts[i:j])) for i, j in runs([len(t) for t in texts], BLOCK_CHARS)] or [np.zeros(0)])


def quality(docs: DataFrame, model: Field, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; whole texts, one pass, no shuffle.

    Null and empty texts count as one empty line. Null ids: a row with held_out false. Repeated rows stay; other
    columns are left out; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([score_texts([t or "" for t in texts], model) for _, _, texts in text_blocks(b.column(1), BLOCK_CHARS)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Field, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at least the threshold: one pass, decided row by row whatever the ids."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([score_texts([t or "" for t in texts], model) for _, _, texts in text_blocks(b.column(at), BLOCK_CHARS)] or [np.zeros(0)])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
