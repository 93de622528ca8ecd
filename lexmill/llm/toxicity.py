"""Toxicity grades by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, text_blocks, texts_of

#: Labelled documents that the model is fitted on at most, for each label: those with the smallest hash of their id.
TRAIN_DOCS = 2500
#: Distinct words of a document that the fit takes at most, and of all of them together, so that the one task that fits holds no more.
TRAIN_WORDS, TRAIN_TOTAL = 50_000, 2_000_000
#: A word is a feature if it is in so many fitted documents of a label and its log odds ratio is so many standard errors from 0.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Besides the word itself its beginnings of these lengths are features, so that inflected forms share a weight.
BEGINNINGS = (3, 4, 5, 6)
#: Distinct words that a worker remembers the features of; beyond it the memory starts anew.
REMEMBERED = 200_000
BLOCK_BYTES = 1_000_000


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def count_features(words: dict[str, int]) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        for f in features(w):
            out[f] += n
    return out


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(weights . log(1 + count) - thresholds[k]); one weight of a feature for all thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    def above(self, total: np.ndarray) -> np.ndarray:
        z = np.clip(np.subtract.outer(total, np.array(self.thresholds)), -40, 40)
        return 1 / (1 + np.exp(-z))

    def total(self, text: str) -> float:
        known, hits = self._known, Counter()
        for w, n in Counter(WORDS.findall(text.lower())).items():
            found = known.get(w)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[w] = tuple(f for f in features(w) if f in self.weights)
            for f in found:
                hits[f] += n
        return float(sum(self.weights[f] * np.log1p(n) for f, n in sorted(hits.items())))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int], grade: np.ndarray, steps: int = 600, decay: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the penalised cumulative-link likelihood; the features are a sparse matrix in coordinates."""
    n, d = shape
    k = int(grade.max(initial=0))
    if k == 0:
        return np.zeros(d), np.array([8.0])
    theta, m, v = np.concatenate((np.zeros(d), [2.0], np.zeros(k - 1))), 0.0, 0.0
    for step in range(1, steps + 1):
        w, cut = theta[:d], theta[d] + np.concatenate(([0], np.cumsum(np.exp(theta[d + 1 :]))))
        t = np.bincount(row, weights=val * w[col], minlength=n)
        s = np.hstack((np.ones((n, 1)), _sigmoid(np.subtract.outer(t, cut)), np.zeros((n, 1))))  # P(grade >= 0 .. k + 1)
        p = np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-12)
        slope = s * (1 - s)  # of each cumulative probability
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        g_t = -(up - down)
        g_cut = np.bincount(grade, weights=up, minlength=k + 1)[1:] - np.bincount(grade, weights=down, minlength=k + 1)[:-1]
        steps_of = np.exp(theta[d + 1 :])
        g_theta = np.concatenate(([g_cut.sum()], [g_cut[i + 1 :].sum() * steps_of[i] for i in range(k - 1)]))
        grad = np.concatenate((np.bincount(col, weights=val * g_t[row], minlength=d) + decay * w, g_theta)) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate(([0], np.cumsum(np.exp(theta[d + 1 :]))))


def fit(bags: list[dict[str, int]], label: list[int], grades: int = 2, keys: list[tuple[int, ...]] | None = None, odds_shift: float = 0.0) -> Ordinal:
    """A model of documents as word counts. label: a grade of 0 or more.

    Where labels are only 0 and 1 and more grades are asked for, the rows with label 1 are graded 1 .. grades by
    quantiles of how often features with a positive log odds ratio occur in them; ties go to the lower grade.
    Of rows of one label that share any of their keys (near copies) the first counts. odds_shift: log of how much
    rarer label 1 is outside than among the rows fitted on.
    """
    first, met = [], set()
    for i, (k, y) in enumerate(zip(keys or [(i,) for i in range(len(bags))], label, strict=True)):
        own = {(j, x, y > 0) for j, x in enumerate(k)}
        if not own & met:
            first.append(i)
        met |= own
    bags, y = [bags[i] for i in first], np.array([label[i] for i in first], np.int64)
    toxic, clean = Counter(), Counter()
    for b, k in zip(bags, y, strict=True):
        (toxic if k else clean).update(count_features(b).keys())
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return Ordinal({}, (8.0,) if n0 or not n1 else (-8.0,))
    odds = {}
    for w in toxic.keys() | clean.keys():
        a, b = toxic[w], clean[w]
        if max(a, b) >= LEAST_DOCS:
            z = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
            if abs(z) >= LEAST_Z * np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5)):
                odds[w] = float(z)
    bags = [{f: n for f, n in count_features(b).items() if f in odds} for b in bags]  # features anew, so that only those used are held
    words = sorted(odds)
    at = {w: i for i, w in enumerate(words)}
    if y.max() == 1 and grades > 1:
        amount = np.array([sum(n for w, n in b.items() if odds.get(w, 0) > 0) for b in bags])
        bounds = np.quantile(amount[y == 1], np.arange(1, grades) / grades)
        y = np.where(y == 1, 1 + (amount[:, None] > bounds[None, :]).sum(1), 0)
        _, y = np.unique(y, return_inverse=True)  # grades without rows fall away
    cells = [(i, at[w], np.log1p(n)) for i, b in enumerate(bags) for w, n in b.items() if w in at]
    row, col, val = (np.array(x) for x in zip(*cells, strict=True)) if cells else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weights, cut = fit_ordinal(row, col, val, (len(bags), len(words)), y)
    return Ordinal({w: float(x) for w, x in zip(words, weights, strict=True)}, tuple(float(x) + odds_shift for x in cut))


def copy_keys(words: list[str]) -> tuple[int, ...]:
    """Four minima of hashed word triples; near copies share some, other texts hardly ever."""
    hashes = {zlib.crc32(" ".join(t).encode("utf-8", "replace")) for t in zip(words, words[1:] or [""], words[2:] or [""], strict=False)}
    return tuple(min(((h ^ m) * 0x9E3779B1 % 2**32 for h in hashes), default=i) for i, m in enumerate((0, 0x5BD1E995, 0x1B873593, 0x2545F491)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, grades: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """A model fitted on at most 2 x `most` labelled documents: of each label those with the smallest hash of their id.

    Words are counted where the documents are and go to one task that fits; the driver gets the weights alone.
    Documents of more than TRAIN_WORDS distinct words are left out of the fit. Null labels and ids are left out; of
    repeated labels of one id the largest holds.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y"))
    rank = (F.xxhash64("__id"), "__id")
    chosen = known.where("__y > 0").orderBy(*rank).limit(most).union(known.where("__y <= 0").orderBy(*rank).limit(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [WORDS.findall(t.lower()) for t in texts_of(b.column(1))]
            rows = [(y, rank, copy_keys(w), " ".join(x), np.array([*x.values()], np.uint32).tobytes()) for y, rank, w, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), words, map(Counter, words), strict=True) if len(x) <= TRAIN_WORDS]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["y", "rank", "keys", "words", "counts"])

    n_of = {r[0]: r[1] for r in known.groupBy(F.col("__y") > 0).count().collect()}  # two rows

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of rank."""
        rows, total = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) < 2 * most and total + len(r[4]) // 4 <= TRAIN_TOTAL:
                    rows.append(r)
                    total += len(r[4]) // 4
        rows.sort(key=lambda r: (r[0], r[3], r[4]))
        here = sum(r[0] > 0 for r in rows)
        shift = float(np.log(here / (len(rows) - here) * n_of[False] / n_of[True])) if 0 < here < len(rows) else 0.0
        bags = [dict(zip(r[3].split(" ") if r[3] else [], np.frombuffer(r[4], np.uint32).tolist(), strict=True)) for r in rows]
        model = fit(bags, [max(0, r[0]) for r in rows], grades, [tuple(r[2]) for r in rows], shift)
        yield pa.RecordBatch.from_arrays([pa.array([[*model.weights]], pa.list_(pa.string())), pa.array([[*model.weights.values()]], pa.list_(pa.float64())), pa.array([list(model.thresholds)], pa.list_(pa.float64()))], names=["words", "weights", "thresholds"])

    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # 2 x most rows
    rows = found.select("__y", "__text", F.xxhash64("__id").alias("__rank")).mapInArrow(run, "y int, rank long, keys array<long>, words string, counts binary")
    got = rows.repartition(1).sortWithinPartitions("rank", "y", "words", "counts").mapInArrow(one, "words array<string>, weights array<double>, thresholds array<double>").collect()  # one row
    if not got:
        return fit([], [], grades)
    return Ordinal(dict(zip(got[0]["words"], got[0]["weights"], strict=True)), tuple(got[0]["thresholds"]))


def toxicity(docs: DataFrame, model: Ordinal, threshold: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row: expected grade, likeliest grade (ties: the lower), and P(grade > 0) >= threshold.

    Null and empty texts have no words and so the grade of the thresholds alone. Null ids and repeated rows stay; other
    columns are left out; an empty table gives no rows. Whole texts, one pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(np.array([model.total(t or "") for _, _, texts in text_blocks(b.column(1), BLOCK_BYTES) for t in texts]))
            each = np.hstack((np.ones((len(above), 1)), above)) - np.hstack((above, np.zeros((len(above), 1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= threshold)], names=[id_col, "severity", "grade", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Ordinal, threshold: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with P(grade > 0) below the threshold: one pass, decided row by row whatever the ids."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(np.array([model.total(t or "") for _, _, texts in text_blocks(b.column(at), BLOCK_BYTES) for t in texts]))
            yield b.filter(pa.array(above[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)
