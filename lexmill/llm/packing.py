"""Harmonic packing of token ids into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_blocks
from .pretokens import encoder, vocabulary_path

BLOCK_BYTES = 1_000_000
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def encode_block(texts: list[str], name: str, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text, then end_id."""
    enc, end = encoder(vocabulary_path(name)), int(end_id).to_bytes(4, "little")
    cut = [enc.pieces(t) for t in texts]
    ids = enc.learn_ids(set().union(*(c for c in cut if c)))
    get = ids.__getitem__
    return [(np.asarray(enc.whole(t), "<u4").tobytes() if c is None else b"".join(map(get, c))) + end for t, c in zip(texts, cut, strict=True)]


#: Classes of a worker: 1 / (k + 1) to 1 / k of the capacity for k below CLASSES; all shorter pieces are one class more.
CLASSES = 24
#: Closed bins of a worker that wait with a gap for a further document; the longest gap goes first when there are more.
WAITING = 64


class Harmonic:
    """The bins of one worker.

    A document over the capacity gives whole sequences first; what is left is one piece. A piece that fits into the gap
    of a closed bin goes there whole (the smallest such gap). Else it joins the bin of its class, which closes at k
    pieces; a bin of the last class closes before the first piece that does not fit. A closed bin that is not full
    waits for further documents, and if too many wait the head of the next document is cut off for the longest gap. So
    a document is cut at capacities and at most once more, except for the few pieces that are open at the end: those
    fill the gaps that are left, one after the other. What then remains becomes sequences whose lengths are powers of
    two. Nothing is padded, and what a worker holds is at most CLASSES + WAITING bins.
    """

    def __init__(self, capacity: int, worker: int) -> None:
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.capacity, self.next = capacity, worker << 40
        self.open: dict[int, list[tuple]] = {}
        self.gaps: list[tuple] = []  # (room, order, pieces), by room

    def put(self, doc, coded: bytes) -> list[tuple]:  # noqa: ANN001
        view, total, out, at = memoryview(coded), len(coded) // 4, [], 0
        if len(self.gaps) >= WAITING:
            room, order, mine = self.gaps.pop()
            at = min(room, total)
            out += self._wait([*mine, (doc, 0, at, view[: 4 * at], total)], order)
        while total - at >= self.capacity:
            out += self._emit([(doc, at, self.capacity, view[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        n = total - at
        return out + self._place((doc, at, n, bytes(view[4 * at :]), total)) if n else out

    def _place(self, piece: tuple) -> list[tuple]:
        n = piece[2]
        if (i := bisect_left(self.gaps, (n,))) < len(self.gaps):
            _, order, mine = self.gaps.pop(i)
            return self._wait([*mine, piece], order)
        k, out = min(self.capacity // n, CLASSES), []
        mine = self.open.setdefault(k, [])
        if k == CLASSES and sum(p[2] for p in mine) + n > self.capacity:
            out, mine = self._wait(mine), []
        mine.append(piece)
        self.open[k] = mine
        if k < CLASSES and len(mine) == k or sum(p[2] for p in mine) == self.capacity:
            out += self._wait(self.open.pop(k))
        return out

    def _wait(self, mine: list[tuple], order: int | None = None) -> list[tuple]:
        """A closed bin: a sequence if it is full, else one more gap."""
        mine = [(*p[:3], bytes(p[3]), p[4]) for p in mine]
        room = self.capacity - sum(p[2] for p in mine)
        if not room:
            return self._emit(mine)
        if order is None:
            order, self.next = self.next, self.next + 1
        insort(self.gaps, (room, order, mine))
        return []

    def _emit(self, mine: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, n, ids, total in mine:
            out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """Sequences of all that is open: the fullest bins are filled up from open pieces, then from the emptiest bins."""
        loose = [p for k in sorted(self.open) for p in self.open[k]][::-1]
        out, self.open = [], {}
        while self.gaps:
            room, _, mine = self.gaps.pop(0)
            while room and (loose or self.gaps):
                if not loose:
                    loose = self.gaps.pop()[2][::-1]
                mine.append(self._head(loose, room))
                room -= mine[-1][2]
            if room:
                loose = mine[::-1]
            else:
                out += self._emit(mine)
        left = sum(p[2] for p in loose)
        while left:
            size = room = min(self.capacity, 1 << (left.bit_length() - 1)) if left < self.capacity else self.capacity
            mine = []
            while room:
                mine.append(self._head(loose, room))
                room -= mine[-1][2]
            out += self._emit(mine)
            left -= size
        return out

    @staticmethod
    def _head(loose: list[tuple], room: int) -> tuple:
        """The next open piece, or if it is longer than room its head; the other part stays."""
        doc, start, n, ids, total = loose.pop()
        if n > room:
            loose.append((doc, start + room, n - room, ids[4 * room :], total))
        return (doc, start, min(n, room), ids[: 4 * min(n, room)], total)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each worker fills bins of one reciprocal class of the capacity with its fixed number of documents, independently of
    all other workers: one pass, no shuffle. Documents stay whole where they can; see Harmonic for those that are cut,
    so that no sequence is padded. Null text is empty and so one end id; null and repeated ids give each row its own pieces; other columns
    are left out; an empty table gives no rows; texts of any length are whole. sequence_id is the task's number and a
    counter, so a task that runs again gives the same.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Harmonic(capacity, TaskContext.get().partitionId())

        def out(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, like if i == 0 else pa.int64()) for i, c in enumerate(cols)], names=[id_col, *COLUMNS[1:]])

        like = None
        for b in batches:
            like, ids = b.schema.field(0).type, b.column(0).to_pylist()
            for i, j, texts in text_blocks(b.column(1), BLOCK_BYTES):
                rows = [r for doc, coded in zip(ids[i:j], encode_block([t or "" for t in texts], tokenizer, end_id), strict=True) for r in bins.put(doc, coded)]
                if rows:
                    yield out(rows, like)
        if like is not None and (rows := bins.rest()):
            yield out(rows, like)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
