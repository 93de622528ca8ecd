"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_blocks
from .pretokens import encoder, vocabulary_path

#: Bytes of a block, within which pre-tokens are made distinct before they are counted.
BLOCK_BYTES = 2_000_000


def count_block(texts: list[str], name: str) -> list[int]:
    """Tokens of each text.

    The block's distinct pre-tokens get their sizes once, from the library; each document has a table of its
    pre-token frequencies; the join of both is summed. No ids of a document come into being.
    """
    enc = encoder(vocabulary_path(name))
    tables: list[Counter | None] = []
    for text in texts:
        pieces = enc.pieces(text)
        tables.append(None if pieces is None else Counter(pieces))
    sizes = enc.learn_sizes(set().union(*(t for t in tables if t)))
    get = sizes.__getitem__
    return [len(enc.whole(x)) if t is None else sum(map(int.__mul__, map(get, t), t.values())) for x, t in zip(texts, tables, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, tokens as the file's own library counts them.

    Null text: as empty, 0 tokens. Null or repeated ids: a row for each row. Other columns are left out, whatever
    their names. Empty table: no rows. Long texts are whole. One pass over the scan, no shuffle, so a hot key or a
    lost executor costs nothing but the task itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [n for _, _, texts in text_blocks(b.column(1), BLOCK_BYTES) for n in count_block([t or "" for t in texts], tokenizer)]
            n = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
