"""Items from chunks: each stream's unread tail is state, whole items leave as soon as their end has come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def split_stream(chunks: DataFrame, end: str, key: str = "stream_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(key, item_seq, item) of a streaming DataFrame (key long, order long, chunk string).

    Chunks of a stream may come in any order; they are read in the order of `order`, from 0 without gaps. State holds
    the tail that has no end yet and chunks that came too early.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, next_seq, done, early = state.get if state.exists else ("", 0, 0, "{}")
        waiting = {int(a): b for a, b in json.loads(early).items()}
        for f in frames:
            waiting.update({int(s): c for s, c in zip(f[order], f[chunk], strict=True) if int(s) >= next_seq and c is not None})
        while next_seq in waiting:
            tail += waiting.pop(next_seq)
            next_seq += 1
        *items, tail = tail.split(end)
        state.update((tail, next_seq, done + len(items), json.dumps(waiting)))
        yield pd.DataFrame({key: [k[0]] * len(items), "item_seq": range(done, done + len(items)), "item": items})

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} long, item_seq long, item string", "tail string, next_seq long, done long, early string", "append", GroupStateTimeout.NoTimeout)
