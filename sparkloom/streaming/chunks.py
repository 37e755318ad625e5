"""Anchored time chunks of a stream of log lines: a chunk begins at its first event and lasts a fixed span."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "doc_id long, chunk long, start timestamp, n long"


def chunk_stream(lines: DataFrame, seconds: int) -> DataFrame:
    """``lines``: a stream of (doc_id, ts). Emits a chunk when an event past its end arrives; a document's open chunk is its only state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, anchor, n = state.get if state.exists else (0, None, 0)
        out = []
        for ts in pd.concat(batches)["ts"].sort_values():
            at = int(ts.timestamp() * 1_000_000)
            if anchor is not None and at - anchor >= seconds * 1_000_000:
                out.append((key[0], chunk, pd.Timestamp(anchor, unit="us"), n))
                chunk, anchor, n = chunk + 1, at, 0
            anchor, n = at if anchor is None else anchor, n + 1
        state.update((chunk, anchor, n))
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "start", "n"])

    return lines.groupBy("doc_id").applyInPandasWithState(run, SCHEMA, "chunk long, anchor long, n long", "append", GroupStateTimeout.NoTimeout)
