"""Prefixes of shingle sets, rarest shingles first, by document counts that a sample of the documents gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

#: One document in SAMPLE_ONE_IN, up to about SAMPLE_ROWS documents, is counted to learn which shingles are frequent; HOT_SHINGLES of them
#: are kept. They only order the prefixes: any order gives the same links, a good one fewer candidates.
SAMPLE_ONE_IN, SAMPLE_ROWS, HOT_SHINGLES = 16, 1_000_000, 200_000
#: Expected candidates from a prefix above which a link must share 2, and 3, prefix tokens.
COSTS = (64, 1024)


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their estimated document counts; at most HOT_SHINGLES."""
    rows = docs.count()
    one_in = max(SAMPLE_ONE_IN, -(-rows // SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            for lo, hi in vec.slices(offsets):
                flat, _ = vec.distinct(vec.Words(data, offsets[lo : hi + 1], vec.NOT_SPACE), width)
                yield pa.RecordBatch.from_arrays([pa.array(vec.signed(flat))], ["h"])

    few = docs.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(one_in)) == 0).select("text")
    top = few.mapInArrow(run, "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(HOT_SHINGLES).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64) * one_in
    order = np.argsort(h)
    return h[order], n[order]


class Rarity:
    """Estimated document counts of shingles; 0 for those that aren't frequent."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, flat: np.ndarray) -> np.ndarray:
        df = np.zeros(len(flat), np.int64)
        if len(self.hashes):
            some = np.flatnonzero(self.maybe[(flat >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, flat[some]), len(self.hashes) - 1)
            same = self.hashes[at] == flat[some]
            df[some[same]] = self.counts[at[same]]
        return df


def rare_first(flat: np.ndarray, offsets: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row by (count, hash), and the counts in that order. The rows come sorted by hash, so only frequent ones move, to the end."""
    hot = np.flatnonzero(df)
    if not len(hot):
        return flat, df
    row = np.searchsorted(offsets, hot, "right") - 1
    hot = hot[np.lexsort((df[hot], row))]
    n_hot = np.bincount(row, minlength=len(offsets) - 1)
    place = np.empty(len(flat), np.int64)
    rare = df == 0
    before = np.concatenate([[0], np.cumsum(rare)])  # rare ones before each place
    place[rare] = (before[:-1] + np.repeat(np.concatenate([[0], np.cumsum(n_hot)[:-1]]), np.diff(offsets)))[rare]
    place[hot] = vec.spread(offsets[1:] - n_hot, n_hot)
    out, counts = np.empty_like(flat), np.empty_like(df)
    out[place], counts[place] = flat, df
    return out, counts


def prefixes(flat: np.ndarray, offsets: np.ndarray, rarity: Rarity, percent: int, costs: tuple[int, ...] = COSTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ell, tokens, offsets): how many prefix tokens a link of each row must share (1 without ``costs``), and the row's prefix, rarest first."""
    h, df = rare_first(flat, offsets, rarity(flat))
    n, start = np.diff(offsets), offsets[:-1]
    need = -(-percent * n // 100)  # any partner shares so many
    cost = np.concatenate([[0], np.cumsum(df)])
    want = np.ones(len(n), np.int64)
    for k, most in enumerate(costs, 1):
        grows = (want == k) & (want < need) & (n - need + want < n)
        at = np.flatnonzero(grows)
        end = start[at] + (n - need + want)[at]
        want[at[cost[end] - cost[start[at]] > most]] += 1
    size = np.minimum(n - need + want, n)
    return want, h[vec.spread(start, size)], np.concatenate([[0], np.cumsum(size)])


def with_prefixes(items: DataFrame, rarity: Rarity, percent: int) -> DataFrame:
    """(node, tokens) of ``items`` (node, items), where a link shares one token of each prefix."""
    shared = items.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("items")
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            _, tokens, offsets = prefixes(flat, ends, shared.value, percent, ())
            yield pa.RecordBatch.from_arrays([b.column("node"), vec.lists(tokens, offsets)], ["node", "tokens"])

    return items.mapInArrow(run, "node long, tokens array<long>")
