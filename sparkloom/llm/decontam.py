"""Benchmark decontamination: an FM-index for each shard of training text, searched backwards for the windows of the benchmark."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import discard, materialize
from .fmindex import FMIndex

#: Bytes of training text in a shard, words of the benchmark in a block, and blocks that a scan of the corpus searches for: the most that is broadcast at once.
SHARD_BYTES, BLOCK_WINDOWS, PASS_BLOCKS = 4_000_000, 200_000, 16


class Shard:
    """The FM-index of all words of some rows: each row a run of symbols, the numbers of its words in the shard's vocabulary from 1 on, and a separator."""

    def __init__(self, words: vec.Words):
        n, sizes = len(words.hash), np.diff(words.first)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        text = np.zeros(n + len(sizes), np.int64)
        text[np.arange(n) + self.row] = symbol + 1
        self.word = np.cumsum(text > 0) - 1  # of each place; that before it at a separator
        self.index = FMIndex(text) if n else None

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each word hash; 0 for a word that the shard lacks."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


class Windows:
    """The distinct windows of a block of items: a matrix of word numbers aligned right, and which items hold each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, offsets = vec.buffers(pa.array([t for _, t in items], pa.string()))
        words = vec.Words(data, offsets, vec.ALNUM)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        held: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.names = [name for name, _ in items]
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            s = symbol[a:b].tolist()
            for k in range(max(1, len(s) - width + 1) if s else 0):
                held[tuple(s[k : k + width])].add(i)
        self.items = [sorted(v) for v in held.values()]
        self.lengths = np.array([len(k) for k in held], np.int64)
        self.matrix = np.zeros((len(held), width), np.int32)
        for r, k in enumerate(held):
            self.matrix[r, width - len(k) :] = k

    def hits(self, shard: Shard) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(word mask, [(row, item)]): words of the shard inside an occurrence of a window, and the items whose windows occur in each row."""
        cover = np.zeros(len(shard.row) + 1, np.int64)
        if shard.index is None or not len(self.lengths):
            return cover[:-1] > 0, []
        named = shard.symbols(self.vocabulary)
        inside = np.arange(self.matrix.shape[1]) >= self.matrix.shape[1] - self.lengths[:, None]
        some = np.flatnonzero(((named[self.matrix] > 0) | ~inside).all(1))  # the others have a word that the shard lacks
        lo, hi = shard.index.search(np.where(inside[some], named[self.matrix[some]], 0), self.lengths[some])
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return cover[:-1] > 0, []
        count = (hi - lo)[found]
        at = shard.word[shard.index.locate(vec.spread(lo[found], count))]
        window = np.repeat(some[found], count)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[window], -1)
        seen = np.unique(shard.row[at] * len(self.items) + window)
        return np.cumsum(cover[:-1]) > 0, [(int(k // len(self.items)), i) for k in seen for i in self.items[k % len(self.items)]]


def blocks(benchmark: DataFrame, item_id: str, text: str, width: int) -> Iterator[Windows]:
    """The benchmark in blocks of about BLOCK_WINDOWS words, read one by one: the driver holds a block, whatever the benchmark's size."""
    items, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        items.append((r.i if r.i is not None else "", r.t))
        size += len(r.t.split())
        if size >= BLOCK_WINDOWS:
            yield Windows(items, width)
            items, size = [], 0
    if items:
        yield Windows(items, width)


def _passes(docs: DataFrame, windows: Iterator[Windows]) -> Iterator[list]:
    """Broadcasts of up to PASS_BLOCKS blocks each; at least one list, which is empty for no blocks."""
    held: list = []
    for w in windows:
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
        held.append(docs.sparkSession.sparkContext.broadcast(w))
    yield held


SPANS = "id long, n_words long, spans array<struct<first: int, last: int, from: int, until: int>>, items array<string>"


def _runs(mask: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the maximal runs of marked words of a row."""
    on = np.flatnonzero(mask)
    if len(on):
        cut = np.flatnonzero((np.diff(on) != 1) | (np.diff(row[on]) != 0))
        yield from zip(row[on[np.concatenate([[0], cut + 1])]].tolist(), on[np.concatenate([[0], cut + 1])].tolist(), on[np.concatenate([cut, [len(on) - 1]])].tolist(), strict=True)


def _scan(docs: DataFrame, shared: list) -> DataFrame:
    """For each row (id, n_words, spans, items, and row if ``docs`` has it): removal spans in word numbers and byte places, items sorted."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("from", pa.int32()), ("until", pa.int32())]))
    keep = [c for c in ("id", "row") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            for lo, hi in vec.slices(offsets, SHARD_BYTES):
                words = vec.Words(data, offsets[lo : hi + 1], vec.ALNUM)
                shard = Shard(words)
                mask = np.zeros(len(words.hash), bool)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for w in shared:
                    covered, pairs = w.value.hits(shard)
                    mask |= covered
                    for r, i in pairs:
                        items[r].add(w.value.names[i])
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                for r, a, z in _runs(mask, shard.row):
                    base, first = words.rows[r], words.first[r]
                    spans[r].append({"first": int(a - first), "last": int(z - first), "from": int(words.start[a] - base), "until": int(words.end[z] - base)})
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in keep], pa.array(np.diff(words.first), pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    [*keep, "n_words", "spans", "items"],
                )

    return docs.mapInArrow(run, SPANS.replace("n_words", "row long, n_words", 1) if "row" in keep else SPANS)


def _scanned(docs: DataFrame, shared: list) -> DataFrame:
    """``_scan`` as a table, after which the broadcasts are gone."""
    out = materialize(_scan(docs, shared))
    for w in shared:
        w.destroy()
    return out


def _merged(found: DataFrame) -> DataFrame:
    """The rows of several passes as one for each ``row``: spans that touch or overlap united, items together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans in b.column("spans").to_pylist():
                kept: list[dict] = []
                for s in sorted(spans, key=lambda s: s["first"]):
                    if kept and s["first"] <= kept[-1]["last"] + 1:
                        if s["last"] > kept[-1]["last"]:
                            kept[-1] |= {"last": s["last"], "until": s["until"]}
                    else:
                        kept.append(s)
                out.append(kept)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), pa.array(out, b.column("spans").type), b.column("items")], ["id", "n_words", "spans", "items"])

    g = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return g.drop("row").mapInArrow(run, SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, spans, items) for each row of ``docs``.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is ``width`` consecutive words of an item,
    or all of them if there are fewer. ``spans``: maximal runs of words inside an occurrence of a window, with the byte places where they begin
    and end; ``items``: ids, as strings and sorted, of the items with an occurring window. Null text has no words; null or wordless items match
    nothing; an empty benchmark gives no spans. Words are compared by 64-bit hashes. Each row gives one row, repeated rows and null ids too,
    however many blocks the benchmark makes: up to PASS_BLOCKS are searched in one scan, beyond that rows are numbered and the scans' spans united.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out, numbered = None, None
    passes = _passes(docs, blocks(benchmark, item_id, item_text, width))
    shared = next(passes)
    for later in passes:
        if numbered is None:
            numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
        part = _scanned(numbered, shared)
        out, shared = part if out is None else out.unionByName(part), later
    if numbered is None:
        return _scan(rows, shared)
    out = _merged(out.unionByName(_scanned(numbered, shared)))
    discard(numbered)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the removal spans in ``text``; other columns pass unread. Null text stays null, a row without hits is unchanged.

    Judged on the texts as they come: where the benchmark takes several passes, rows are numbered first and cut once, by the united spans.
    """
    passes = _passes(docs, blocks(benchmark, item_id, item_text, width))
    shared = next(passes)
    if (later := next(passes, None)) is not None:
        return _cut_in_passes(docs, [shared, later], passes, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column(text))
            for lo, hi in vec.slices(offsets, SHARD_BYTES):
                words = vec.Words(data, offsets[lo : hi + 1], vec.ALNUM)
                shard = Shard(words)
                mask = np.zeros(len(words.hash), bool)
                for w in shared:
                    mask |= w.value.hits(shard)[0]
                column = b.column(text).slice(lo, hi - lo)
                if mask.any():
                    bounds = defaultdict(list)
                    for r, a, z in _runs(mask, shard.row):
                        bounds[r].append((int(words.start[a]), int(words.end[z])))
                    texts = column.to_pylist()
                    for r, spans in bounds.items():
                        at, kept = int(words.rows[r]), []
                        for a, z in spans:
                            kept.append(words.raw[at:a].tobytes())
                            at = z
                        kept.append(words.raw[at : int(words.rows[r + 1])].tobytes())
                        texts[r] = b"".join(kept).decode("utf-8", "replace")
                    column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([column.cast(b.schema.field(k).type) if b.schema.names[k] == text else c.slice(lo, hi - lo) for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _cut_in_passes(docs: DataFrame, held: list[list], passes: Iterator[list], text: str) -> DataFrame:
    """``decontaminate`` for benchmarks of several passes."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    found = None
    for shared in (*held, *passes):
        part = _scanned(rows.select(F.col("row").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "row"), shared)
        found = part if found is None else found.unionByName(part)
    cuts = _merged(found).where("size(spans) > 0").select(F.col("id").alias("row"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                if spans:
                    raw, at, kept = t.encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["from"]])
                        at = s["until"]
                    t = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    joined = rows.join(cuts, "row", "left").select("doc", "text", "spans")
    cut = joined.mapInArrow(run, joined.drop("spans").schema)
    return cut.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
