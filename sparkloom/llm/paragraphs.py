"""Substring dedup: paragraphs by MinHash banding, verified by exact Jaccard, removed by connected components; then verbatim passages, whatever the lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import by_key, discard, lean, materialize, owned, record_id, semi_by_id, small
from .rarity import Rarity, frequent
from .similarity import cluster

#: 8 bands of 3 rows find a pair of similarity s with probability 1 - (1 - s^3)^8: 0.997 at 0.8, 0.9999 at 0.9; equal sets always.
BANDS, ROWS = 8, 3
#: One of any WINDOW consecutive places is an anchor, so a run that two texts share holds one if it has LENGTH + WINDOW - 1 words: 30.
LENGTH, WINDOW = 25, 6
#: Equal runs are cut if, with others at most GAP words apart, they cover LEAST_CUT words: any run of 50 does, at either end of which WINDOW - 1 may stay.
LEAST_CUT, GAP = 40, 12
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_LINE = np.uint64(0x9E3779B97F4A7C15)


def _paragraph_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all paragraphs, first paragraph of each row): lines, each with the line feed that ends it."""
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0] + 1
    cuts = np.union1d(breaks, offsets)
    return cuts, np.searchsorted(cuts, offsets)


def _bands(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of distinct shingles the BANDS keys of its MinHash signature; no row is empty."""
    keys = []
    for b in range(BANDS):
        key = np.full(len(offsets) - 1, np.uint64(b + 1))
        for seed in _SEEDS[b * ROWS : (b + 1) * ROWS]:
            x = (flat ^ (seed >> np.uint64(7))) * seed
            x ^= x >> np.uint64(31)
            key = vec.mix(key * _LINE + np.minimum.reduceat(x, offsets[:-1]))
        keys.append(key)
    return np.stack(keys, 1)


def _scan(rows: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """(id, th, para, n, k1, k2, bands) for every paragraph of at least ``min_words`` words of ``rows`` (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            ids, hashes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for lo, hi in vec.slices(offsets):
                cuts, first = _paragraph_offsets(data, offsets[lo : hi + 1])
                if len(cuts) < 2:
                    continue
                words = vec.Words(data, cuts, vec.NOT_SPACE)
                keep = np.flatnonzero(np.diff(words.first) >= max(1, min_words))
                if not len(keep):
                    continue
                row = np.searchsorted(first, keep, "right") - 1
                flat, ends = vec.distinct(words.rows_of(keep), shingle)
                k1, k2 = vec.set_keys(flat, ends)
                bands = _bands(flat, ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + row]), pa.array(hashes[lo + row]), pa.array((keep - first[row]).astype(np.int32)), pa.array(np.diff(ends)), pa.array(k1), pa.array(k2), vec.lists(bands.ravel(), np.arange(len(keep) + 1) * BANDS)],
                    ["id", "th", "para", "n", "k1", "k2", "bands"],
                )

    return rows.mapInArrow(run, "id long, th long, para int, n long, k1 long, k2 long, bands array<long>")


def _sets_of(rows: DataFrame, homes: DataFrame, shingle: int):
    """Shingle sets of paragraph classes: ``homes`` (node, id, th, para) says where a copy of each stands; its row is read again."""

    def sets_of(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = vec.buffers(b.column("text"))
                wanted = b.column("wanted")
                for lo, hi in vec.slices(offsets):
                    cuts, first = _paragraph_offsets(data, offsets[lo : hi + 1])
                    mine = wanted.slice(lo, hi - lo)
                    at = np.repeat(first[:-1], mine.value_lengths().to_numpy(zero_copy_only=False)) + mine.flatten().field("para").to_numpy(zero_copy_only=False)
                    words = vec.Words(data, cuts, vec.NOT_SPACE).rows_of(at)
                    yield pa.RecordBatch.from_arrays([mine.flatten().field("node"), vec.lists(*vec.distinct(words, shingle))], ["node", "items"])

        at = semi_by_id(homes, nodes, "node").groupBy("id", "th").agg(F.collect_list(F.struct("node", "para")).alias("wanted"))
        return rows.join(at, ["id", "th"]).select("text", "wanted").mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])

    return sets_of


@owned
def repeated_paragraphs(rows: DataFrame, min_words: int = 25, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, th, para, component, first_id, first_para) for every paragraph of ``rows`` (id, th, text) to remove: all of a component but its first, by id and place.

    Rows with the same id and hash ``th`` are one record. Classes of equal shingle sets are known by 128 bits of their set.
    """
    found = materialize(_scan(rows, min_words, shingle).withColumn("place", F.monotonically_increasing_id()))
    classes = materialize(found.groupBy("k1", "k2").agg(F.min("place").alias("node"), F.count("*").alias("copies")))
    several = classes.where("copies > 1")
    # a copy that isn't its class's first brings nothing; most classes have one paragraph, so the others are told by an anti join
    copies = materialize(by_key(found.select("place", "k1", "k2"), several, ["k1", "k2"], "copies").select("place", "node"))
    firsts = found.join(small(copies.where("place <> node").select("place")), "place", "left_anti").withColumnRenamed("place", "node")
    posts = firsts.select(F.explode("bands").alias("key"), "node", "n", F.lit(1).alias("ell"), F.lit(0).alias("pos"))
    linked = cluster(posts, _sets_of(rows, firsts.select("node", "id", "th", "para"), shingle), percent, rarity=Rarity(*frequent(rows, shingle)))
    # the paragraphs that are not alone: those of classes of several and of classes with links
    single = linked.join(small(copies.select(F.col("place").alias("node"))), "node", "left_anti")
    nodes = copies.unionByName(single.select(F.col("node").alias("place"), "node"))
    nodes = nodes.join(small(linked), "node", "left").select("place", F.coalesce("component", "node").alias("component"))
    members = materialize(found.select("place", "id", "th", "para").join(small(nodes), "place").drop("place"))
    stay = materialize(members.groupBy("component").agg(F.min(F.struct("id", "para")).alias("first"), F.count("*").alias("copies")))
    gone = by_key(members, stay, ["component"], "copies").where((F.col("id") != F.col("first.id")) | (F.col("para") != F.col("first.para")))
    return gone.select("id", "th", "para", "component", F.col("first.id").alias("first_id"), F.col("first.para").alias("first_para"))


def _anchors(words: vec.Words, length: int) -> np.ndarray:
    """The words where a passage of ``length`` words starts whose hash is the least of WINDOW consecutive ones in its row.

    Whether a place is chosen depends on the words around it only, not on lines nor on where the text begins.
    """
    h, _ = vec.passages(words.hash, words.first, length)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(h))
    inside = left[:n] >= length + WINDOW - 1
    least = np.minimum.reduce([h[k : k + n] for k in range(WINDOW)])
    chosen = np.zeros(len(h), bool)
    for k in range(WINDOW):
        chosen[k : k + n] |= (h[k : k + n] == least) & inside
    return np.flatnonzero(chosen)


def _kept_words(data: np.ndarray, offsets: np.ndarray, removed: pa.Array) -> vec.Words:
    """Words of rows, but for those in the removed paragraphs of each (a list, or null)."""
    words = vec.Words(data, offsets, vec.NOT_SPACE)
    if removed.null_count == len(removed):
        return words
    cuts, first = _paragraph_offsets(data, offsets)
    gone = np.zeros(len(cuts), bool)
    size = removed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    gone[np.repeat(first[:-1], size) + removed.flatten().to_numpy(zero_copy_only=False)] = True
    return words.without(gone[np.searchsorted(cuts - offsets[0], words.start, "right") - 1])


def _passages(lined: DataFrame, length: int) -> DataFrame:
    """(key, check, id, th, pos) for each anchor of ``lined`` (id, th, text, removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            ids, hashes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for lo, hi in vec.slices(offsets):
                words = _kept_words(data, offsets[lo : hi + 1], b.column("removed").slice(lo, hi - lo))
                at = _anchors(words, length)
                key = vec.passages(words.hash, words.first, length)[0][at]
                check = vec.passages(vec.mix(words.hash ^ _LINE), words.first, length)[0][at]
                row = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vec.signed(key)), pa.array(vec.signed(check)), pa.array(ids[lo + row]), pa.array(hashes[lo + row]), pa.array((at - words.first[row]).astype(np.int32))],
                    ["key", "check", "id", "th", "pos"],
                )

    return lined.select("id", "th", "text", "removed").mapInArrow(run, "key long, check long, id long, th long, pos int")


@owned
def repeated_passages(lined: DataFrame, length: int) -> DataFrame:
    """(id, th, spans) of ``lined`` (id, th, text, removed): runs of words, array<struct<first, last>>, whose passages stand in a row of a smaller id too.

    Words are counted without those of the removed paragraphs. Passages are known by 128 bits.
    """
    found = _passages(lined, length)
    shared = materialize(found.groupBy("key", "check").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("copies")).where("least < most").select("key", "check", "least", "copies"))
    later = by_key(found, shared, ["key", "check"], "copies").where("id <> least").select("id", "th", "pos")
    # passages that touch or overlap make one run
    row = Window.partitionBy("id", "th").orderBy("pos")
    fresh = F.coalesce(F.col("pos") > F.lag("pos").over(row) + length, F.lit(True)).cast("int")
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(row)).groupBy("id", "th", "run").agg(F.min("pos").alias("first"), (F.max("pos") + length - 1).alias("last"))
    # and runs with few other words between them are told apart from short ones that stand alone
    row = Window.partitionBy("id", "th").orderBy("first")
    apart = F.coalesce(F.col("first") > F.lag("last").over(row) + GAP + 1, F.lit(True)).cast("int")
    runs = runs.withColumn("apart", apart).withColumn("group", F.sum("apart").over(row))
    covered = F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy("id", "th", "group"))
    runs = runs.withColumn("covered", covered).where(F.col("covered") >= max(length, LEAST_CUT))
    return runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _without(text: str, removed: list[int], spans: list[dict]) -> tuple[str, list[int]]:
    """(text without the removed lines and the spans of words of the others, numbers of the lines removed or touched).

    A line goes with its line feed if all of its words do; a kept word brings the space before it, the first of a line the line's indent.
    """
    raw, out = set(removed), set(removed)
    lines, kept, word = text.split("\n"), [], 0
    ahead = iter([(s["first"], s["last"]) for s in spans] + [(2**62, 2**62)])
    lo, hi = next(ahead)
    for k, line in enumerate(lines):
        if k in raw:
            continue
        data = line.encode()
        words = vec.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), vec.NOT_SPACE)
        begin, parts, n, lost = 0, [], len(words.start), 0
        while hi < word:
            lo, hi = next(ahead)
        if lo >= word + n:  # no span touches the line
            kept.append(line)
            word += n
            continue
        for a, z in zip(words.start.tolist(), words.end.tolist(), strict=True):
            while hi < word:
                lo, hi = next(ahead)
            if lo <= word:
                lost += 1
            else:
                parts.append(data[begin:z])
            begin, word = z, word + 1
        out.add(k)
        if lost < n:
            kept.append((b"".join(parts) + data[begin:]).decode())
    return "\n".join(kept), sorted(out)


def substring_dedup(docs: DataFrame, min_words: int = 25, shingle: int = 5, percent: int = 80, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated paragraphs and passages cut out of ``text``, and two columns more: _n_paragraphs and _removed (sorted numbers).

    A paragraph is a line. Those of at least ``min_words`` words (runs of anything but white space, A-Z lower-cased) are compared by the
    Jaccard similarity of their distinct ``shingle``-word sets; at ``percent`` or more they are linked, and of each component the first
    paragraph by (id, place) stays. The line feed that ended a removed paragraph goes with it. Null text stays null with 0 paragraphs, empty
    text has one empty paragraph. A null doc_id counts as a negative number made from the text. Repeated rows are one record and get one result.

    In what is left, a passage is ``length`` words in a row, wherever lines end. Passages at anchors (see WINDOW) stay in the row of the smallest id that
    has them and are cut out of others where they cover LEAST_CUT words or more. This finds every run of 50 words that stands in rows of two ids, but for up
    to WINDOW - 1 words at either end of it; shorter runs, and those that only repeat within one row, stay. Passages are equal word for word: of a similar one, its equal runs go. Rows that
    share a doc_id take none from each other.
    ``_removed`` has the paragraphs that are removed or lose words. Columns of other names pass unread, whatever their names; input columns
    named _n_paragraphs or _removed are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "_n_paragraphs", "_removed")]
    told = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"), record_id(doc_id, text).alias("id")).withColumn("th", F.xxhash64("text"))
    rows = told.select("id", "th", F.coalesce("text", F.lit("")).alias("text"))
    paragraphs = repeated_paragraphs(rows, min_words, shingle, percent)
    gone = materialize(paragraphs.groupBy("id", "th").agg(F.sort_array(F.collect_set("para")).alias("removed"), F.count("*").alias("n")))
    lined = rows.join(lean(gone, "n", 8).drop("n"), ["id", "th"], "left")
    passages = repeated_passages(lined, max(1, length))
    cuts = passages.withColumn("m", F.size("spans"))
    changed = materialize(gone.join(cuts, ["id", "th"], "full_outer").select("id", "th", "removed", "spans", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("size")))
    discard(paragraphs, gone, passages)
    told_lean = lean(changed, "size", 16)
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("_n_paragraphs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_without(*x) if x[0] is not None else (None, []) for x in zip(b.column("text").to_pylist(), (x or [] for x in b.column("removed").to_pylist()), (x or [] for x in b.column("spans").to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([m[0] for m in made], pa.string()), b.column("_n_paragraphs"), pa.array([m[1] for m in made], pa.list_(pa.int32()))], ["row", "text", "_n_paragraphs", "_removed"])

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c in (*others, text)], "_n_paragraphs", "_removed")

    if told_lean is changed:  # too many changed rows to broadcast
        both = told.join(changed, ["id", "th"], "left")
        touched, same = both.where("size is not null"), both.where("size is null")
    else:
        touched, same = told.join(told_lean, ["id", "th"]), told.join(F.broadcast(changed.select("id", "th")), ["id", "th"], "left_anti")
    kind = touched.select("row", "text", n_lines, F.col("removed").alias("_removed")).schema
    cut = touched.select("row", "text", "removed", "spans", n_lines).mapInArrow(run, kind)
    return shaped(cut).unionByName(shaped(same.select("row", "text", n_lines, F.array().cast("array<int>").alias("_removed"))))
