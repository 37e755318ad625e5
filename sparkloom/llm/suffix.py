"""Exact substring dedup by suffix buckets, each sorted by itself, with ties resolved by the ranks of a difference cover.

Only suffixes that can have an equal one are sorted. In every string of ``length`` bytes the leftmost smallest hash of its GRAM-byte substrings marks a place;
equal strings have it at the same distance, so strings whose marked gram occurs once are never looked at. The bytes around a mark, from the first string that
chose it to the end of the last one, are its context. Equal contexts are one class: all their strings repeat. What is left are buckets of different contexts
of one gram; their suffixes are sorted by their first PERIOD bytes, and ties, which are long where texts repeat, by the ranks of the places of a
difference cover: of any two suffixes, some offset under PERIOD brings both to such a place. A bucket is sorted with others in a block of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import by_key, lean, materialize, owned, record_id

GRAM = 64
#: Buckets of more contexts are not sorted in one task: their suffixes are counted by partial aggregates over 128 bits of them, which any number allows.
BUCKET_ROWS = 5_000
#: Contexts that a block holds at least, of whole buckets.
BLOCK_ROWS = 2_000
_SLICE = 400_000
_U = np.uint64
_LUT = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_MULS = [int(x) | 1 for x in np.random.default_rng(8).integers(1, 2**63, 8, dtype=np.uint64)]
#: A perfect difference cover: every difference modulo 31 is that of two of the six residues.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: For residues i and j the least offset that brings both into the cover.
OFFSET = np.array([[min(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    h, step = _LUT[raw], 1
    for m in _MULS:
        if step == GRAM:
            break
        h = h[:-step] * _U(m) + h[step:]
        step *= 2
    return h


def _sample(raw: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, gram hash) of each marked position, with the run of string starts that chose it."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = _grams(raw)
    value = ((h * _U(0x9E3779B97F4A7C15)) >> _U(32) << _U(32)) | np.arange(len(h), dtype=np.uint64)
    window, least, step = length - GRAM + 1, value, 1
    while step * 2 <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < window:
        least = np.minimum(least[: len(least) - (window - step)], least[window - step :])
    start = np.arange(len(least))
    end_of_row = np.repeat(rows[1:], np.diff(rows))[: len(least)]
    start = start[start + length <= end_of_row]
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    chosen = (least[start] & _U(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero((chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(start) - 1]])
    at = chosen[first]
    return at, start[first], start[last], vec.mix(h[at])


def _identities(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes lo..hi of each run, as two columns."""
    up, down = vec.powers(len(raw))
    out = []
    for table in (_LUT, vec.mix(_LUT)):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
        out.append(vec.mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)))
    return out[0], out[1]


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """(gram, c1, c2, id, th, place) for every marked position: 128 bits of its context; place packs the position and the distances back to its first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            ids, hashes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for lo, hi in vec.slices(offsets, _SLICE):
                bounds = offsets[lo : hi + 1] - offsets[lo]
                raw = data[offsets[lo] : offsets[hi]]
                at, first, last, gram = _sample(raw, bounds, length)
                if not len(at):
                    continue
                c1, c2 = _identities(raw, first, last + length)
                row = np.searchsorted(bounds, at, "right") - 1
                place = ((at - bounds[row]) << 20) | ((at - first) << 10) | (at - last)
                yield pa.RecordBatch.from_arrays([pa.array(vec.signed(x)) for x in (gram, c1, c2)] + [pa.array(ids[lo + row]), pa.array(hashes[lo + row]), pa.array(place)], ["gram", "c1", "c2", "id", "th", "place"])

    return rows.mapInArrow(run, "gram long, c1 long, c2 long, id long, th long, place long")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """(gram, hot, alone, id, th, place, bytes): the bytes of each wanted context. ``alone``: no other context is equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            for r in range(b.num_rows):
                wanted = b.column("wanted").slice(r, 1).flatten()
                raw = data[offsets[r] : offsets[r + 1]]
                for part in range(0, len(wanted), 10_000):  # a text of any length gives batches of bounded size
                    some = wanted.slice(part, 10_000)
                    gram, place, hot, alone = (some.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                    at = place >> 20
                    lo, hi = at - ((place >> 10) & 1023), at - (place & 1023) + length
                    size = hi - lo
                    ends = np.concatenate([[0], np.cumsum(size)])
                    flat = raw[vec.spread(lo, size)]
                    context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                    one = np.ones(len(size), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(hot), pa.array(alone), pa.array(one * b.column("id")[r].as_py()), pa.array(one * b.column("th")[r].as_py()), pa.array(place), context], ["gram", "hot", "alone", "id", "th", "place", "bytes"]
                    )

    return rows.mapInArrow(run, "gram long, hot boolean, alone boolean, id long, th long, place long, bytes binary")


def _dense(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Ranks from 1 in the order of ``order``, where ``fresh`` tells places that differ from the one before."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


class Block:
    """The bytes of some contexts: words of eight bytes at every place, and the ranks of the cover's places by their first 31 and 155 bytes."""

    def __init__(self, raw: np.ndarray, depth: int):
        n = len(raw)
        padded = np.concatenate([raw, np.zeros(depth + 2 * PERIOD + 8, np.uint8)])
        self.word = np.zeros(n + depth + 2 * PERIOD, np.uint64)  # big-endian, so that numbers compare as bytes do
        for k in range(8):
            self.word |= padded[k : k + len(self.word)].astype(np.uint64) << _U(56 - 8 * k)
        residue = np.arange(n) % PERIOD
        places = np.flatnonzero(np.isin(residue, COVER))
        self.short = np.zeros(n + depth + 2 * PERIOD, np.int64)  # 0 beyond the end
        self.short[places] = self._ranked(places, [self.word[places + 8 * k] for k in range(3)] + [self.word[places + 24] >> _U(8)])
        rank, step = self.short, PERIOD
        self.rounds = 0
        while step * 2 <= depth - 2 * PERIOD:
            rank = self._doubled(places, rank, rank, step)
            step *= 2
            self.rounds += 1
        while step + PERIOD <= depth - PERIOD:
            rank = self._doubled(places, rank, self.short, step)
            step += PERIOD
        self.rank, self.depth = rank, step

    @staticmethod
    def _ranked(places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        fresh = np.ones(len(places), np.int64)
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        return _dense(order, fresh)

    def _doubled(self, places: np.ndarray, first: np.ndarray, second: np.ndarray, step: int) -> np.ndarray:
        key = first[places].astype(np.uint64) << _U(32) | second[places + step].astype(np.uint64)
        order = np.argsort(key)
        fresh = np.ones(len(places), np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        out = np.zeros_like(first)
        out[places] = _dense(order, fresh)
        return out

    def compare(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """-1, 0 or 1 for suffixes a and b whose first PERIOD bytes are equal: by their cover ranks, then by the bytes that those don't reach."""
        by = OFFSET[a % PERIOD, b % PERIOD]
        out = np.sign(self.rank[a + by] - self.rank[b + by])
        tail = [*range(self.depth, length - 8, 8), length - 8]
        same = np.flatnonzero(out == 0)
        for k in tail:
            x, y = self.word[a[same] + k], self.word[b[same] + k]
            out[same] = np.where(x > y, 1, np.where(x < y, -1, 0))
            same = same[x == y]
        return out


def repeated(raw: np.ndarray, bucket: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes, at places ``start`` in ``raw`` and of a bucket each, have an equal one, in their first ``length`` bytes, in their bucket.

    Suffixes are sorted by bucket and first bytes; groups of equal ones are then parted, all at once, by comparing each with its group's middle one, until
    every group is a run of equal suffixes.
    """
    block = Block(raw, length)
    keys = [bucket] + [block.word[start + 8 * k] for k in range(3)] + [block.word[start + 24] >> _U(8)]
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    out = np.zeros(len(start), bool)
    now, group = order, np.cumsum(fresh) - 1
    while len(now):
        size = np.bincount(group)
        many = size[group] > 1
        now, group = now[many], np.unique(group[many], return_inverse=True)[1]
        if not len(now):
            break
        size = np.bincount(group)
        first = np.cumsum(size) - size
        sign = block.compare(start[now], start[now[first + size // 2]][group], length)
        equal = sign == 0
        alike = np.bincount(group[equal], minlength=len(size))
        out[now[equal & (alike[group] > 1)]] = True
        now, group, sign = now[~equal], group[~equal], sign[~equal]
        side = 2 * group + (sign > 0)
        order = np.argsort(side, kind="stable")
        now, group = now[order], np.unique(side[order], return_inverse=True)[1]
    return out


def _starts(place: np.ndarray, context: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all contexts, row, place in them, start in the text) of every suffix of the rows."""
    data, offsets = vec.buffers(context)
    raw, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    count = np.diff(bounds) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    at = vec.spread(bounds[:-1], count)
    first = (place >> 20) - ((place >> 10) & 1023)
    return raw, row, at, first[row] + at - bounds[row]


def _spans(row: np.ndarray, start: np.ndarray, ids: np.ndarray, hashes: np.ndarray, length: int) -> pa.RecordBatch:
    """Bytes covered by runs of consecutive starts of a row."""
    turn = np.flatnonzero((row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(row) - 1]])
    return pa.RecordBatch.from_arrays([pa.array(ids[row[first]]), pa.array(hashes[row[first]]), pa.array(start[first]), pa.array(start[last] + length)], ["id", "th", "lo", "hi"])


SPAN = "id long, th long, lo long, hi long"


def _buckets(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the suffixes of contexts without an equal one that another context of the bucket has too. Whole buckets are taken together."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, alone, ids, hashes, place = (table.column(c).to_numpy() for c in ("gram", "alone", "id", "th", "place"))
        raw, row, at, start = _starts(place, table.column("bytes").combine_chunks(), length)
        twice = repeated(raw, gram[row], at, length) & alone[row]
        if twice.any():
            yield _spans(row[twice], start[twice], ids, hashes, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            while len(gram):
                cut = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                cut = cut[cut >= min(BLOCK_ROWS, len(gram) - 1)]
                if not len(cut):
                    break
                yield from solve(table.slice(0, int(cut[0])))
                table, gram = table.slice(int(cut[0])), gram[int(cut[0]) :]
            held = table.to_batches()
        if held and sum(x.num_rows for x in held):
            yield from solve(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN)


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets of too many contexts: suffixes known by 128 bits are counted by partial aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                x = b.slice(lo, BLOCK_ROWS)
                alone, ids, hashes, place = (x.column(c).to_numpy(zero_copy_only=False) for c in ("alone", "id", "th", "place"))
                raw, row, at, start = _starts(place, x.column("bytes"), length)
                s1, s2 = _identities(raw, at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(vec.signed(s1)), pa.array(vec.signed(s2)), pa.array(alone[row]), pa.array(ids[row]), pa.array(hashes[row]), pa.array(start)], ["s1", "s2", "alone", "id", "th", "lo"])

    suffixes = rows.mapInArrow(run, "s1 long, s2 long, alone boolean, id long, th long, lo long")
    twice = materialize(suffixes.groupBy("s1", "s2").count().where("count > 1"))
    return by_key(suffixes.where("alone"), twice, ["s1", "s2"], "count").select("id", "th", "lo", (F.col("lo") + length).alias("hi"))


@owned
def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, spans, n) for ``rows`` (id, th, text), materialised: maximal byte ranges covered by strings of ``length`` bytes that start elsewhere too, and their number."""
    anchors = _anchors(rows, length)
    often = materialize(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    mine = materialize(by_key(anchors, often, ["gram"], "n", whole=False).drop("n"))  # as many grams as texts repeat: shuffled at every size
    context = ["gram", "c1", "c2"]
    classes = materialize(mine.groupBy(*context).agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("id", "th", "place")]))
    # equal contexts: all of their strings repeat
    first, last = F.shiftright("place", 20) - F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.shiftright("place", 20) - F.col("place").bitwiseAND(F.lit(1023))
    several = classes.where("m > 1").select(*context, "m")
    spans = by_key(mine, several, context, "m").select("id", "th", first.cast("long").alias("lo"), (last + length).cast("long").alias("hi"))
    # different contexts of one gram, one of each class: their suffixes are sorted
    buckets = materialize(classes.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1"))
    one = by_key(classes.select("gram", "id", "th", "place", "m"), buckets, ["gram"], "d")
    wanted = F.struct("gram", "place", (F.col("d") > BUCKET_ROWS).alias("hot"), (F.col("m") == 1).alias("alone"))
    wanted = materialize(one.groupBy("id", "th").agg(F.collect_list(wanted).alias("wanted"), F.count("*").alias("n")))
    around = _contexts(rows.join(lean(wanted, "n", 40).drop("n"), ["id", "th"]), length)
    if buckets.where(F.col("d") > BUCKET_ROWS).isEmpty():
        spans = spans.unionByName(_buckets(around, length))
    else:
        around = materialize(around)
        spans = spans.unionByName(_buckets(around.where("not hot"), length)).unionByName(_counted(around.where("hot"), length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            merged = [_merge(s) for s in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([[{"lo": lo, "hi": hi} for lo, hi in m] for m in merged], kind), pa.array([len(m) for m in merged], pa.int64())], ["id", "th", "spans", "n"])

    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).mapInArrow(run, "id long, th long, spans array<struct<lo: long, hi: long>>, n long")


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def suffix_dedup(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept) for each row.

    Texts are UTF-8 bytes. Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same row or
    another; ``spans`` are the maximal removed runs as (lo, hi). Judged on the input as a whole. Null counts as empty: 0 bytes and the digest of the
    empty string. Repeated rows are documents of their own, so they repeat each other. ``kept``: the remaining bytes. Columns of other names are not read.
    ``length`` lies between 65 and 1000. Contexts are known by 128 bits; suffixes of different ones are compared byte for byte.
    """
    if not GRAM < length <= 1000:
        raise ValueError(f"length must be over {GRAM} and at most 1000")
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), record_id(doc_id, text).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(rows.select("id", "th", "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            for lo, hi in vec.slices(offsets, 4_000_000):
                kept = []
                found = b.column("spans").slice(lo, hi - lo)
                for r, runs in zip(range(lo, hi), found.to_pylist(), strict=True):
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    edges = [0, *(x for s in runs for x in (s["lo"], s["hi"])), len(raw)]
                    kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                size = np.diff(offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("own").slice(lo, hi - lo), pa.array(size), pa.array(size - np.array([len(k) for k in kept], np.int64)), found, pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
                )

    kind = "array<struct<lo: long, hi: long>>"
    cut = lambda df: df.select("own", "text", "spans").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, spans {kind}, kept_sha256 string, kept binary")
    whole = lambda df: df.select(F.col("own").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(kind).alias("spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    told = lean(spans, "n", 24)
    if told is spans:  # too many spans to broadcast
        both = rows.join(spans, ["id", "th"], "left")
        return cut(both.where("spans is not null")).unionByName(whole(both.where("spans is null")))
    return cut(rows.join(told, ["id", "th"])).unionByName(whole(rows.join(F.broadcast(spans.select("id", "th")), ["id", "th"], "left_anti")))
