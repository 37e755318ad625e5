"""Language ID by language-bitmask n-gram filters: one bit-sliced Bloom filter tells all languages that hold an n-gram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

#: Documents of each language that the filters are learned from, about, and bytes of text of all languages together; whole texts. The only bounds on what is learned.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 800, 64_000_000
#: Bytes of an n-gram, slots of a filter, and how often an n-gram must occur in a language's sample.
NGRAM, SLOTS, LEAST = 5, 1 << 20, 3
#: Languages in a filter: the bits of a mask.
BITS = 64
_SLICE = 400_000
_LETTER = vec.table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SPACED = np.where(vec.ALNUM & ~vec.table(b"0123456789"), vec.LOWER, 32).astype(np.uint8)


class Grams:
    """n-grams of rows: letters in lower case, all else one space, a space before and after each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base, n = int(offsets[0]), len(offsets) - 1
        raw = data[base : int(offsets[-1])]
        rows = offsets - base
        low = _SPACED[raw]
        accent = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
        low[accent] += 32  # capital letters with an accent
        row = np.repeat(np.arange(n), np.diff(rows))
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (row[1:] != row[:-1])
        low, row = low[keep], row[keep]
        first = np.searchsorted(row, np.arange(n + 1))
        at = np.arange(len(low)) + 2 * row + 1
        text = np.full(len(low) + 2 * n + NGRAM, 32, np.uint8)
        text[at] = low
        self.first = first + 2 * np.arange(n + 1)
        x = np.zeros(len(text) - NGRAM + 1, np.uint64)
        for k in range(NGRAM):
            x |= text[k : len(text) - NGRAM + 1 + k].astype(np.uint64) << np.uint64(8 * k)
        self.value = x[: self.first[-1]]
        size = np.diff(self.first)
        left = np.repeat(self.first[1:], size) - np.arange(self.first[-1])
        self.valid = left >= NGRAM
        short = np.flatnonzero(size < NGRAM)
        self.valid[self.first[short]] = True  # a short row has one n-gram
        self.count = np.add.reduceat(self.valid, self.first[:-1]) if n else np.zeros(0, np.int64)
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        self.letters = letters[rows[1:]] - letters[rows[:-1]] > 0
        for r in np.flatnonzero(~self.letters):
            part = raw[rows[r] : rows[r + 1]]
            if (part >= 128).any():
                self.letters[r] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))


def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = vec.mix(values)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


class Filters:
    """``languages`` in order, in slices of BITS; a slice's table has a mask for each slot, ``fill`` the chance of a false positive by language."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages, self.tables, self.false = languages, [], np.zeros(len(languages))
        for lo in range(0, len(languages), BITS):
            part = grams[lo : lo + BITS]
            kind = np.uint8 if len(part) <= 8 else np.uint64
            table = np.zeros(SLOTS, kind)
            for bit, g in enumerate(part):
                mask = np.zeros(SLOTS, bool)
                for at in _slots(g):
                    mask[at] = True
                table[mask] |= kind(1 << bit)
                self.false[lo + bit] = mask.mean() ** 2
            self.tables.append((lo, len(part), table))

    def score(self, g: Grams) -> np.ndarray:
        """rows x languages: the share of a row's n-grams that a language holds, false positives taken off."""
        n = len(g.first) - 1
        out = np.zeros((n, len(self.languages)))
        a, b = _slots(g.value)
        for lo, count, table in self.tables:
            mask = table[a] & table[b]
            mask[~g.valid] = 0
            for bit in range(count):
                held = np.add.reduceat(((mask >> mask.dtype.type(bit)) & mask.dtype.type(1)).astype(np.uint32), g.first[:-1])
                f = self.false[lo + bit]
                out[:, lo + bit] = np.clip((held / np.maximum(g.count, 1) - f) / max(1e-9, 1 - f), 0, 1)
        return out


def learn(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from rows of ``train`` with text and language: of each language about ``per_language``, fewer if their texts are long (SAMPLE_BYTES), chosen by a hash of id and text."""
    known = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each language
    if not counts:
        return Filters([], [])
    shares = [(r.lang, min(per_language / r["count"], SAMPLE_BYTES / len(counts) / max(r.bytes, 1))) for r in counts]
    share = F.col("share")
    few = known.join(F.broadcast(train.sparkSession.createDataFrame(shares, "lang string, share double")), "lang").where((F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)) < share)
    sample = few.select("lang", "text").toArrow()
    languages = sorted(set(sample.column("lang").to_pylist()))
    grams = []
    for name in languages:
        mine = sample.filter(pa.array([x == name for x in sample.column("lang").to_pylist()]))
        data, offsets = vec.buffers(mine.column("text"))
        found = []
        for lo, hi in vec.slices(offsets, 50 * _SLICE):
            g = Grams(data, offsets[lo : hi + 1])
            found.append(g.value[g.valid])
        values, n = np.unique(np.concatenate(found), return_counts=True)
        grams.append(values[n >= min(LEAST, len(mine))])
    return Filters(languages, grams)


def predict(docs: DataFrame, filters: Filters, text: str = "text", pred: str = "_lang", score: str = "_score") -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1. ``und`` and 0 if the text is null or has no letter, or nothing was learned.

    Equal scores go to the language first in the alphabet. Other columns pass unread; those named ``pred`` or ``score`` are replaced.
    """
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = np.array([*filters.languages, "und"], object)
        for b in batches:
            data, offsets = vec.buffers(b.column(text))
            for lo, hi in vec.slices(offsets, _SLICE):
                g = Grams(data, offsets[lo : hi + 1])
                s = filters.score(g) if filters.languages else np.zeros((hi - lo, 1))
                best, top = s.argmax(1), s.max(1)
                if not filters.languages:
                    g.letters[:] = False
                best[~g.letters], top[~g.letters] = len(filters.languages), 0.0
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns], pa.array(names[best], pa.string()), pa.array(top, pa.float64())], [*b.schema.names, pred, score])

    return docs.mapInArrow(run, docs.select("*", F.lit("").cast("string").alias(pred), F.lit(0.0).alias(score)).schema)
