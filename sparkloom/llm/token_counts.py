"""Token counts of sections: whole texts are encoded once and their tokens attributed to sections by byte spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .bpe import _sizes, encode_tree, encoding


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section: ``sizes`` are the tokens' byte lengths in order, ``bounds`` the sections' edges, ascending, from 0 to the end.

    An interval join of two sorted lists by binary search. A token over a boundary goes to the section of its first byte (``first``), of its
    last byte (``last``), or of most of its bytes (``most``, the earlier of equal ones). An empty section has no tokens.
    """
    end = np.cumsum(sizes)
    begin = end - sizes
    n = len(bounds) - 1
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    at = {"first": first, "last": last, "most": first.copy()}[rule]
    if rule == "most":
        for k in np.flatnonzero(first != last):
            inside = [min(end[k], bounds[s + 1]) - max(begin[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            at[k] = first[k] + int(np.argmax(inside))
    return np.bincount(at, minlength=n) if len(sizes) else np.zeros(n, np.int64)


def _counted(rows: DataFrame, path: str, pattern: str, rule: str) -> DataFrame:
    """(doc_id, section, n_bytes, n_tokens, doc_tokens) of ``rows`` (doc_id, text, bounds): ``bounds`` are the sections' edges in bytes, null for lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        names = _sizes(path, pattern)
        size = np.array(names, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data, offsets = vec.buffers(part.column("text"))
                counts, lengths, sections, totals, rows = [], [], [], [], []
                for r, (t, edges) in enumerate(zip(part.column("text").to_pylist(), part.column("bounds").to_pylist(), strict=True)):
                    ids = np.array(encode_tree(t, enc.encode_ordinary, names.__getitem__), np.int64)
                    raw = data[offsets[r] : offsets[r + 1]]
                    bounds = np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1, [len(raw)]]) if edges is None else np.array(edges, np.int64)
                    counts.append(attribute(size[ids], bounds, rule))
                    lengths.append(np.diff(bounds))
                    sections.append(np.arange(len(bounds) - 1))
                    totals.append(np.full(len(bounds) - 1, len(ids)))
                    rows.append(np.full(len(bounds) - 1, r))
                if rows:
                    flat = [np.concatenate(x) for x in (sections, lengths, counts, totals)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(flat[0].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in flat[1:]]], ["doc_id", "section", "n_bytes", "n_tokens", "doc_tokens"]
                    )

    return rows.mapInArrow(run, "doc_id long, section int, n_bytes long, n_tokens long, doc_tokens long")


def section_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "first", doc_id: str = "doc_id", text: str = "text", bounds: str | None = None) -> DataFrame:
    """(doc_id, section, n_bytes, n_tokens, doc_tokens), a row for each section of each text.

    Sections are lines, each with the line feed that ends it, or what ``bounds`` tells: a column of array<long>, the sections' edges in bytes, ascending,
    from 0 to the text's end; null there means lines. ``doc_tokens`` is the whole text's count, which its sections' counts add up to. Null and empty texts have
    one empty section. Rows are independent: repeated rows give their sections again, a null id stays null. Other columns are not read.
    """
    edges = F.col(bounds) if bounds else F.lit(None)
    return _counted(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), edges.cast("array<long>").alias("bounds")), path, pattern, rule)


def field_token_counts(docs: DataFrame, path: str, pattern: str, fields: list[str], rule: str = "first", doc_id: str = "doc_id", between: str = "\n") -> DataFrame:
    """(doc_id, field, n_bytes, n_tokens, doc_tokens): tokens of a document made of several fields, encoded once as a whole.

    The document is its fields, null as empty, with ``between`` after each but the last, which counts to the field before it.
    """
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(between if k < len(fields) - 1 else "")) for k, f in enumerate(fields)]
    ends, total = [F.lit(0).cast("long")], F.lit(0).cast("long")
    for p in parts:
        total = total + F.octet_length(p)
        ends.append(total)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*ends).alias("bounds"))
    names = F.array(*[F.lit(f) for f in fields])
    return _counted(rows, path, pattern, rule).withColumn("field", F.get(names, F.col("section"))).select("doc_id", "field", "n_bytes", "n_tokens", "doc_tokens")
