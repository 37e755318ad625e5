"""Byte-level BPE encoding and decoding by monoid tree reduction.

An element is a span of text with its token ids. A leaf is encoded outright; two neighbours are joined by encoding a window around their
boundary afresh, widened until it begins and ends at places where no match of the pattern can cross. A place after a letter or digit and before white
space or punctuation is such a place whatever surrounds it, and so is one between an ASCII letter and a digit: no alternative of the pattern has a character of
another kind after a letter or digit, so a match ends there and the next one starts, and each match is merged by itself. Tokens outside the window are
therefore those of the whole text. Only letters and marks whose kinds no version of Unicode has changed count, so that all sides agree on them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a leaf holds at most, and tokens that a leaf of the decoding tree holds at most.
LEAF_CHARS, LEAF_TOKENS = 4096, 8192
_ALNUM = "0-9A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_MARK = r" \t\n\r!-/:-@\[-`{-~。、，！？；：「」（）《》【】…“”‘’—·"
_CUT = re.compile(f"(?<=[{_ALNUM}])(?=[{_MARK}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """A tiktoken encoding of the rank file at ``path``, without special tokens; once for each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tail(ids: list[int], text: str, cut: int, size: Callable[[int], int]) -> int:
    """How many of ``ids``, which encode ``text``, lie before ``cut``, a place between tokens."""
    left, k = len(text[cut:].encode("utf-8", "surrogatepass")), len(ids)
    while left > 0:
        k -= 1
        left -= size(ids[k])
    return k


def _head(ids: list[int], text: str, cut: int, size: Callable[[int], int]) -> int:
    left, k = len(text[:cut].encode("utf-8", "surrogatepass")), 0
    while left > 0:
        left -= size(ids[k])
        k += 1
    return k


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], encode: Callable[[str], list[int]], size: Callable[[int], int]) -> tuple[str, list[int]]:
    """The monoid's operation: the encoding of two neighbours' text from theirs."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return (a + b, x or y)
    span = 64
    while True:  # the last safe place in a; else all of it
        at = max(0, len(a) - span)
        cuts = [m.start() for m in _CUT.finditer(a, at)]
        if cuts or at == 0:
            lo = cuts[-1] if cuts else 0
            break
        span *= 2
    span = 64
    while True:  # the first safe place in b; else all of it
        m = _CUT.search(b, 0, min(len(b), span))
        if m and m.start() > 0 or span >= len(b):
            hi = m.start() if m and m.start() > 0 else len(b)
            break
        span *= 2
    i, j = _tail(x, a, lo, size), _head(y, b, hi, size)
    del x[i:]
    x += encode(a[lo:] + b[:hi])
    x += y[j:] if j else y
    return a + b, x


def encode_tree(text: str, encode: Callable[[str], list[int]], size: Callable[[int], int], leaf: int = LEAF_CHARS) -> list[int]:
    def reduce(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            return text[lo:hi], encode(text[lo:hi])
        mid = (lo + hi) // 2
        return join(reduce(lo, mid), reduce(mid, hi), encode, size)

    return reduce(0, len(text))[1] if text else []


def decode_tree(ids: list[int], decode: Callable[[list[int]], bytes], leaf: int = LEAF_TOKENS) -> bytes:
    """Concatenation up the tree: decoding is a homomorphism, so halves need no care."""
    if len(ids) <= leaf:
        return decode(ids)
    mid = len(ids) // 2
    return decode_tree(ids[:mid], decode, leaf) + decode_tree(ids[mid:], decode, leaf)


def _chunks(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    for lo in range(0, len(column), rows):
        yield lo, [t or "" for t in column.slice(lo, rows).to_pylist()]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` array<int>: the token ids of the whole text; null and empty texts have none. Other columns pass unread; one named _ids is replaced."""
    docs = docs.drop("_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        sizes = _sizes(path, pattern)
        for b in batches:
            for lo, texts in _chunks(b.column(text)):
                ids = [encode_tree(t, enc.encode_ordinary, sizes.__getitem__) for t in texts]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, len(texts)) for c in b.columns], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "_ids"])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias("_ids")).schema)


@lru_cache(maxsize=4)
def _sizes(path: str, pattern: str) -> list[int]:
    enc = encoding(path, pattern)
    return [len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)]


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: the text encoded up the tree, and the ids decoded up the tree.

    Digests are lowercase hex of the decimal ids joined by commas, and of the decoded bytes. Null text counts as empty: 0 tokens, digests of
    the empty string. Rows are independent, so repeated rows and null ids give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        sizes = _sizes(path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            for lo, texts in _chunks(b.column("text")):
                n, coded, decoded = [], [], []
                for t in texts:
                    ids = encode_tree(t, enc.encode_ordinary, sizes.__getitem__)
                    n.append(len(ids))
                    coded.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode_tree(ids, enc.decode_bytes)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
