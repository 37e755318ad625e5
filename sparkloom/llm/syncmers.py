"""Document fingerprints from closed syncmers of words, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record_id
from .order import range_bounds, range_number

#: A k-mer is five words, its inner substrings two; one closed syncmer in two positions is chosen on average.
K, S = 5, 2
_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Words up to so many characters are symbols; a longer one counts by its single characters, as in scripts without blanks.
LONG_WORD = 24
_WORD = f"[^{_SPACE}]"
_PIECES = f"(?<!{_WORD}){_WORD}{{1,{LONG_WORD}}}+(?!{_WORD})|{_WORD}"


def word_hashes(text: Column) -> Column:
    """Hashes of the symbols in order: words, runs of anything but ASCII white space, or the characters of words longer than LONG_WORD."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(text.rlike(f"{_WORD}{{{LONG_WORD + 1}}}"), F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))).otherwise(F.split(trimmed, f"[{_SPACE}]+"))
    return F.when(F.length(trimmed) > 0, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>> in order: the k-mers of symbols (see word_hashes) whose smallest inner s-mer is their first or last.

    Whether a k-mer is chosen depends on its own words only, so an edit disturbs no anchor but those whose words it touches. A text with words
    of which no k-mer is chosen, as any of fewer words than K, has one anchor, its whole sequence; without words it has none.
    """
    last = K - S  # the last inner s-mer

    def chosen(m: Column, i: Column) -> Column:
        edge = F.least(F.get(m, i), F.get(m, i + last))
        return edge <= F.least(*[F.get(m, i + j) for j in range(1, last)])

    def of(h: Column) -> Column:
        n = F.size(h)
        inner = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        many = _let(inner, lambda m: F.transform(F.filter(F.sequence(F.lit(0), n - K), lambda i: chosen(m, i)), lambda i: F.struct(i.alias("pos"), F.shiftright(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), 32).cast("int").alias("hash"))))
        one = F.array(F.struct(F.lit(0).alias("pos"), F.shiftright(F.xxhash64(h), 32).cast("int").alias("hash")))
        none = F.slice(one, 1, 0)
        return _let(F.when(n >= K, many).otherwise(none), lambda found: F.when(F.size(found) > 0, found).when(n > 0, one).otherwise(none))

    return _let(word_hashes(text), of)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda a: a["hash"])


def fingerprint(hashes: Column) -> Column:
    """Eight hex digits for each anchor, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two documents' anchor hashes, from 0 to 1; two without anchors are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def matches(a: Column, b: Column) -> Column:
    """Positional matching: array<struct<pos_a, pos_b>> of anchors of ``a`` that ``b`` has too, each with its first place in ``b``."""
    places = _let(hashes(b), lambda h: F.transform(a, lambda x: F.struct(x["pos"].alias("pos_a"), F.get(b, (F.array_position(h, x["hash"]) - 1).cast("int"))["pos"].alias("pos_b"))))
    return F.filter(places, lambda p: p["pos_b"].isNotNull())


def with_next(rows: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` for each of ``carry``: the values of the next row by (key, tie), after the last those of the first.

    Rows are dealt out by ranges of the key, and the first rows of each range also go to the range before it (of the first, to the last), where
    they only serve as a neighbour: one shuffle, and no task holds more than a range.
    """
    bounds = range_bounds(rows.select(key), key)
    if not bounds:
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in carry])
    n = len(bounds)
    starts = F.array(*[F.lit(b) for b in bounds])
    dealt = rows.withColumn("_range", range_number(F.col(key), bounds))
    before = F.when(F.col("_range") == 1, F.lit(n)).otherwise(F.col("_range") - 1)
    is_start = F.element_at(starts, F.col("_range")) == F.col(key)
    own = F.struct(F.col("_range").alias("part"), F.lit(0).alias("guard"))
    other = F.struct(before.cast("int").alias("part"), F.lit(1).alias("guard"))
    dealt = dealt.withColumn("_deal", F.explode(F.when(is_start, F.array(own, other)).otherwise(F.array(own))))
    order = Window.partitionBy("_deal.part").orderBy("_deal.guard", key, tie)
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return out.where("_deal.guard = 0").drop("_range", "_deal")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, hashes, next_text, next_hashes) for each row, in no order; ``hashes`` are the anchors' in order.

    Null text counts as empty. Next is by ascending doc_id, then text; null ids come first, by a number made from the text. Of an id with a large
    share of the rows, all rows lie in one range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), record_id(doc_id, text).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hashes", hashes(anchors(F.col("text")))).withColumn("n_chars", F.char_length("text").cast("long"))
    return with_next(rows, "id", "text", ["text", "hashes"]).select(F.col("own").alias("doc_id"), "text", "n_chars", "hashes", "next_text", "next_hashes")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last quarter replaced by the next document's beginning) and their likenesses."""
    rows = fingerprints(docs, doc_id, text)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("new", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    # each row's edited text and its anchors are computed once: explode keeps the optimizer from copying the expression
    rows = rows.select("doc_id", "n_chars", "hashes", "next_hashes", F.sha2("new", 256).alias("edited_sha256"), F.explode(F.array(hashes(anchors(F.col("new"))))).alias("new_hashes"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("hashes")).alias("fingerprint"),
        fingerprint(F.col("new_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("new_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
