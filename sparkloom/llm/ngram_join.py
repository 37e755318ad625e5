"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import by_key, discard, materialize, semi_by_id, small
from .graph import components
from .rarity import Rarity, frequent, prefixes
from .similarity import cluster, links


def _prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, own, th, n, k1, k2, ell, tokens): set size, 128-bit key of the set, matches asked for, and the prefix tokens, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(Rarity(*frequent(docs, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.buffers(b.column("text"))
            for lo, hi in vec.slices(offsets):
                flat, rows = vec.distinct(vec.Words(data, offsets[lo : hi + 1], vec.NOT_SPACE), width)
                k1, k2 = vec.set_keys(flat, rows)
                ell, tokens, ends = prefixes(flat, rows, shared.value, percent)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in ("id", "own", "th")], pa.array(np.diff(rows)), pa.array(k1), pa.array(k2), pa.array(ell.astype(np.int32)), vec.lists(tokens, ends)],
                    ["id", "own", "th", "n", "k1", "k2", "ell", "tokens"],
                )

    return docs.mapInArrow(run, "id long, own long, th long, n long, k1 long, k2 long, ell int, tokens array<long>")


def _sets_of(docs: DataFrame, homes: DataFrame, width: int):
    """Shingle sets of classes: ``homes`` (node, id, th) says in which row a copy of each stands, which is read again. Repeated rows give repeated sets."""

    def sets_of(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = vec.buffers(b.column("text"))
                for lo, hi in vec.slices(offsets):
                    yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), vec.lists(*vec.distinct(vec.Words(data, offsets[lo : hi + 1], vec.NOT_SPACE), width))], ["node", "items"])

        wanted = small(semi_by_id(homes, nodes, "node").select("node", "id", "th"))
        return docs.select("id", "th", "text").join(wanted, ["id", "th"]).select("node", "text").mapInArrow(run, "node long, items array<long>")

    return sets_of


def _sieve(prefixes: DataFrame, percent: int):
    """Drops pairs whose prefixes share too little. ``prefixes``: (node, n, tokens).

    A link shares at least need = ceil(percent (n1 + n2) / (100 + percent)) items. Of the two, take the one whose prefix ends first in the common
    order: those of its prefix that the other's prefix lacks, the other lacks altogether, so prefix - shared <= n - need. As it isn't
    known which ends first, the weaker of the two conditions is asked for.
    """

    def sieve(pairs: DataFrame) -> DataFrame:
        wanted = materialize(semi_by_id(prefixes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"))
        x = wanted.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("x"))
        y = wanted.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "n1", "n2", F.size("x").alias("p1"), F.size("y").alias("p2"), F.size(F.array_intersect("x", "y")).alias("k"))
        need = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / (100 + percent) - 1e-9)
        out = materialize(both.where((F.col("k") >= F.col("p1") - F.col("n1") + need) | (F.col("k") >= F.col("p2") - F.col("n2") + need)).select("a", "b"))
        discard(wanted)
        return out

    return sieve


def ngram_jaccard(docs: DataFrame, width: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", count_links: bool = False, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``, n_links if ``count_links``, and _th, the xxhash64 of its text (null: empty), if ``with_hash``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of ``width`` words, the whole
    sequence if there are fewer. Two rows link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable by links, null where all of them are null. Null or wordless texts have the empty set and link with nothing. Each row is a document of its own,
    whatever its doc_id: rows that share one, or have none, link by their own texts. Columns of other names are not read.

    Equal sets are one class from the start, known by 128 bits, so copies cost one row each. A class posts its prefix: the n - ceil(percent n / 100) + ell
    rarest shingles; two linked sets share at least the smaller ell of them, ell rising with the candidates that the prefix would bring.

    n_links is the number of classes, that is of different sets, that the document's own links with; for it all candidate pairs are compared,
    while component_id alone leaves out those inside a component already known.
    """
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), texts.alias("text")).withColumn("th", F.xxhash64("text")).withColumn("id", F.coalesce("own", F.col("th")))
    base = materialize(_prefixes(rows.select("id", "own", "th", "text"), width, percent).withColumn("row", F.monotonically_increasing_id()))
    full = base.where("n > 0")
    classes = materialize(full.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("own").alias("least"), F.count("*").alias("copies")))
    several = classes.where("copies > 1")
    copies = materialize(by_key(full.select("row", "k1", "k2"), several, ["k1", "k2"], "copies").where("row <> node").select("row"))
    firsts = full.join(small(copies), "row", "left_anti").withColumnRenamed("row", "node")
    posts = firsts.select(F.posexplode("tokens").alias("pos", "key"), "node", "n", "ell")
    sets_of, sieve = _sets_of(rows, firsts.select("node", "id", "th"), width), _sieve(firsts.select("node", "n", "tokens"), percent)
    if count_links:
        pairs = links(posts, sets_of, percent, sieve)
        degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        clusters = components(pairs)
        found = clusters.join(degree, "node")
    else:
        clusters = cluster(posts, sets_of, percent, sieve)
        found = clusters.withColumn("n_links", F.lit(0).cast("long"))
    linked = found.join(classes.select("node", "least"), "node")
    lowest = materialize(linked.groupBy("component").agg(F.min("least").alias("lowest"), F.count("*").alias("size")))
    named = by_key(linked, lowest, ["component"], "size").select("node", "lowest", "n_links")
    told = materialize(classes.join(small(named), "node", "left").select("k1", "k2", "copies", F.when(F.col("n_links").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    discard(classes, copies, lowest, clusters)
    ids = by_key(full.select("own", "th", "n", "k1", "k2"), told, ["k1", "k2"], "copies")
    empty = base.where("n = 0").select("own", "th", "n", F.col("own").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = ids.select("own", "th", "n", "component_id", "n_links").unionByName(empty)
    more = [F.col("n_links")] * count_links + [F.col("th").alias("_th")] * with_hash
    return out.select(F.col("own").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", *more)
