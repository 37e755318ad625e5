"""Greedy leader clustering of messages by edit similarity, in input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether 1 - edit distance / longer length is at least ``threshold``. Lengths that differ too much are told apart without comparing."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    return F.when(F.abs(F.length(a) - F.length(b)) > most, False).otherwise(F.call_function("levenshtein", a, b, most) >= 0)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def heads(texts: Column, threshold: float) -> Column:
    """The texts of an array that no earlier head is like, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(texts, none, lambda acc, t: F.when(F.exists(acc, lambda h: alike(h, t, threshold)), acc).otherwise(F.array_append(acc, t)))


def first_alike(candidates: Column, text: Column, threshold: float) -> Column:
    return F.try_element_at(F.filter(candidates, lambda h: alike(h, text, threshold)), F.lit(1))


def leaders(df: DataFrame, doc: str, pos: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(doc, text, first, n, leader): distinct texts of a document, where each stands first, how often, and the text that leads its cluster.

    A text joins the first earlier leader that is similar enough, else it leads. Equal texts share a leader, so only distinct ones are
    compared, each with the leaders so far; a document's distinct texts are one row's work, since each choice depends on those before it.
    Null texts have no row.
    """
    distinct = df.where(F.col(text).isNotNull()).groupBy(doc, text).agg(F.min(pos).cast("long").alias("first"), F.count("*").alias("n"))
    g = distinct.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("first", F.col(text).alias("t"), "n"))).alias("items"))
    g = g.withColumn("heads", heads(F.transform("items", lambda x: x["t"]), threshold))
    x = g.select(doc, "heads", F.explode("items").alias("i"))
    return x.select(doc, F.col("i.t").alias(text), "i.first", "i.n", first_alike(F.col("heads"), F.col("i.t"), threshold).alias("leader"))
