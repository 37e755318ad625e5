"""Segments of texts: fenced code as a whole, paragraphs between blank lines, and single lines of paragraphs that tell errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def fences(lines: Column) -> Column:
    """array<struct<start, stop>> of the fenced blocks of a text's lines, from 0; a fence is closed by the next one of its mark, and ``stop`` is null for one that isn't."""
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.substring(F.trim(x), 1, 3).alias("mark")))
    marked = F.filter(marked, lambda m: m["mark"].isin("```", "~~~"))
    none = F.struct(F.lit(None).cast("int").alias("start"), F.lit("").alias("mark"), F.array().cast("array<struct<start:int,stop:int>>").alias("done"))

    def step(a: Column, m: Column) -> Column:
        closes = a["start"].isNotNull() & (a["mark"] == m["mark"])
        opens = a["start"].isNull()
        start = F.when(opens, m["i"]).when(closes, F.lit(None).cast("int")).otherwise(a["start"])
        done = F.when(closes, F.array_append(a["done"], F.struct(a["start"].alias("start"), m["i"].alias("stop")))).otherwise(a["done"])
        return F.struct(start.alias("start"), F.when(opens, m["mark"]).otherwise(a["mark"]).alias("mark"), done.alias("done"))

    def end(a: Column) -> Column:
        return F.when(a["start"].isNull(), a["done"]).otherwise(F.array_append(a["done"], F.struct(a["start"].alias("start"), F.lit(None).cast("int").alias("stop"))))

    return F.aggregate(marked, none, step, end)


def segment_content(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, stop, kind, segment) of each text: kind is code-block, paragraph or line; places are numbers of lines from 0.

    A paragraph of several lines that tells an error, and that a blank line ends, comes as its lines. Null and blank texts have no segments.
    """
    x = texts.select(key, F.split(F.col(text), "\n", -1).alias("lines")).withColumn("blocks", F.explode(F.array(fences(F.col("lines")))))
    x = x.select(key, "blocks", F.posexplode("lines").alias("i", "line"))
    inside = F.filter("blocks", lambda b: (b["start"] <= F.col("i")) & (b["stop"].isNull() | (F.col("i") <= b["stop"])))
    x = x.withColumn("block", F.try_element_at(inside, F.lit(1))["start"]).withColumn("blank", F.col("block").isNull() & (F.trim("line") == ""))
    order = Window.partitionBy(key).orderBy("i")
    fresh = ~(F.col("block").eqNullSafe(F.lag("block").over(order))) | F.coalesce(F.lag("blank").over(order), F.lit(True))
    x = x.withColumn("ended", F.coalesce(F.lead("blank").over(order), F.lit(False))).withColumn("fresh", fresh.cast("int")).withColumn("n", F.sum("fresh").over(order)).where(~F.col("blank"))
    g = x.groupBy(key, "n").agg(F.min("i").alias("start"), F.max("i").alias("stop"), F.max("block").alias("block"), F.max_by("ended", "i").alias("ended"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    whole = F.array_join(F.transform("ls", lambda v: v["line"]), "\n")
    code = F.col("block").isNotNull()
    split = ~code & F.col("ended") & (F.size("ls") > 1) & whole.rlike(T.java(R.KEYWORD_BOOST[0][1]))
    each = F.transform("ls", lambda v: F.struct(v["i"].alias("start"), v["i"].alias("stop"), F.lit("line").alias("kind"), T.space_trim(v["line"]).alias("segment")))
    one = F.array(F.struct(F.col("start").alias("start"), F.col("stop").alias("stop"), F.when(code, "code-block").otherwise("paragraph").alias("kind"), F.when(code & F.col("ls")[F.size("ls") - 1]["line"].rlike(r"^\s*(```|~~~)"), whole).otherwise(T.space_trim(whole)).alias("segment")))
    return g.select(key, F.explode(F.when(split, each).otherwise(one)).alias("s")).select(key, "s.start", "s.stop", "s.kind", "s.segment").where("segment <> ''")
