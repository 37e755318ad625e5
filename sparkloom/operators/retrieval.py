"""Retrieval and term statistics: postings, BM25, TF-IDF, cosine and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf, dl): one row for each term of a document, and the document's token count."""
    counted = _counted(docs.select(key, tokens.alias("_t")))
    return counted.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def _counted(df: DataFrame) -> DataFrame:
    """``df`` with ``dl``, the size of ``_t``: made before the tokens are exploded, so that it isn't made again for each of them."""
    return df.withColumn("dl", F.size("_t").cast("long"))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score, matched_terms) of documents that share a term with ``query``; a term repeated there counts again.

    One pass counts documents, lengths and the documents that hold each query term, into one row; a second one scores each document in its own
    row, after a plain test whether it holds a query term at all. Nothing is shuffled but partial sums.
    """
    spark = docs.sparkSession
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(T.bm25_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("qn")).orderBy("term").collect()
    asked = {r.term: r.qn for r in words}  # of the query, not of the corpus
    docs = spread(docs.select(key, F.col(text).alias("_text")))
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit("").alias("matched_terms")).limit(0)
    sized = docs.select(T.bm25_tokens(F.col("_text")).alias("_t"))
    held = [F.count_if(F.array_contains("_t", t)).alias(f"df{i}") for i, t in enumerate(asked)]
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"), *held)
    some = F.lit(False)
    for t in asked:
        some = some | F.contains(F.lower("_text"), F.lit(t))
    counts = [(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"tf{i}") for i, t in enumerate(asked)]
    found = docs.where(some).select(key, F.explode(F.array(T.bm25_tokens(F.col("_text")))).alias("_t")).select(key, F.size("_t").alias("dl"), *counts)
    score, matched = F.lit(0.0), []
    for i, (t, qn) in enumerate(asked.items()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + qn * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        matched.append(F.when(tf > 0, F.lit(t)))
    scored = found.crossJoin(F.broadcast(stats))  # one row of totals
    return scored.select(key, F.round(score, 6).alias("score"), F.concat_ws(",", *matched).alias("matched_terms")).where("score > 0")


def tfidf(segments: DataFrame, doc: str | list[str], seg: str, tokens: Column) -> DataFrame:
    """(doc, seg, term, tf, idf, tfidf): term frequency by segment, document frequency among the segments of a doc, which one or several columns name.

    A segment's terms and its document's number of segments are carried through one shuffle by (doc, term): how many segments hold a term is a window over it.
    """
    keys = [doc] if isinstance(doc, str) else doc
    sized = _counted(segments.select(*keys, seg, F.count("*").over(Window.partitionBy(*keys)).alias("n"), tokens.alias("_t")))
    counted = sized.select(*keys, seg, "n", F.col("dl").alias("len"), F.explode("_t").alias("term")).groupBy(*keys, "term", seg, "n", "len").agg(F.count("*").alias("c"))
    out = counted.withColumn("df", F.count("*").over(Window.partitionBy(*keys, "term")))
    return out.select(*keys, seg, "term", (F.col("c") / F.col("len")).alias("tf"), F.log(F.col("n") / F.col("df")).alias("idf")).withColumn("tfidf", F.col("tf") * F.col("idf"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors as doubles; 0 for different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, vector: str, query: Column, k: int) -> DataFrame:
    """The k best (key, score); a top-k report."""
    return vectors.select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(lexical: DataFrame, semantic: DataFrame, key: str, w_lex: float = 0.4, w_sem: float = 0.6, threshold: float = 0.5) -> DataFrame:
    """(key, score, bm25_score, semantic_score): hits of ``lexical`` (key, score) and of ``semantic`` (key, cos), the latter alone only from the threshold on."""
    top = lexical.agg(F.greatest(F.max("score"), F.lit(0.001)).alias("top"))
    both = lexical.withColumnRenamed("score", "bm25_score").join(semantic, key, "full_outer").crossJoin(F.broadcast(top))
    score = F.when(F.col("bm25_score").isNotNull(), w_lex * F.col("bm25_score") / F.col("top") + w_sem * F.coalesce("cos", F.lit(0.0))).when(F.col("cos") >= threshold, w_sem * F.col("cos"))
    return both.select(key, F.round(score, 6).alias("score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.round(F.coalesce("cos", F.lit(0.0)), 6).alias("semantic_score")).where("score is not null")
