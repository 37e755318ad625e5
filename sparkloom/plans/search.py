"""Queries of retrieval: BM25, TF-IDF, vectors and hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import compress, ordered, retrieval
from ..operators.segments import segment_content as segments_of
from ..sources.tables import spread
from . import duck as D
from . import inputs as I
from .registry import query

QUERY = "the and with license"


def bm25_sql(source: str, key: str, query: str) -> str:
    """CTEs up to bm (key, score, matched_terms) of the texts of ``source``."""
    return f"""tok AS (SELECT {key}, unnest({D.TOKENS.format(c='text')}) AS term FROM {source}),
  dl AS (SELECT {key}, len({D.TOKENS.format(c='text')}) AS dl FROM {source}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(string_split('{query}', ' ')) AS term) GROUP BY 1),
  tf AS (SELECT {key}, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  bm AS (SELECT {key}, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, string_agg(term, ',' ORDER BY term) AS matched_terms FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING ({key}), st GROUP BY 1)"""


_BM25 = bm25_sql("documents", "doc_id", QUERY)


@query("bm25_search", f"WITH {_BM25} SELECT doc_id, score, matched_terms FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark, sf_dir):
    """The 20 best documents for a fixed query."""
    return retrieval.bm25(I.table(spark, sf_dir, "documents"), "doc_id", "text", QUERY).orderBy(F.desc("score"), "doc_id").limit(20)


@query("bm25_stats", f"SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl, (SELECT count(DISTINCT w) FROM (SELECT unnest({D.TOKENS.format(c='text')}) AS w FROM documents)) AS vocabulary FROM (SELECT {D.TOKENS.format(c='text')} AS t FROM documents)")
def bm25_stats(spark, sf_dir):
    docs = spread(I.table(spark, sf_dir, "documents").select("text")).select(T.bm25_tokens(F.col("text")).alias("t"))
    words = docs.select(F.explode("t").alias("w")).agg(F.count_distinct("w").alias("vocabulary"))
    return docs.agg(F.count("*").alias("n"), F.round(F.avg(F.size("t")), 6).alias("avgdl")).crossJoin(words)


_SEG = "seg AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg FROM documents)"


def segments(spark, sf_dir):
    return spread(I.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg", "line"))


_TF = f"""{_SEG}, t AS (SELECT doc_id, seg, len({D.TF_TOKENS.format(c='line')}) AS l, unnest({D.TF_TOKENS.format(c='line')}) AS term FROM seg),
  tf AS (SELECT doc_id, seg, term, count(*) / CAST(any_value(l) AS DOUBLE) AS tf FROM t GROUP BY 1, 2, 3), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2), nn AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1),
  x AS (SELECT tf.doc_id, seg, term, tf, ln(n / CAST(df AS DOUBLE)) AS idf FROM tf JOIN df USING (doc_id, term) JOIN nn USING (doc_id))"""


def terms(spark, sf_dir):
    return retrieval.tfidf(segments(spark, sf_dir), "doc_id", "seg", T.tfidf_tokens(F.col("line")))


@query("tfidf_terms", f"WITH {_TF} SELECT doc_id, CAST(seg AS BIGINT) AS seg, term, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf FROM x")
def tfidf_terms(spark, sf_dir):
    return terms(spark, sf_dir).select("doc_id", F.col("seg").cast("long").alias("seg"), "term", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")])


@query("segment_tfidf", f"WITH {_TF} SELECT seg.doc_id, CAST(seg.seg AS BIGINT) AS seg, round(coalesce(s, 0), 6) AS score FROM seg LEFT JOIN (SELECT doc_id, seg, least(avg(tf * idf) / 2, 1) AS s FROM x GROUP BY 1, 2) y USING (doc_id, seg)")
def segment_tfidf(spark, sf_dir):
    score = terms(spark, sf_dir).groupBy("doc_id", "seg").agg(F.least(F.avg("tfidf") / 2, F.lit(1.0)).alias("s"))
    return segments(spark, sf_dir).join(score, ["doc_id", "seg"], "left").select("doc_id", F.col("seg").cast("long").alias("seg"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("score"))


@query("top_terms", f"WITH {_TF}, d AS (SELECT doc_id, term, round(max(tf * idf), 6) AS w FROM x GROUP BY 1, 2) SELECT doc_id, term, w FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) <= 5")
def top_terms(spark, sf_dir):
    d = terms(spark, sf_dir).groupBy("doc_id", "term").agg(F.round(F.max("tfidf"), 6).alias("w"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).where("r <= 5").drop("r")


_IMP = f"""{_TF}, sc AS (SELECT doc_id, seg, least(avg(tf * idf) / 2, 1) AS s FROM x GROUP BY 1, 2),
  imp AS (SELECT seg.doc_id, seg.seg, line, CAST(ceil(length(line) / 4.0) AS BIGINT) AS tokens, round((0.4 * coalesce(s, 0) + 0.3 * CASE WHEN p <= 0.1 OR p >= 0.9 THEN 1.0 WHEN p <= 0.2 OR p >= 0.8 THEN 0.85 WHEN p <= 0.3 OR p >= 0.7 THEN 0.7 ELSE 0.6 END + 0.3 * {D.keyword_boost('line')})::DOUBLE, 6) AS importance
    FROM (SELECT *, seg / CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE) AS p FROM seg) seg LEFT JOIN sc USING (doc_id, seg))"""


def importance(spark, sf_dir):
    """(doc_id, seg, line, tokens, importance): rare terms, place and keywords of each line, by the weights in rules."""
    x = segments(spark, sf_dir)
    score = retrieval.tfidf(x, "doc_id", "seg", T.tfidf_tokens(F.col("line"))).groupBy("doc_id", "seg").agg(F.least(F.avg("tfidf") / 2, F.lit(1.0)).alias("s"))
    x = x.withColumn("p", F.col("seg") / F.count("*").over(Window.partitionBy("doc_id"))).join(score, ["doc_id", "seg"], "left")
    parts = {"tfidf": F.coalesce("s", F.lit(0.0)), "position": T.position_weight(F.col("p")), "keyword": T.keyword_boost(F.col("line"))}
    value = sum((w * parts[k] for k, w in R.IMPORTANCE.items()), F.lit(0.0))
    return x.select("doc_id", "seg", "line", T.token_count(F.col("line")).alias("tokens"), F.round(value, 6).alias("importance"))


@query("segment_importance", f"WITH {_IMP} SELECT doc_id, CAST(seg AS BIGINT) AS seg, tokens, importance FROM imp")
def segment_importance(spark, sf_dir):
    return importance(spark, sf_dir).select("doc_id", F.col("seg").cast("long").alias("seg"), "tokens", "importance")


_KEPT = f"{_IMP}, g AS (SELECT doc_id, list({{'p': seg, 'c': tokens}} ORDER BY importance DESC, seg) AS xs, CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS budget FROM imp GROUP BY 1), kept AS (SELECT doc_id, list_sort({D.greedy('xs', 'budget')}) AS kept FROM g)"


@query("budget_select", f"WITH {_KEPT} SELECT * FROM kept")
def budget_select(spark, sf_dir):
    return budgeted(spark, sf_dir, 0.5)


def budgeted(spark, sf_dir, ratio: float):
    x = importance(spark, sf_dir).withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy("doc_id")) * ratio))
    return ordered.greedy_budget(x, "doc_id", "seg", F.col("importance"), F.col("tokens"), F.col("budget"))


def semantic_sql(ratio: str, source: str = "documents") -> str:
    made = f"""WITH {_IMP}, g AS (SELECT doc_id, list({{'p': seg, 'c': tokens}} ORDER BY importance DESC, seg) AS xs, CAST(floor(sum(tokens) * {ratio}) AS BIGINT) AS budget FROM imp GROUP BY 1), kept AS (SELECT doc_id, list_sort({D.greedy('xs', 'budget')}) AS kept FROM g),
  made AS (SELECT doc_id, text, array_to_string(list_transform(kept, lambda k: string_split(text, chr(10))[k + 1]), chr(10)) AS c FROM documents JOIN kept USING (doc_id))
  SELECT doc_id, CASE WHEN {D.tokens('text')} < 50 OR NOT contains(text, chr(10)) THEN text ELSE c END AS compressed, {D.tokens('text')} AS original_tokens FROM made"""
    return made.replace("FROM documents", f"FROM {source}")


@query("compress_semantic", semantic_sql("0.5"))
def compress_semantic(spark, sf_dir):
    """Each document cut to half its tokens: its most important lines that fit, in order; short or one-line documents stay."""
    return semantic(spark, sf_dir, 0.5)


def semantic(spark, sf_dir, ratio: float):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.join(budgeted(spark, sf_dir, ratio), "doc_id")
    lines = F.split("text", "\n")
    kept = F.array_join(F.transform("kept", lambda k: F.element_at(lines, (k + 1).cast("int"))), "\n")
    same = (T.token_count(F.col("text")) < 50) | (F.size(lines) <= 1)
    return out.select("doc_id", F.when(same, F.col("text")).otherwise(kept).alias("compressed"), T.token_count(F.col("text")).alias("original_tokens"))


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def cosines(spark, sf_dir):
    v = I.table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf_dir).limit(1)))  # one vector
    return v.select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


@query("cosine_topk", f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_Q0} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return cosines(spark, sf_dir).select("vec_id", F.col("cos").alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    "hybrid_search",
    f"WITH {_BM25}, top AS (SELECT greatest(max(score), 0.001) AS top FROM bm), c AS (SELECT vec_id AS doc_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_Q0} AS DOUBLE[])), 6) AS cos FROM embeddings), h AS (SELECT coalesce(bm.doc_id, c.doc_id) AS doc_id, bm.score AS b, cos FROM bm FULL JOIN c ON bm.doc_id = c.doc_id) SELECT doc_id, round(CASE WHEN b IS NOT NULL THEN 0.4 * b / top + 0.6 * coalesce(cos, 0) ELSE 0.6 * cos END, 6) AS score, coalesce(b, 0) AS bm25_score, coalesce(cos, 0) AS semantic_score FROM h, top WHERE b IS NOT NULL OR cos >= 0.5",
)


def hybrid_search(spark, sf_dir):
    lexical = retrieval.bm25(I.table(spark, sf_dir, "documents"), "doc_id", "text", QUERY).select("doc_id", "score")
    return retrieval.hybrid(lexical, cosines(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id")


# Real segments, of texts with fences, blank lines and errors: a line for each event of a user.

_MIXED = f"""{D.LOG_LINES}, mixed AS (SELECT doc_id, string_agg(CASE event_type WHEN 'purchase' THEN '' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '~~~' ELSE '```' END WHEN 'error' THEN '  failed request ' || event_id ELSE event_type || ' ' || event_id END, chr(10) ORDER BY pos) AS text FROM log_lines GROUP BY 1)"""
_BLOCKS = """b AS (SELECT doc_id, text, list_reduce(list_concat([{'start': CAST(NULL AS BIGINT), 'mark': '', 'done': []::STRUCT(s BIGINT, e BIGINT)[]}],
    list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'm': substring(trim(x), 1, 3)}), lambda v: v.m IN ('```', '~~~')), lambda v: {'start': v.i, 'mark': v.m, 'done': []::STRUCT(s BIGINT, e BIGINT)[]})),
    lambda a, m: CASE WHEN a.start IS NULL THEN {'start': m.start, 'mark': m.mark, 'done': a.done} WHEN a.mark = m.mark THEN {'start': CAST(NULL AS BIGINT), 'mark': a.mark, 'done': list_append(a.done, {'s': a.start, 'e': m.start})} ELSE a END) AS s FROM mixed),
  k AS (SELECT doc_id, text, CASE WHEN s.start IS NULL THEN s.done ELSE list_append(s.done, {'s': s.start, 'e': CAST(9007199254740992 AS BIGINT)}) END AS blocks FROM b),
  l AS (SELECT doc_id, blocks, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM k),
  m AS (SELECT doc_id, i, line, list_filter(blocks, lambda v: v.s <= i AND i <= v.e)[1].s AS block FROM l), n AS (SELECT *, block IS NULL AND trim(line) = '' AS blank FROM m),
  o AS (SELECT *, coalesce(lead(blank) OVER w, false) AS ended, CASE WHEN block IS DISTINCT FROM lag(block) OVER w OR coalesce(lag(blank) OVER w, true) THEN 1 ELSE 0 END AS fresh FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o), q AS (SELECT doc_id, g, min(i) AS start, max(i) AS stop, max(block) AS block, arg_max(ended, i) AS ended, count(*) AS c, string_agg(line, chr(10) ORDER BY i) AS whole, arg_max(line, i) AS last FROM p WHERE NOT blank GROUP BY 1, 2)"""
_SPLIT = f"q.block IS NULL AND q.ended AND q.c > 1 AND regexp_matches(q.whole, {D.q(R.KEYWORD_BOOST[0][1])})"
_TRIMMED = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("segment_content", f"WITH {_MIXED}, {_BLOCKS}, r AS (SELECT doc_id, start, stop, CASE WHEN block IS NULL THEN 'paragraph' ELSE 'code-block' END AS kind, CASE WHEN block IS NOT NULL AND regexp_matches(last, '^\\s*(```|~~~)') THEN whole ELSE {_TRIMMED.format(c='whole')} END AS segment FROM q WHERE NOT ({_SPLIT}) UNION ALL SELECT q.doc_id, p.i, p.i, 'line', {_TRIMMED.format(c='p.line')} FROM q JOIN p ON p.doc_id = q.doc_id AND p.g = q.g AND NOT p.blank WHERE {_SPLIT}) SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, kind, segment FROM r WHERE segment <> ''")
def segment_content(spark, sf_dir):
    """Fenced code, paragraphs, and the lines of paragraphs that tell errors."""
    kind, n = F.col("event_type"), F.col("event_id")
    line = F.when(kind == "purchase", "").when(kind == "signup", F.when(n % 3 == 0, "~~~").otherwise("```")).when(kind == "error", F.concat(F.lit("  failed request "), n)).otherwise(F.concat(kind, F.lit(" "), n))
    texts = compress.joined(I.log_lines(spark, sf_dir).withColumn("line", line), "doc_id", ["pos"], "line", "text")
    return segments_of(texts, "doc_id", "text")
