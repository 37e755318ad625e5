"""Queries over log lines: grouping, scoring, templates, chunks, requests and retries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import ordered, retrieval
from . import duck as D
from . import inputs as I
from .registry import query
from .scalars import error_parts, http_requests


def first_by(c: str, pos: str):
    return F.min_by(c, pos)


_NORM = f"trim(lower({D.rewrite('message', R.LOG_GROUPING)}))"


@query("dedup_log_entries", f"WITH {D.LOG_LINES} SELECT doc_id, {_NORM} AS signature, arg_min(message, pos) AS sample, count(*) AS n FROM log_lines GROUP BY 1, 2")
def dedup_log_entries(spark, sf_dir):
    x = I.log_lines(spark, sf_dir).withColumn("signature", T.normalize_log_grouping(F.col("message")))
    return x.groupBy("doc_id", "signature").agg(first_by("message", "pos").alias("sample"), F.count("*").alias("n"))


_LINE = f"trim({D.rewrite('raw', R.LOG_LINE)})"


@query("log_line_groups", f"WITH {D.LOG_LINES}, g AS (SELECT *, {_LINE} AS norm FROM log_lines) SELECT doc_id, norm, arg_min(raw, pos) AS sample, count(*) AS n, arg_min(lvl = 'error', pos) AS has_error, arg_min(lvl = 'warning', pos) AS has_warning FROM g GROUP BY 1, 2")
def log_line_groups(spark, sf_dir):
    x = I.log_lines(spark, sf_dir).withColumn("norm", T.normalize_log_line(F.col("raw")))
    return x.groupBy("doc_id", "norm").agg(first_by("raw", "pos").alias("sample"), F.count("*").alias("n"), F.min_by(F.col("lvl") == "error", "pos").alias("has_error"), F.min_by(F.col("lvl") == "warning", "pos").alias("has_warning"))


_GEN = f"trim({D.rewrite('raw', R.GENERIC_LINE)})"


@query("generic_line_groups", f"WITH {D.LOG_LINES} SELECT doc_id, {_GEN} AS norm, arg_min(raw, pos) AS sample, count(*) AS n, bool_or(lvl = 'error') AS has_error FROM log_lines GROUP BY 1, 2")
def generic_line_groups(spark, sf_dir):
    x = I.log_lines(spark, sf_dir).withColumn("norm", T.normalize_generic(F.col("raw")))
    return x.groupBy("doc_id", "norm").agg(first_by("raw", "pos").alias("sample"), F.count("*").alias("n"), F.bool_or(F.col("lvl") == "error").alias("has_error"))


@query("run_length_lines", f"WITH {D.LOG_LINES}, a AS (SELECT doc_id, pos, event_type AS v, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM log_lines), b AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM a) SELECT doc_id, min(pos) AS start, any_value(v) AS value, count(*) AS length FROM b GROUP BY doc_id, run")
def run_length_lines(spark, sf_dir):
    return ordered.runs(I.log_lines(spark, sf_dir), "doc_id", "pos", F.col("event_type"))


@query("log_timespan", f"WITH {D.LOG_LINES} SELECT doc_id, min(ts_text) AS start, max(ts_text) AS stop, CAST(epoch(max(CAST(ts_text AS TIMESTAMP))) - epoch(min(CAST(ts_text AS TIMESTAMP))) AS BIGINT) * 1000 AS duration_ms FROM log_lines GROUP BY 1 HAVING count(*) >= 2")
def log_timespan(spark, sf_dir):
    t = F.unix_timestamp("ts_text")
    out = I.log_lines(spark, sf_dir).groupBy("doc_id").agg(F.min("ts_text").alias("start"), F.max("ts_text").alias("stop"), ((F.max(t) - F.min(t)) * 1000).alias("duration_ms"), F.count("*").alias("n"))
    return out.where("n >= 2").drop("n")


@query("log_timeframe", f"WITH {D.LOG_LINES} SELECT event_id, ts_text FROM log_lines WHERE CAST(ts_text AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def log_timeframe(spark, sf_dir):
    t = F.try_to_timestamp("ts_text")
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-10 12:00:00"))
    return I.log_lines(spark, sf_dir).where(t.isNull() | t.between(lo, hi)).select("event_id", "ts_text")


@query("events_per_minute", f"WITH {D.LOG_LINES} SELECT substr(ts_text, 1, 16) AS minute, count(*) AS n FROM log_lines GROUP BY 1")
def events_per_minute(spark, sf_dir):
    return I.log_lines(spark, sf_dir).groupBy(F.substring("ts_text", 1, 16).alias("minute")).agg(F.count("*").alias("n"))


@query("activity_spike", f"WITH {D.LOG_LINES}, m AS (SELECT substr(ts_text, 1, 16) AS minute, count(*) AS n FROM log_lines GROUP BY 1) SELECT max(n) AS peak, round(max(n) / avg(n), 6) AS ratio, max(n) > 3 * avg(n) AS spike FROM m")
def activity_spike(spark, sf_dir):
    m = I.log_lines(spark, sf_dir).groupBy(F.substring("ts_text", 1, 16)).agg(F.count("*").alias("n"))
    return m.agg(F.max("n").alias("peak"), F.round(F.max("n") / F.avg("n"), 6).alias("ratio"), (F.max("n") > 3 * F.avg("n")).alias("spike"))


@query("log_level_counts", f"WITH {D.LOG_LINES} SELECT doc_id, count(*) FILTER (lvl = 'error') AS errors, count(*) FILTER (lvl = 'warning') AS warnings, count(*) FILTER (lvl = 'info') AS infos, count(*) FILTER (lvl = 'debug') AS debugs FROM log_lines GROUP BY 1")
def log_level_counts(spark, sf_dir):
    level = T.log_level(F.regexp_extract(F.col("raw"), r"\[(\w+)\]", 1))
    return I.log_lines(spark, sf_dir).groupBy("doc_id").agg(*[F.count_if(level == k).alias(n) for k, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"), ("debug", "debugs"))])


@query("chunk_by_size", f"WITH {D.LOG_LINES} SELECT doc_id, (pos - 1) // 20 AS chunk, count(*) AS n, min(pos) AS first_pos FROM log_lines GROUP BY 1, 2")
def chunk_by_size(spark, sf_dir):
    return I.log_lines(spark, sf_dir).groupBy("doc_id", F.floor((F.col("pos") - 1) / 20).alias("chunk")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("chunk_by_time", f"""WITH RECURSIVE {D.LOG_LINES}, x AS (SELECT doc_id, pos, CAST(epoch(CAST(ts_text AS TIMESTAMP)) AS BIGINT) AS s FROM log_lines),
  r AS (SELECT doc_id, pos, s, s AS anchor, CAST(0 AS BIGINT) AS chunk FROM x WHERE pos = 1
    UNION ALL SELECT x.doc_id, x.pos, x.s, CASE WHEN x.s - r.anchor >= 259200 THEN x.s ELSE r.anchor END, CASE WHEN x.s - r.anchor >= 259200 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN x ON x.doc_id = r.doc_id AND x.pos = r.pos + 1)
  SELECT doc_id, chunk, min(s) AS start, count(*) AS n FROM r GROUP BY 1, 2""")


def chunk_by_time(spark, sf_dir):
    return ordered.anchored_chunks(I.log_lines(spark, sf_dir), "doc_id", "pos", F.unix_timestamp("ts_text"), 3 * 24 * 3600)


_TPL = D.rewrite("message", R.TEMPLATE)


@query("log_patterns", f"WITH {D.LOG_LINES} SELECT {_TPL} AS template, count(*) AS occurrences, min(ts_text) AS first_seen, max(ts_text) AS last_seen FROM log_lines GROUP BY 1")
def log_patterns(spark, sf_dir):
    return I.log_lines(spark, sf_dir).groupBy(T.log_template(F.col("message")).alias("template")).agg(F.count("*").alias("occurrences"), F.min("ts_text").alias("first_seen"), F.max("ts_text").alias("last_seen"))


@query("pattern_importance", f"WITH {D.LOG_LINES}, p AS (SELECT doc_id, {_TPL} AS template, count(*) AS n FROM log_lines GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM p) SELECT doc_id, template, round(least(1.0, least(n / total, 1) * 0.4 + CASE WHEN n < 5 THEN 0.8 WHEN n < 20 THEN 0.5 ELSE 0.2 END * 0.3 + CASE WHEN regexp_matches(lower(template), 'error|exception|failed|crash|fatal') THEN 0.3 ELSE 0 END - least(len(regexp_extract_all(template, '<[A-Z]+>')) * 0.05, 0.3))::DOUBLE, 6) AS importance FROM t")
def pattern_importance(spark, sf_dir):
    p = I.log_lines(spark, sf_dir).groupBy("doc_id", T.log_template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))
    p = p.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    n = F.col("n")
    variables = F.size(F.regexp_extract_all("template", F.lit("<[A-Z]+>"), F.lit(0)))
    score = F.least(n / F.col("total"), F.lit(1.0)) * 0.4 + F.when(n < 5, 0.8).when(n < 20, 0.5).otherwise(0.2) * 0.3 + F.when(F.lower("template").rlike("error|exception|failed|crash|fatal"), 0.3).otherwise(0.0) - F.least(variables * 0.05, F.lit(0.3))
    return p.select("doc_id", "template", F.round(F.least(F.lit(1.0), score), 6).alias("importance"))


@query("anomalous_patterns", f"WITH {D.LOG_LINES}, p AS (SELECT doc_id, {_TPL} AS template, count(*) AS n FROM log_lines GROUP BY 1, 2), t AS (SELECT *, avg(n) OVER (PARTITION BY doc_id) AS mean FROM p) SELECT doc_id, template, n FROM t WHERE n < mean * 0.9 AND (regexp_matches(template, '(?i)error|exception|fail|crash|timeout|refused') OR n = 1)")
def anomalous_patterns(spark, sf_dir):
    p = I.log_lines(spark, sf_dir).groupBy("doc_id", T.log_template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))
    p = p.withColumn("mean", F.avg("n").over(Window.partitionBy("doc_id")))
    return p.where((F.col("n") < F.col("mean") * 0.9) & (F.col("template").rlike("(?i)error|exception|fail|crash|timeout|refused") | (F.col("n") == 1))).select("doc_id", "template", "n")


@query("common_patterns", f"WITH {D.LOG_LINES}, p AS (SELECT doc_id, {_TPL} AS template, count(*) AS n FROM log_lines GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, template, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, template) AS r FROM p) WHERE r <= 3")
def common_patterns(spark, sf_dir):
    p = I.log_lines(spark, sf_dir).groupBy("doc_id", T.log_template(F.col("message")).alias("template")).agg(F.count("*").alias("n")).where("n > 1")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "template"))).where("r <= 3").drop("r")


@query("match_pattern", f"WITH {D.LOG_LINES}, p AS (SELECT DISTINCT {_TPL} AS template FROM log_lines WHERE event_type = 'error') SELECT event_id, template IS NOT NULL AS matched FROM (SELECT event_id, {_TPL} AS t FROM log_lines) l LEFT JOIN p ON p.template = l.t")
def match_pattern(spark, sf_dir):
    x = I.log_lines(spark, sf_dir).select("event_id", "event_type", T.log_template(F.col("message")).alias("template"))
    known = x.where("event_type = 'error'").select("template").distinct().withColumn("known", F.lit(True))
    return x.join(known, "template", "left").select("event_id", F.coalesce("known", F.lit(False)).alias("matched"))


def scores_sql(source: str, keys: str, out: str) -> str:
    """CTEs up to ``out`` (keys, pos, lvl, score) of the entries of ``source`` (keys, pos, lvl, message), scored among those with the same keys."""
    order, terms = f"PARTITION BY {keys} ORDER BY pos", D.TF_TOKENS.format(c="message")
    return f"""{out}_tok AS (SELECT {keys}, pos, lvl, {terms} AS ts, trim({D.rewrite('lower(message)', R.LOG_PATTERN)}) AS pat, row_number() OVER ({order}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
  {out}_tt AS (SELECT {keys}, pos, len(ts) AS l, unnest(ts) AS term FROM {out}_tok), {out}_tf AS (SELECT {keys}, pos, term, count(*) / CAST(any_value(l) AS DOUBLE) AS tf FROM {out}_tt GROUP BY {keys}, pos, term),
  {out}_df AS (SELECT {keys}, term, count(*) AS df FROM {out}_tf GROUP BY {keys}, term), {out}_nn AS (SELECT {keys}, count(*) AS nn FROM {source} GROUP BY {keys}),
  {out}_seg AS (SELECT {keys}, pos, least(avg(tf * ln(nn / CAST(df AS DOUBLE))) / 2, 1) AS s FROM {out}_tf JOIN {out}_df USING ({keys}, term) JOIN {out}_nn USING ({keys}) GROUP BY {keys}, pos),
  {out}_f AS (SELECT {keys}, pat, count(*) AS c FROM {out}_tok GROUP BY {keys}, pat), {out}_mx AS (SELECT {keys}, max(c) AS m FROM {out}_f GROUP BY {keys}),
  {out} AS (SELECT {keys}, pos, lvl, round(greatest(0, least(1, CASE lvl WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.1 END * 0.3 + coalesce(s, 0) * 0.3
    + CASE WHEN n <= 1 THEN 1.0 WHEN i < 5 THEN 1 - i / 5.0 * 0.3 WHEN n - 1 - i < 5 THEN 0.7 + (1 - (n - 1 - i) / 5.0) * 0.3 ELSE 0.3 + 0.8 * abs((i - 5) / CAST(n - 10 AS DOUBLE) - 0.5) END * 0.2
    + (1 - c / CAST(m AS DOUBLE)) * 0.2))::DOUBLE, 6) AS score FROM {out}_tok LEFT JOIN {out}_seg USING ({keys}, pos) JOIN {out}_f USING ({keys}, pat) JOIN {out}_mx USING ({keys}))"""


_SCORES = f"{D.LOG_LINES}, {scores_sql('log_lines', 'doc_id', 'log_scores')}"


def scores(x, keys: list[str]):
    """``x`` (keys, pos, lvl, message ...) with ``score``, from 0 to 1 among the entries with the same keys: level, rare terms, place and rarity of the message's shape."""
    terms = retrieval.tfidf(x, keys, "pos", T.tfidf_tokens(F.col("message")))
    seg = terms.groupBy(*keys, "pos").agg(F.least(F.avg("tfidf") / 2, F.lit(1.0)).alias("_s"))
    group = Window.partitionBy(*keys)
    y = x.withColumn("_i", F.row_number().over(group.orderBy("pos")) - 1).withColumn("_n", F.count("*").over(group))
    y = y.withColumn("_c", F.count("*").over(Window.partitionBy(*keys, T.normalize_log_pattern(F.col("message")))))
    y = y.withColumn("_m", F.max("_c").over(group)).join(seg, [*keys, "pos"], "left")
    score = T.level_score(F.col("lvl")) * 0.3 + F.coalesce("_s", F.lit(0.0)) * 0.3 + T.position_score(F.col("_i"), F.col("_n")) * 0.2 + (1 - F.col("_c") / F.col("_m")) * 0.2
    return y.select(*x.columns, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


def scored(spark, sf_dir):
    return scores(I.log_lines(spark, sf_dir).select("doc_id", "pos", "lvl", "message"), ["doc_id"]).drop("message")


@query("log_scores", f"WITH {_SCORES} SELECT * FROM log_scores")
def log_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@query("score_distribution", f"WITH {_SCORES} SELECT doc_id, count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (score >= 0.4 AND score < 0.7) AS medium, count(*) FILTER (score < 0.4) AS low FROM log_scores GROUP BY 1")
def score_distribution(spark, sf_dir):
    s = F.col("score")
    return scored(spark, sf_dir).groupBy("doc_id").agg(F.count_if(s >= 0.7).alias("high"), F.count_if((s >= 0.4) & (s < 0.7)).alias("medium"), F.count_if(s < 0.4).alias("low"))


@query("rank_logs", f"WITH {_SCORES} SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM log_scores")
def rank_logs(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "pos", "score", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")).cast("long").alias("rank"))


@query("topk_logs", f"WITH {_SCORES} SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM log_scores) WHERE r <= 5")
def topk_logs(spark, sf_dir):
    return rank_logs(spark, sf_dir).where("rank <= 5").drop("rank")


@query("topk_per_level", f"WITH {_SCORES} SELECT doc_id, lvl, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lvl ORDER BY score DESC, pos) AS r FROM log_scores) WHERE r <= 2")
def topk_per_level(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "lvl").orderBy(F.desc("score"), "pos")))
    return x.where("r <= 2").select("doc_id", "lvl", "pos", "score")


@query("balanced_topk", f"WITH {_SCORES} SELECT doc_id, lvl, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lvl ORDER BY score DESC, pos) AS r FROM log_scores) WHERE r <= CASE lvl WHEN 'error' THEN 5 WHEN 'warning' THEN 3 WHEN 'info' THEN 2 ELSE 0 END")
def balanced_topk(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "lvl").orderBy(F.desc("score"), "pos")))
    most = F.when(F.col("lvl") == "error", 5).when(F.col("lvl") == "warning", 3).when(F.col("lvl") == "info", 2).otherwise(0)
    return x.where(F.col("r") <= most).select("doc_id", "lvl", "pos")


_REQ = f"{D.HTTP_LINES}, req AS (SELECT event_id, 'GET' AS method, regexp_replace(regexp_replace(regexp_extract(raw, 'GET (\\S+)', 1), '\\?.*', '', 'g'), '/\\d+', '/:id', 'g') AS path, CAST(regexp_extract(raw, ' (\\d+) \\d+ms$', 1) AS INTEGER) AS status, CAST(regexp_extract(raw, '(\\d+)ms$', 1) AS DOUBLE) AS t FROM http_lines)"


@query("endpoint_stats", f"WITH {_REQ} SELECT method, path, status, count(*) AS n, round(sum(t) / count(*), 4) AS avg_time, count(*) FILTER (status >= 400) AS errors FROM req GROUP BY 1, 2, 3")
def endpoint_stats(spark, sf_dir):
    r = http_requests(I.http_lines(spark, sf_dir)).withColumn("path", T.normalize_http_path(F.col("path")))
    return r.groupBy("method", "path", "status").agg(F.count("*").alias("n"), F.round(F.sum("response_ms") / F.count("*"), 4).alias("avg_time"), F.count_if(F.col("status") >= 400).alias("errors"))


@query("status_histogram", f"WITH {_REQ} SELECT status, count(*) AS n FROM req GROUP BY 1")
def status_histogram(spark, sf_dir):
    return http_requests(I.http_lines(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("avg_response", f"WITH {_REQ} SELECT CAST(floor(avg(t) + 0.5) AS BIGINT) AS avg_ms FROM req")
def avg_response(spark, sf_dir):
    return http_requests(I.http_lines(spark, sf_dir)).agg(T.js_round(F.avg("response_ms")).alias("avg_ms"))


@query("detect_log_type", f"WITH {D.LOG_LINES}, r AS (SELECT doc_id, " + ", ".join(f"avg(CASE WHEN {D.any_of('raw', p)} THEN 1.0 ELSE 0 END) AS {k}" for k, _, p in R.LOG_TYPES) + " FROM log_lines GROUP BY 1) SELECT doc_id, CASE " + " ".join(f"WHEN {k} >= {t} THEN '{k}'" for k, t, _ in R.LOG_TYPES) + " ELSE 'generic' END AS log_type FROM r")
def detect_log_type(spark, sf_dir):
    r = I.log_lines(spark, sf_dir).groupBy("doc_id").agg(*[F.avg(T.any_of(F.col("raw"), p).cast("double")).alias(k) for k, _, p in R.LOG_TYPES])
    out = F.lit("generic")
    for k, t, _ in reversed(R.LOG_TYPES):
        out = F.when(F.col(k) >= t, k).otherwise(out)
    return r.select("doc_id", out.alias("log_type"))


@query("parse_tsc", f"WITH {D.BUILD_LINES} SELECT doc_id, pos, regexp_extract(raw, {D.q(R.TSC)}, 1) AS file, CAST(regexp_extract(raw, {D.q(R.TSC)}, 2) AS INTEGER) AS line, CAST(regexp_extract(raw, {D.q(R.TSC)}, 3) AS INTEGER) AS col, regexp_extract(raw, {D.q(R.TSC)}, 4) AS severity, regexp_extract(raw, {D.q(R.TSC)}, 5) AS code, regexp_extract(raw, {D.q(R.TSC)}, 6) AS message FROM build_lines")
def parse_tsc(spark, sf_dir):
    return tsc(I.build_lines(spark, sf_dir)).select("doc_id", "pos", "file", "line", "col", "severity", "code", "message")


def tsc(lines):
    p = T.java(R.TSC)
    names = ("file", "line", "col", "severity", "code", "message")
    parts = {n: F.regexp_extract(F.col("raw"), p, k + 1) for k, n in enumerate(names)}
    return lines.where(F.col("raw").rlike(p)).withColumns(parts | {n: parts[n].cast("int") for n in ("line", "col")})


_TSIG = f"regexp_extract(raw, {D.q(R.TSC)}, 5) || ':' || trim({D.rewrite(f'regexp_extract(raw, {D.q(R.TSC)}, 6)', R.TSC_MESSAGE)})"


@query("group_errors", f"WITH {D.BUILD_LINES} SELECT doc_id, {_TSIG} AS signature, count(*) AS n, arg_min(raw, pos) AS first_raw, count(DISTINCT regexp_extract(raw, {D.q(R.TSC)}, 1)) AS files FROM build_lines GROUP BY 1, 2")
def group_errors(spark, sf_dir):
    x = tsc(I.build_lines(spark, sf_dir)).withColumn("signature", F.concat("code", F.lit(":"), F.trim(T.rewrite(F.col("message"), R.TSC_MESSAGE))))
    return x.groupBy("doc_id", "signature").agg(F.count("*").alias("n"), first_by("raw", "pos").alias("first_raw"), F.count_distinct("file").alias("files"))


_ESIG = f"regexp_extract(raw, {D.q(R.TSC)}, 5) || ': ' || trim({D.rewrite(f'regexp_extract(raw, {D.q(R.TSC)}, 6)', R.NORMALIZE_ERROR)})"


@query("dedup_errors", f"WITH {D.BUILD_LINES} SELECT doc_id, {_ESIG} AS signature, count(*) AS n, arg_min(raw, pos) AS sample FROM build_lines GROUP BY 1, 2 HAVING count(*) >= 2")
def dedup_errors(spark, sf_dir):
    return signatures(I.build_lines(spark, sf_dir)).where("n >= 2").drop("first")


def signatures(lines):
    """(doc_id, signature, n, sample, first): errors of one shape. Equal messages are put together before they are normalised, which costs far more than counting."""
    x = error_parts(lines).groupBy("doc_id", "code", "message").agg(F.count("*").alias("n"), F.min(F.struct("pos", "raw")).alias("at"))
    x = x.withColumn("signature", F.concat_ws(": ", F.nullif("code", F.lit("")), T.normalize_error(F.col("message"))))
    return x.groupBy("doc_id", "signature").agg(F.sum("n").alias("n"), F.min("at").alias("at")).select("doc_id", "signature", "n", F.col("at.raw").alias("sample"), F.col("at.pos").alias("first"))


@query("dedup_stats", f"WITH {D.BUILD_LINES}, g AS (SELECT doc_id, {_ESIG} AS s, count(*) AS n FROM build_lines GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_errors, CAST(floor((1 - count(*) / CAST(sum(n) AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS reduction FROM g GROUP BY 1")
def dedup_stats(spark, sf_dir):
    g = signatures(I.build_lines(spark, sf_dir))
    return g.groupBy("doc_id").agg(F.sum("n").alias("total"), F.count("*").alias("unique_errors"), T.js_round((1 - F.count("*") / F.sum("n")) * 100).alias("reduction"))


@query("build_stats", f"WITH {D.BUILD_LINES}, c AS (SELECT doc_id, regexp_extract(raw, 'TS\\d+') AS code, count(*) AS n FROM build_lines GROUP BY 1, 2) SELECT doc_id, code, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS r FROM c) WHERE r <= 3")
def build_stats(spark, sf_dir):
    c = tsc(I.build_lines(spark, sf_dir)).groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "code"))).where("r <= 3").drop("r")


@query("suggestions", f"WITH {D.BUILD_LINES} SELECT doc_id, pos, h.hint FROM build_lines JOIN (VALUES " + ", ".join(f"({D.q(k)}, {D.q(v)})" for k, v in R.COMPILER_HINTS.items()) + ") h(code, hint) ON regexp_extract(raw, 'TS\\d+') = h.code")
def suggestions(spark, sf_dir):
    hints = spark.createDataFrame(list(R.COMPILER_HINTS.items()), "code string, hint string")
    return tsc(I.build_lines(spark, sf_dir)).join(F.broadcast(hints), "code").select("doc_id", "pos", "hint")


_LINT = "lint AS (SELECT o_custkey AS doc_id, 0 AS pos, '/a/c' || o_custkey || '.ts' AS raw FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '  ' || (o_orderkey % 100) || ':' || (o_orderkey % 7) || '  error  Message ' || (o_orderkey % 5) || '  no-undef' FROM orders)"


def lint_lines(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    head = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("/a/c"), "doc_id", F.lit(".ts")).alias("raw"))
    body = F.concat(F.lit("  "), k % 100, F.lit(":"), k % 7, F.lit("  error  Message "), k % 5, F.lit("  no-undef"))
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("pos"), body.alias("raw"))
    return head.unionByName(rows)


@query("ffill_header", f"WITH {_LINT} SELECT doc_id, pos, last_value(CASE WHEN regexp_matches(raw, {D.q(R.LINT_FILE)}) THEN raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS file FROM lint")
def ffill_header(spark, sf_dir):
    header = F.when(F.col("raw").rlike(T.java(R.LINT_FILE)), F.col("raw"))
    return lint_lines(spark, sf_dir).select("doc_id", "pos", ordered.ffill(header, "doc_id", "pos").alias("file"))


@query("parse_eslint", f"WITH {_LINT} SELECT doc_id, pos, '/a/c' || doc_id || '.ts' AS file, CAST(regexp_extract(raw, {D.q(R.LINT_ROW)}, 1) AS INTEGER) AS line, CAST(regexp_extract(raw, {D.q(R.LINT_ROW)}, 2) AS INTEGER) AS col, regexp_extract(raw, {D.q(R.LINT_ROW)}, 4) AS message, regexp_extract(raw, {D.q(R.LINT_ROW)}, 5) AS code FROM lint WHERE regexp_matches(raw, {D.q(R.LINT_ROW)})")
def parse_eslint(spark, sf_dir):
    p = T.java(R.LINT_ROW)
    x = lint_lines(spark, sf_dir).withColumn("file", ordered.ffill(F.when(F.col("raw").rlike(T.java(R.LINT_FILE)), F.col("raw")), "doc_id", "pos")).where(F.col("raw").rlike(p))
    return x.select("doc_id", "pos", "file", F.regexp_extract(F.col("raw"), p, 1).cast("int").alias("line"), F.regexp_extract(F.col("raw"), p, 2).cast("int").alias("col"), F.regexp_extract(F.col("raw"), p, 4).alias("message"), F.regexp_extract(F.col("raw"), p, 5).alias("code"))


_CN = f"trim({D.rewrite('cmd', R.COMMAND)})"


@query("retry_groups", f"WITH {D.COMMANDS}, g AS (SELECT doc_id, {_CN} AS norm, count(*) AS n, min(pos) AS first_pos FROM commands GROUP BY 1, 2) SELECT doc_id, norm, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS r FROM g) WHERE r = 1")
def retry_groups(spark, sf_dir):
    g = I.commands(spark, sf_dir).groupBy("doc_id", T.normalize_command(F.col("cmd")).alias("norm")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return g.groupBy("doc_id").agg(F.max_by(F.struct("norm", "n"), F.struct("n", -F.col("first_pos"))).alias("top")).select("doc_id", "top.norm", "top.n")


@query("trailing_run", f"WITH {D.COMMANDS}, c AS (SELECT doc_id, pos, {_CN} AS norm, last_value({_CN}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM commands) SELECT doc_id, max(pos) - coalesce(max(pos) FILTER (norm <> final), 0) AS run FROM c GROUP BY 1")
def trailing_run(spark, sf_dir):
    c = I.commands(spark, sf_dir).withColumn("norm", T.normalize_command(F.col("cmd")))
    last = c.groupBy("doc_id").agg(F.max_by("norm", "pos").alias("final"))
    return c.join(last, "doc_id").groupBy("doc_id").agg((F.max("pos") - F.coalesce(F.max(F.when(F.col("norm") != F.col("final"), F.col("pos"))), F.lit(0))).alias("run"))


@query("session_stats", "SELECT event_type AS tool, count(*) AS calls, CAST(sum(floor(value * 100)) AS BIGINT) AS tokens_in, CAST(sum(floor(value * 40)) AS BIGINT) AS tokens_out, CAST(sum(floor(value * 100) - floor(value * 40)) AS BIGINT) AS tokens_saved FROM events GROUP BY ROLLUP (event_type)")
def session_stats(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    a, b = F.floor(F.col("value") * 100), F.floor(F.col("value") * 40)
    return e.rollup(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.sum(a).alias("tokens_in"), F.sum(b).alias("tokens_out"), F.sum(a - b).alias("tokens_saved"))


@query("error_trend", f"WITH {D.LOG_LINES}, d AS (SELECT doc_id, substr(ts_text, 1, 10) AS day, count(*) FILTER (lvl = 'error') AS e FROM log_lines GROUP BY 1, 2), l AS (SELECT *, e - lag(e) OVER (PARTITION BY doc_id ORDER BY day) AS diff FROM d) SELECT doc_id, CASE WHEN count(diff) = 0 THEN 'unknown' WHEN bool_and(diff = 0) THEN 'same' WHEN bool_and(diff <= 0) THEN 'decreasing' WHEN bool_and(diff >= 0) THEN 'increasing' ELSE 'fluctuating' END AS trend FROM l GROUP BY 1")
def error_trend(spark, sf_dir):
    d = I.log_lines(spark, sf_dir).groupBy("doc_id", F.substring("ts_text", 1, 10).alias("day")).agg(F.count_if(F.col("lvl") == "error").alias("e"))
    d = d.withColumn("diff", F.col("e") - F.lag("e").over(Window.partitionBy("doc_id").orderBy("day")))
    x = F.col("diff")
    trend = F.when(F.count("diff") == 0, "unknown").when(F.bool_and(x == 0), "same").when(F.bool_and(x <= 0), "decreasing").when(F.bool_and(x >= 0), "increasing").otherwise("fluctuating")
    return d.groupBy("doc_id").agg(trend.alias("trend"))


@query("output_similarity", f"WITH {D.COMMANDS}, l AS (SELECT doc_id, arg_max(cmd, pos) AS cur FROM commands GROUP BY 1) SELECT doc_id, CAST(floor(avg(CASE WHEN cmd = cur THEN 1.0 ELSE 0 END) * 100 + 0.5) AS BIGINT) AS percent FROM commands JOIN l USING (doc_id) GROUP BY 1")
def output_similarity(spark, sf_dir):
    c = I.commands(spark, sf_dir)
    last = c.groupBy("doc_id").agg(F.max_by("cmd", "pos").alias("cur"))
    same = (F.sha2("cmd", 256) == F.sha2("cur", 256)).cast("double")
    return c.join(last, "doc_id").groupBy("doc_id").agg(T.js_round(F.avg(same) * 100).alias("percent"))


@query("parse_diff", f"WITH {D.DIFF_LINES} SELECT doc_id, any_value(regexp_extract(raw, '^diff --git a/(\\S+)', 1)) FILTER (pos = 0) AS file, count(*) FILTER (raw LIKE '@@%') AS hunks, count(*) FILTER (raw LIKE '+%') AS additions, count(*) FILTER (raw LIKE '-%') AS deletions FROM diff_lines GROUP BY 1")
def parse_diff(spark, sf_dir):
    x = I.diff_lines(spark, sf_dir)
    file = F.max(F.nullif(F.regexp_extract(F.col("raw"), r"^diff --git a/(\S+)", 1), F.lit("")))
    return x.groupBy("doc_id").agg(file.alias("file"), *[F.count_if(F.col("raw").startswith(p)).alias(n) for p, n in (("@@", "hunks"), ("+", "additions"), ("-", "deletions"))])


@query("diff_summary", f"WITH {D.DIFF_LINES}, d AS (SELECT doc_id, any_value(regexp_extract(raw, '^diff --git a/(\\S+)', 1)) FILTER (pos = 0) AS file, count(*) FILTER (raw LIKE '+%') AS a, count(*) FILTER (raw LIKE '-%') AS d FROM diff_lines GROUP BY 1) SELECT file, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions, count(*) AS diffs FROM d GROUP BY 1")
def diff_summary(spark, sf_dir):
    return parse_diff(spark, sf_dir).groupBy("file").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("diffs"))


_CHANGE = "(raw LIKE '+%' OR raw LIKE '-%')"


@query("diff_context", f"WITH {D.DIFF_LINES}, c AS (SELECT *, max(CASE WHEN {_CHANGE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM diff_lines) SELECT doc_id, pos, raw FROM c WHERE near = 1 OR pos <= 1")
def diff_context(spark, sf_dir):
    x = I.diff_lines(spark, sf_dir).withColumn("near", ordered.near_change(F.col("raw").startswith("+") | F.col("raw").startswith("-"), "doc_id", "pos", 1))
    return x.where("near or pos <= 1").select("doc_id", "pos", "raw")


@query("diff_hunks", f"WITH {D.DIFF_LINES}, c AS (SELECT *, max(CASE WHEN {_CHANGE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM diff_lines) SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS compressed FROM c WHERE near = 1 OR pos <= 1 GROUP BY 1")
def diff_hunks(spark, sf_dir):
    return joined(diff_context(spark, sf_dir), "doc_id", "pos", "raw", "compressed")


@query("diff_minimal", f"WITH {D.DIFF_LINES} SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS compressed FROM diff_lines WHERE {_CHANGE} OR raw LIKE 'diff%' OR raw LIKE '@@%' GROUP BY 1")
def diff_minimal(spark, sf_dir):
    keep = F.col("raw").rlike(r"^(\+|-|diff|@@)")
    return joined(I.diff_lines(spark, sf_dir).where(keep), "doc_id", "pos", "raw", "compressed")


def joined(df, doc: str, pos: str, text: str, name: str):
    """Lines of a document joined in order."""
    return df.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "\n").alias(name))
