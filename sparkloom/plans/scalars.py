"""Queries of scalar functions, over derived lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import duck as D
from . import inputs as I
from .registry import query


def _scalar(key: str, source, cte: str, view: str, keys: list[str], spark_expr, sql_expr: str, name: str = "value"):
    cols = ", ".join(keys)

    @query(key, f"WITH {cte} SELECT {cols}, {sql_expr} AS {name} FROM {view}")
    def run(spark, sf_dir):
        return source(spark, sf_dir).select(*keys, spark_expr().alias(name))


_LOG = (I.rich_lines, D.RICH, "rich", ["event_id"])
_HTTP = (I.http_lines, D.HTTP_LINES, "http_lines", ["event_id"])
_CMD = (I.commands, D.COMMANDS, "commands", ["doc_id", "pos"])
_BUILD = (I.build_lines, D.BUILD_LINES, "build_lines", ["doc_id", "pos"])

_scalar("normalize_error", *_LOG, lambda: T.normalize_error(F.col("raw")), f"trim({D.rewrite('raw', R.NORMALIZE_ERROR)})")
_scalar("normalize_log_grouping", *_LOG, lambda: T.normalize_log_grouping(F.col("raw")), f"trim(lower({D.rewrite('raw', R.LOG_GROUPING)}))")
_scalar("normalize_log_pattern", *_LOG, lambda: T.normalize_log_pattern(F.col("raw")), f"trim({D.rewrite('lower(raw)', R.LOG_PATTERN)})")
_scalar("normalize_log_cluster", *_LOG, lambda: T.normalize_log_cluster(F.col("raw")), f"trim({D.rewrite('lower(raw)', R.LOG_CLUSTER)})")
_scalar("normalize_log_line", *_LOG, lambda: T.normalize_log_line(F.col("raw")), f"trim({D.rewrite('raw', R.LOG_LINE)})")
_scalar("normalize_generic", *_LOG, lambda: T.normalize_generic(F.col("raw")), f"trim({D.rewrite('raw', R.GENERIC_LINE)})")
_scalar("log_template", *_LOG, lambda: T.log_template(F.col("raw")), D.rewrite("raw", R.TEMPLATE))
_scalar("first_token", *_LOG, lambda: T.first_token(F.col("raw")), f"CASE WHEN regexp_extract(trim({D.rewrite('raw', R.FIRST_TOKEN)}), '^\\w+') = '' THEN 'unknown' ELSE lower(regexp_extract(trim({D.rewrite('raw', R.FIRST_TOKEN)}), '^\\w+')) END")
_scalar("log_level", *_LOG, lambda: T.log_level(F.col("raw")), D.level("raw"))
_scalar("parse_log_ts", *_LOG, lambda: T.log_timestamp(F.col("raw")), D.timestamp("raw"))
_scalar("is_likely_error", *_LOG, lambda: T.any_of(F.col("raw"), R.LIKELY_ERROR), D.any_of("raw", R.LIKELY_ERROR))
_scalar("key_events", *_LOG, lambda: T.any_of(F.col("raw"), R.KEY_EVENT), D.any_of("raw", R.KEY_EVENT))
_scalar("output_hash", *_LOG, lambda: F.substring(F.sha2(F.col("raw"), 256), 1, 16), "substr(sha256(raw), 1, 16)")
_scalar("content_hash", *_LOG, lambda: F.md5(F.col("raw")), "md5(raw)")
_scalar("token_count", *_LOG, lambda: T.token_count(F.col("raw")), "CAST(ceil(length(raw) / 4.0) AS BIGINT)")
_scalar("cftl_buckets", *_LOG, lambda: F.concat(T.first_token(F.col("raw")), F.lit(":"), (F.floor(F.length(F.col("raw")) / 50) * 50).cast("string")), f"(CASE WHEN regexp_extract(trim({D.rewrite('raw', R.FIRST_TOKEN)}), '^\\w+') = '' THEN 'unknown' ELSE lower(regexp_extract(trim({D.rewrite('raw', R.FIRST_TOKEN)}), '^\\w+')) END) || ':' || CAST(CAST(floor(length(raw) / 50.0) * 50 AS BIGINT) AS VARCHAR)")
_scalar("truncate_text", *_LOG, lambda: F.when(F.length(F.col("raw")) <= 60, F.col("raw")).otherwise(F.concat(F.substring(F.col("raw"), 1, 57), F.lit("..."))), "CASE WHEN length(raw) <= 60 THEN raw ELSE substr(raw, 1, 57) || '...' END")
_scalar("slug", *_LOG, lambda: F.regexp_replace(F.regexp_replace(F.lower(F.col("raw")), "[^a-z0-9]+", "-"), r"^-|-\z", ""), "regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')")
_scalar("toon_escape", *_LOG, lambda: F.when(F.col("raw").contains(","), F.concat(F.lit('"'), F.replace(F.col("raw"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("raw")), """CASE WHEN contains(raw, ',') THEN '"' || replace(raw, '"', '""') || '"' ELSE raw END""")
_scalar("normalize_http_path", *_HTTP, lambda: T.normalize_http_path(F.regexp_extract(F.col("raw"), r"GET (\S+)", 1)), D.rewrite("regexp_extract(raw, 'GET (\\S+)', 1)", R.HTTP_PATH))
_scalar("normalize_command", *_CMD, lambda: T.normalize_command(F.col("cmd")), f"trim({D.rewrite('cmd', R.COMMAND)})")
_scalar("base_command", *_CMD, lambda: T.base_command(F.col("cmd")), "CASE WHEN string_split(trim(cmd), ' ')[1] IN ('npm', 'bun', 'yarn', 'pnpm', 'npx', 'bunx') THEN array_to_string(string_split(trim(cmd), ' ')[1:2], ' ') ELSE string_split(trim(cmd), ' ')[1] END")
_scalar("common_retry", *_CMD, lambda: T.common_retry(F.col("cmd")), "(" + " OR ".join(f"starts_with(lower(trim({D.rewrite('cmd', R.COMMAND)})), {D.q(c)})" for c in R.RETRY_COMMANDS) + ")")
_scalar("command_type", *_CMD, lambda: T.command_type(F.col("cmd")), "CASE " + " ".join(f"WHEN regexp_matches(lower(cmd), {D.q(p)}) THEN {D.q(k)}" for k, p in R.COMMAND_TYPES) + " ELSE 'command' END")
_scalar("build_signature", *_BUILD, lambda: F.concat(F.regexp_extract(F.col("raw"), T.java(R.TSC), 5), F.lit(":"), F.trim(T.rewrite(F.regexp_extract(F.col("raw"), T.java(R.TSC), 6), R.TSC_MESSAGE))), f"regexp_extract(raw, {D.q(R.TSC)}, 5) || ':' || trim({D.rewrite(f'regexp_extract(raw, {D.q(R.TSC)}, 6)', R.TSC_MESSAGE)})")
_scalar("detect_language", I.code_files, D.CODE_FILES, "code_files", ["p_partkey"], lambda: T.detect_language(F.col("path")), "CASE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' ELSE 'unknown' END")
_scalar("glob_filter", I.code_files, D.CODE_FILES, "code_files", ["p_partkey"], lambda: F.col("path").rlike(T.glob_regex("src/**/p1*.{py,ts}")), "regexp_matches(path, '^src/(.*/)?p1[^/]*\\.(py|ts)$')")
_scalar("extract_lines", I.code_files, D.CODE_FILES, "code_files", ["p_partkey"], lambda: F.array_join(F.slice(F.split("content", "\n"), 2, 2), "\n"), "array_to_string(string_split(content, chr(10))[2:3], chr(10))")
_scalar("is_code", I.code_files, D.CODE_FILES, "code_files", ["p_partkey"], lambda: T.any_of(F.col("content"), R.CODE), D.any_of("content", R.CODE))
_scalar("text_intent", I.convo, D.CONVO, "convo", ["conv_id", "turn"], lambda: F.when(T.any_of(F.trim("text"), R.QUESTION), "question").when(T.any_of(F.trim("text"), R.INSTRUCTION), "instruction").otherwise("generic"), f"CASE WHEN {D.any_of('trim(text)', [p.replace(chr(92) + 'z', '$') for p in R.QUESTION])} THEN 'question' WHEN {D.any_of('trim(text)', R.INSTRUCTION)} THEN 'instruction' ELSE 'generic' END")
_scalar("blocked_paths", I.code_files, D.CODE_FILES, "code_files", ["p_partkey"], lambda: F.concat(F.col("path"), F.when(F.col("p_partkey") % 5 == 0, "/.env").otherwise("")).rlike(R.BLOCKED_PATH), f"regexp_matches(path || CASE WHEN p_partkey % 5 = 0 THEN '/.env' ELSE '' END, {D.q(R.BLOCKED_PATH)})")
_scalar("classify_frames", I.rich_lines, D.RICH, "rich", ["event_id"], lambda: F.when(T.any_of(F.col("raw"), R.INTERNAL_FRAME), "internal").when(T.any_of(F.col("raw"), R.PROJECT_FRAME), "project").otherwise("other"), f"CASE WHEN {D.any_of('raw', R.INTERNAL_FRAME)} THEN 'internal' WHEN {D.any_of('raw', R.PROJECT_FRAME)} THEN 'project' ELSE 'other' END")


@query("bm25_tokens", f"SELECT doc_id, array_to_string({D.TOKENS.format(c='text')}, ' ') AS tokens FROM documents")
def bm25_tokens(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


@query("tfidf_tokens", f"SELECT doc_id, array_to_string({D.TF_TOKENS.format(c='text')}, ' ') AS tokens FROM documents")
def tfidf_tokens(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tfidf_tokens(F.col("text")), " ").alias("tokens"))


@query("parse_log_lines", f"WITH {D.LOG_LINES} SELECT event_id, {D.timestamp('raw')} AS timestamp, {D.level('raw')} AS level, message FROM log_lines")
def parse_log_lines(spark, sf_dir):
    return I.log_lines(spark, sf_dir).select("event_id", T.log_timestamp(F.col("raw")).alias("timestamp"), T.log_level(F.col("raw")).alias("level"), T.log_message(F.col("raw")).alias("message"))


@query("parse_http", f"WITH {D.HTTP_LINES} SELECT event_id, upper(regexp_extract(raw, {D.q(R.HTTP)}, 1)) AS method, regexp_extract(raw, {D.q(R.HTTP)}, 2) AS path, CAST(regexp_extract(raw, {D.q(R.HTTP)}, 3) AS INTEGER) AS status, CAST(nullif(regexp_extract(raw, {D.q(R.HTTP)}, 4), '') AS DOUBLE) AS response_ms FROM http_lines")
def parse_http(spark, sf_dir):
    return http_requests(I.http_lines(spark, sf_dir)).select("event_id", "method", "path", "status", "response_ms")


def http_requests(lines):
    """``lines`` with method, path, status and response_ms of the request in ``raw``; rows without one go."""
    p = T.java(R.HTTP)
    out = lines.where(F.col("raw").rlike(p))
    return out.withColumns({"method": F.upper(F.regexp_extract(F.col("raw"), p, 1)), "path": F.regexp_extract(F.col("raw"), p, 2), "status": F.regexp_extract(F.col("raw"), p, 3).cast("int"), "response_ms": F.nullif(F.regexp_extract(F.col("raw"), p, 4), F.lit("")).cast("double")})


@query("keyword_boost", f"WITH {D.CONVO} SELECT conv_id, turn, round(least(1.0, " + " + ".join(f"CASE WHEN regexp_matches(text, {D.q(p)}) THEN {w} ELSE 0 END" for w, p in R.KEYWORD_BOOST) + ")::DOUBLE, 6) AS boost FROM convo")
def keyword_boost(spark, sf_dir):
    return I.convo(spark, sf_dir).select("conv_id", "turn", F.round(T.keyword_boost(F.col("text")), 6).alias("boost"))


@query("quick_score", f"WITH {D.LOG_LINES} SELECT event_id, round((CASE lvl WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.1 END * 0.5 + CASE WHEN regexp_matches(lower(message), '{'|'.join(R.HIGH_WORDS)}') THEN 1.0 WHEN regexp_matches(lower(message), '{'|'.join(R.MEDIUM_WORDS)}') THEN 0.7 WHEN regexp_matches(message, '(?i)at\\s+\\w+|file\\s*:|line\\s*\\d+|traceback') THEN 0.8 ELSE 0.3 END * 0.5)::DOUBLE, 6) AS score FROM log_lines")
def quick_score(spark, sf_dir):
    score = T.level_score(F.col("lvl")) * 0.5 + T.keyword_score(F.col("message")) * 0.5
    return I.log_lines(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"))


@query("position_score", f"WITH {D.LOG_LINES}, x AS (SELECT doc_id, pos, pos - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM log_lines) SELECT doc_id, pos, round((CASE WHEN n <= 1 THEN 1.0 WHEN i < 5 THEN 1 - i / 5.0 * 0.3 WHEN n - 1 - i < 5 THEN 0.7 + (1 - (n - 1 - i) / 5.0) * 0.3 ELSE 0.3 + 0.8 * abs((i - 5) / CAST(n - 10 AS DOUBLE) - 0.5) END)::DOUBLE, 6) AS score FROM x")
def position_score(spark, sf_dir):
    from pyspark.sql import Window

    x = I.log_lines(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "pos", F.round(T.position_score(F.col("pos") - 1, F.col("n")), 6).alias("score"))


@query("position_weight", "SELECT vec_id, CASE WHEN p <= 0.1 OR p >= 0.9 THEN 1.0 WHEN p <= 0.2 OR p >= 0.8 THEN 0.85 WHEN p <= 0.3 OR p >= 0.7 THEN 0.7 ELSE 0.6 END::DOUBLE AS weight FROM (SELECT vec_id, (vec_id % 101) / 101.0::DOUBLE AS p FROM embeddings)")
def position_weight(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select("vec_id", T.position_weight((F.col("vec_id") % 101) / 101.0).alias("weight"))


@query("format_duration", "SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000.0) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || ((ms % 60000) // 1000) || 's' ELSE (ms // 3600000) || 'h ' || ((ms % 3600000) // 60000) || 'm' END AS formatted FROM (SELECT event_id, event_id * 1000 + 240 AS ms FROM events)")
def format_duration(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select("event_id", T.format_duration(F.col("event_id") * 1000 + 240).alias("formatted"))


@query("month_bounds", "SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month FROM events")
def month_bounds(spark, sf_dir):
    start = F.trunc("ts", "month")
    return I.table(spark, sf_dir, "events").select("event_id", F.date_format(start, "yyyy-MM-dd").alias("month_start"), F.date_format(F.add_months(start, 1), "yyyy-MM-dd").alias("next_month"))


@query("parse_date", f"WITH {D.LOG_LINES} SELECT event_id, strftime(CAST(ts_text AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS iso, CAST(epoch(CAST(ts_text AS TIMESTAMP)) AS BIGINT) AS epoch_s FROM log_lines")
def parse_date(spark, sf_dir):
    ts = F.try_to_timestamp("ts_text")
    return I.log_lines(spark, sf_dir).select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp(ts).alias("epoch_s"))


@query("lev_similarity", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(a.n_name, b.n_name) / CAST(greatest(length(a.n_name), length(b.n_name)) AS DOUBLE), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def lev_similarity(spark, sf_dir):
    a, b = (I.table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in "ab")
    sim = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(sim, 6).alias("similarity"))


_TOK = "list_distinct(list_filter(string_split(raw, ' '), lambda x: length(x) > 1))"


@query("jaccard_pairs", f"WITH {D.COMMANDS}, c AS (SELECT DISTINCT cmd, list_distinct(list_filter(regexp_split_to_array(cmd, '\\s+'), lambda x: length(x) > 1)) AS w FROM commands) SELECT a.cmd AS a, b.cmd AS b, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS similarity FROM c a JOIN c b ON a.cmd < b.cmd WHERE len(list_intersect(a.w, b.w)) > 0")
def jaccard_pairs(spark, sf_dir):
    """Distinct commands that share a word, and the share of their words that they share. Pairs meet at their common words, so those without any are never made."""
    t = I.commands(spark, sf_dir).select("cmd").distinct().select("cmd", F.array_distinct(F.filter(F.split("cmd", r"\s+"), lambda x: F.length(x) > 1)).alias("w"))
    words = t.select("cmd", F.size("w").alias("n"), F.explode("w").alias("word"))
    x, y = words.alias("x"), words.alias("y")
    both = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.cmd") < F.col("y.cmd"))).groupBy(F.col("x.cmd").alias("a"), F.col("y.cmd").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.count("*").alias("k"))
    return both.select("a", "b", F.round(F.col("k") / (F.col("m") + F.col("n") - F.col("k")), 6).alias("similarity"))


def _parts_sql() -> str:
    def g(p, k):
        return "''" if k is None else f"regexp_extract(raw, {D.q(p)}, {k})"

    fields = []
    for f, name in enumerate(("file", "line", "column", "code", "message")):
        fields.append("CASE " + " ".join(f"WHEN regexp_matches(raw, {D.q(p)}) THEN {g(p, groups[f])}" for _, p, groups in R.ERROR_PARTS) + f" ELSE '' END AS {name if name != 'column' else 'col'}")
    return ", ".join(fields)


@query("extract_error_parts", f"WITH {D.BUILD_LINES} SELECT doc_id, pos, {_parts_sql()} FROM build_lines")
def extract_error_parts(spark, sf_dir):
    return error_parts(I.build_lines(spark, sf_dir)).select("doc_id", "pos", "file", "line", "col", "code", "message")


def error_parts(lines):
    """``lines`` with file, line, col, code and message of ``raw`` by the first extractor that matches; empty strings where none does."""
    out = {}
    for f, name in enumerate(("file", "line", "col", "code", "message")):
        c = F.lit("")
        for _, p, groups in reversed(R.ERROR_PARTS):
            k = groups[f]
            c = F.when(F.col("raw").rlike(T.java(p)), F.lit("") if k is None else F.regexp_extract(F.col("raw"), T.java(p), k)).otherwise(c)
        out[name] = c
    return lines.withColumns(out)


def _ratio(kind: str, k: int) -> str:
    return f"{R.OUTPUT_RATIOS[kind][k]}"


@query(
    "estimate_output",
    "WITH x AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM documents) SELECT doc_id, t AS input_tokens, CAST(least(16000, greatest(50, CASE WHEN t < 100 THEN greatest(floor(t * 0.5 + 0.5), floor(t * 1.0 + 0.5)) WHEN t > 10000 THEN floor(t * 0.3 + 0.5) ELSE floor(t * 0.5 + 0.5) END)) AS BIGINT) AS estimated FROM x",
)


def estimate_output(spark, sf_dir):
    low, high, usual = R.OUTPUT_RATIOS["generic"]
    t = T.token_count(F.col("text"))
    est = F.when(t < 100, F.greatest(T.js_round(t * usual), T.js_round(t * high))).when(t > 10_000, T.js_round(t * low)).otherwise(T.js_round(t * usual))
    return I.table(spark, sf_dir, "documents").select("doc_id", t.alias("input_tokens"), F.least(F.lit(16_000), F.greatest(F.lit(50), est)).cast("long").alias("estimated"))


@query("cost_micros", "SELECT event_id, CAST(ceil(floor(value * 100) / 1e6 * 3.0 * 1e6) AS BIGINT) AS input_micros FROM events")
def cost_micros(spark, sf_dir):
    price = spark.createDataFrame([(k, *v) for k, v in R.PRICES.items()], "model string, price_in double, price_out double")
    e = I.table(spark, sf_dir, "events").withColumn("model", F.lit("sonnet"))
    return e.join(F.broadcast(price), "model").select("event_id", F.ceil(F.floor(F.col("value") * 100) / 1e6 * F.col("price_in") * 1e6).alias("input_micros"))


@query("context_usage", "SELECT doc_id, CAST(floor(ceil(length(text) / 4.0) / 200000 * 100 + 0.5) AS BIGINT) AS usage_percent FROM documents")
def context_usage(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.js_round(T.token_count(F.col("text")) / R.CONTEXT_WINDOW * 100).alias("usage_percent"))


@query("count_error_lines", f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\\b(the|error)\\b'))) AS BIGINT) AS n FROM documents")
def count_error_lines(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(T.java(r"(?i)\b(the|error)\b")))).cast("long").alias("n"))
