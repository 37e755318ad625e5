"""Queries of test and build output, captured git output, code structure, caches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import cache, code
from ..ship import ship
from ..sources import files
from . import duck as D
from . import inputs as I
from .registry import query
from .structure import elements_sql


_TESTS = """tests AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'SKIPPED' ELSE 'PASSED' END || ' test_' || (event_id % 30) || '.py::case_' || event_id AS raw FROM events)"""


def tests(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "SKIPPED").otherwise("PASSED")
    return I.table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(kind, F.lit(" test_"), F.col("event_id") % 30, F.lit(".py::case_"), "event_id").alias("raw"))


_STATUS = f"CASE regexp_extract(raw, {D.q(R.PYTEST_RESULT)}, 1) WHEN 'FAILED' THEN 'fail' WHEN 'ERROR' THEN 'fail' WHEN 'SKIPPED' THEN 'skip' ELSE 'pass' END"


@query("parse_tests", f"WITH {_TESTS} SELECT event_id, {_STATUS} AS status, regexp_extract(raw, {D.q(R.PYTEST_RESULT)}, 2) AS name FROM tests")
def parse_tests(spark, sf_dir):
    return _parsed_tests(spark, sf_dir).select("event_id", "status", "name")


def _parsed_tests(spark, sf_dir):
    p = T.java(R.PYTEST_RESULT)
    word = F.regexp_extract("raw", p, 1)
    status = F.when(word.isin("FAILED", "ERROR"), "fail").when(word == "SKIPPED", "skip").otherwise("pass")
    return tests(spark, sf_dir).where(F.col("raw").rlike(p)).select("event_id", "user_id", status.alias("status"), F.regexp_extract("raw", p, 2).alias("name"))


@query("test_counts", f"WITH {_TESTS} SELECT user_id, count(*) FILTER ({_STATUS} = 'pass') AS passed, count(*) FILTER ({_STATUS} = 'fail') AS failed, count(*) FILTER ({_STATUS} = 'skip') AS skipped FROM tests GROUP BY 1")
def test_counts(spark, sf_dir):
    return _parsed_tests(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])


@query("test_summary_line", f"SELECT event_id, CAST(regexp_extract(s, {D.q(R.TEST_TOTALS)}, 1) AS INTEGER) AS passed, CAST(regexp_extract(s, {D.q(R.TEST_TOTALS)}, 2) AS INTEGER) AS failed, CAST(regexp_extract(s, {D.q(R.TEST_TOTALS)}, 4) AS DOUBLE) * 1000 AS duration_ms FROM (SELECT event_id, event_id || ' passed, ' || user_id || ' failed in ' || (event_id % 9) || '.5s' AS s FROM events)")
def test_summary_line(spark, sf_dir):
    s = F.concat("event_id", F.lit(" passed, "), "user_id", F.lit(" failed in "), F.col("event_id") % 9, F.lit(".5s"))
    x = I.table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    g = lambda k: F.regexp_extract("s", R.TEST_TOTALS, k)
    return x.select("event_id", g(1).cast("int").alias("passed"), g(2).cast("int").alias("failed"), (g(4).cast("double") * 1000).alias("duration_ms"))


_BUNDLE = "bundles AS (SELECT p_partkey, 'dist/p' || p_partkey || '.js  ' || p_size || '.5 ' || CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'kB' ELSE 'MB' END AS raw FROM part)"


@query("bundle_sizes", f"WITH {_BUNDLE} SELECT p_partkey, regexp_extract(raw, {D.q(R.BUNDLE_SIZE)}, 1) AS file, CAST(regexp_extract(raw, {D.q(R.BUNDLE_SIZE)}, 2) AS DOUBLE) * CASE upper(regexp_extract(raw, {D.q(R.BUNDLE_SIZE)}, 3)) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 ELSE 1 END AS bytes FROM bundles")
def bundle_sizes(spark, sf_dir):
    unit = F.when(F.col("p_size") % 3 == 0, "B").when(F.col("p_size") % 3 == 1, "kB").otherwise("MB")
    x = I.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("dist/p"), "p_partkey", F.lit(".js  "), "p_size", F.lit(".5 "), unit).alias("raw"))
    times = F.upper(F.regexp_extract("raw", R.BUNDLE_SIZE, 3))
    scale = F.when(times == "KB", 1024).when(times == "MB", 1_048_576).otherwise(1)
    return x.select("p_partkey", F.regexp_extract("raw", R.BUNDLE_SIZE, 1).alias("file"), (F.regexp_extract("raw", R.BUNDLE_SIZE, 2).cast("double") * scale).alias("bytes"))


@query("build_duration", f"SELECT event_id, CAST(regexp_extract(raw, {D.q(R.BUILD_TOOK)}, 1) AS DOUBLE) * CASE regexp_extract(raw, {D.q(R.BUILD_TOOK)}, 2) WHEN 's' THEN 1000 ELSE 1 END AS ms FROM (SELECT event_id, 'Built in ' || event_id || CASE event_id % 2 WHEN 0 THEN 's' ELSE 'ms' END AS raw FROM events)")
def build_duration(spark, sf_dir):
    raw = F.concat(F.lit("Built in "), "event_id", F.when(F.col("event_id") % 2 == 0, "s").otherwise("ms"))
    x = I.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return x.select("event_id", (F.regexp_extract("raw", R.BUILD_TOOK, 1).cast("double") * F.when(F.lower(F.regexp_extract("raw", R.BUILD_TOOK, 2)) == "s", 1000).otherwise(1)).alias("ms"))


_NUMSTAT = "numstat AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '-' ELSE CAST(l_suppkey AS VARCHAR) END AS a, l_linenumber AS d, 'src/f' || l_partkey || '.ts' AS f FROM lineitem)"


@query("git_numstat", f"WITH {_NUMSTAT} SELECT l_orderkey, l_linenumber, CASE a WHEN '-' THEN 0 ELSE CAST(a AS INTEGER) END AS additions, CAST(d AS INTEGER) AS deletions, f AS file FROM numstat")
def git_numstat(spark, sf_dir):
    a = F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_suppkey").cast("string"))
    line = F.concat_ws("\t", a, F.col("l_linenumber").cast("string"), F.concat(F.lit("src/f"), "l_partkey", F.lit(".ts")))
    return files.parse_numstat(I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")))


@query("git_status_parse", "SELECT o_orderkey, 'src/f' || o_orderkey || '.ts' AS file, o_orderstatus = 'F' AS staged, o_orderstatus = 'O' AS modified, o_orderstatus NOT IN ('F', 'O') AS untracked FROM orders")
def git_status_parse(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", "M ").when(F.col("o_orderstatus") == "O", " M").otherwise("??")
    line = F.concat(flag, F.lit(" src/f"), "o_orderkey", F.lit(".ts"))
    return files.parse_status(I.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")))


@query("git_status_join", "SELECT p_partkey, coalesce(s.st, 'modified') AS status FROM part LEFT JOIN (SELECT l_partkey, CASE min(l_returnflag) WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' ELSE 'modified' END AS st FROM lineitem GROUP BY 1) s ON s.l_partkey = p_partkey")
def git_status_join(spark, sf_dir):
    flags = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("f"))
    status = F.when(F.col("f") == "A", "added").when(F.col("f") == "D", "deleted").when(F.col("f") == "R", "renamed").otherwise("modified")
    return I.table(spark, sf_dir, "part").select("p_partkey").join(flags, "p_partkey", "left").select("p_partkey", status.alias("status"))


@query("retry_loop", f"WITH {D.COMMANDS}, g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim({D.rewrite('cmd', R.COMMAND)}) AS norm FROM commands) GROUP BY doc_id, norm) SELECT doc_id, max(n) AS most, max(n) >= 3 AS looping FROM g GROUP BY 1")
def retry_loop(spark, sf_dir):
    g = I.commands(spark, sf_dir).groupBy("doc_id", T.normalize_command(F.col("cmd")).alias("norm")).agg(F.count("*").alias("n"))
    return g.groupBy("doc_id").agg(F.max("n").alias("most"), (F.max("n") >= 3).alias("looping"))


@query("hier_sections", f"WITH {D.LOG_LINES} SELECT doc_id, (pos - 1) // 20 AS section, count(*) AS n, count(*) FILTER (lvl = 'error') AS errors, min(ts_text) AS first_ts, max(ts_text) AS last_ts FROM log_lines GROUP BY 1, 2")
def hier_sections(spark, sf_dir):
    x = I.log_lines(spark, sf_dir)
    return x.groupBy("doc_id", F.floor((F.col("pos") - 1) / 20).alias("section")).agg(F.count("*").alias("n"), F.count_if(F.col("lvl") == "error").alias("errors"), F.min("ts_text").alias("first_ts"), F.max("ts_text").alias("last_ts"))


@query("pattern_stats", f"WITH {D.LOG_LINES}, p AS (SELECT {D.rewrite('message', R.TEMPLATE)} AS t, count(*) AS n FROM log_lines GROUP BY 1) SELECT count(*) AS patterns, CAST(sum(n) AS BIGINT) AS entries, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM p")
def pattern_stats(spark, sf_dir):
    p = I.log_lines(spark, sf_dir).groupBy(T.log_template(F.col("message"))).agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("patterns"), F.sum("n").alias("entries"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


_PYTHON = [("imports", "os", None, 1, 1, False, "os", ""), ("functions", "f_{k}", None, 3, 4, True, "def f_{k}(x)", "")]
_PARSED_SQL = elements_sql(_PYTHON, "code_files", "path", "p_partkey") + " UNION ALL " + elements_sql([("classes", "C_{k}", None, 5, 6, True, "class C_{k}", "")], "sized", "path", "p_size") + " UNION ALL " + elements_sql([("imports", "x", None, 2, 2, False, "mod{k}", "")], "modules", "path", "m")
_PARSED_SQL = f"{D.CODE_FILES}, sized AS (SELECT path, p_size FROM code_files JOIN part USING (p_partkey)), modules AS (SELECT path, p_partkey % 9 AS m FROM code_files), parsed AS ({_PARSED_SQL})"


@query("parse_code", f"WITH {_PARSED_SQL} SELECT * FROM parsed")
def parse_code(spark, sf_dir):
    ship(spark)
    return code.parse_code(I.code_files(spark, sf_dir), "python")


@query("all_signatures", f"WITH {_PARSED_SQL} SELECT path, name, start_line, detail AS signature FROM parsed WHERE bucket = 'functions' AND exported")
def all_signatures(spark, sf_dir):
    """The signatures of exported functions."""
    return parse_code(spark, sf_dir).where("bucket = 'functions' and exported").select("path", "name", "start_line", F.col("detail").alias("signature"))


@query("search_symbols", f"WITH {_PARSED_SQL} SELECT * FROM parsed WHERE contains(lower(name), 'f_1')")
def search_symbols(spark, sf_dir):
    return parse_code(spark, sf_dir).where(F.lower("name").contains("f_1"))


@query("dir_structure", f"WITH {_PARSED_SQL} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, bucket, count(*) AS n, count(DISTINCT path) AS files FROM parsed GROUP BY 1, 2")
def dir_structure(spark, sf_dir):
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return parse_code(spark, sf_dir).groupBy(folder.alias("folder"), "bucket").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def _cache_sql(ops: str, capacity: int, ttl: float, most_bytes: int) -> str:
    """Statistics of each cache as a fold over its operations; the state's entries ``e`` come least recently used first."""
    counts = ("hits", "not_found", "expired", "file_changed", "evicted", "invalidated", "tokens_saved")
    zero = ", ".join(f"'{c}': CAST(0 AS BIGINT)" for c in counts)
    state = lambda e, **new: "{'op': a.op, 'e': " + e + ", " + ", ".join(f"'{c}': " + new.get(c, f"a.{c}") for c in counts) + "}"
    key, others, mine = "x.e[1].k", "list_filter(a.e, lambda v: v.k <> x.e[1].k)", "list_filter(a.e, lambda v: v.k = x.e[1].k)"
    first = f"list_filter(range(0, len(a.e) + 1), lambda j: (len(a.e) - j < {capacity} AND coalesce(list_sum(list_transform(a.e[j + 1:], lambda v: v.s)), 0) + x.e[1].s <= {most_bytes}) OR j = len(a.e))[1]"
    fold = f"""CASE x.op WHEN 'set' THEN {state(f"list_concat(list_filter(a.e[{first} + 1:], lambda v: v.k <> {key}), x.e)", evicted=f"a.evicted + {first}")}
      WHEN 'invalidate' THEN {state(others, invalidated=f"a.invalidated + len({mine})")}
      WHEN 'invalidate_path' THEN {state("list_filter(a.e, lambda v: v.p IS NULL OR v.p <> x.e[1].p)", invalidated="a.invalidated + len(list_filter(a.e, lambda v: v.p = x.e[1].p))")}
      WHEN 'clear' THEN {state("list_filter(a.e, lambda v: false)")}
      ELSE CASE WHEN len({mine}) = 0 THEN {state("a.e", not_found="a.not_found + 1")} WHEN x.e[1].t - {mine}[1].t > {ttl} THEN {state(others, expired="a.expired + 1")}
        WHEN {mine}[1].p IS NOT NULL AND {mine}[1].h <> x.e[1].h THEN {state(others, file_changed="a.file_changed + 1")}
        ELSE {state(f"list_concat({others}, {mine})", hits="a.hits + 1", tokens_saved=f"a.tokens_saved + {mine}[1].n")} END END"""
    item = "{'k': key, 't': CAST(secs AS DOUBLE), 'p': CAST(path AS VARCHAR), 'h': CAST(hash AS VARCHAR), 's': CAST(size AS BIGINT), 'n': CAST(tokens AS BIGINT)}"
    return f"""g AS (SELECT cache, list({{'op': op, 'e': [{item}], {zero}}} ORDER BY seq) AS xs FROM {ops} GROUP BY 1),
  f AS (SELECT cache, list_reduce(list_concat([{{'op': '', 'e': list_filter(xs[1].e, lambda v: false), {zero}}}], xs), lambda a, x: {fold}) AS s FROM g)
  SELECT cache, {", ".join(f"s.{c} AS {c}" for c in counts)}, len(s.e) AS entries, CAST(coalesce(list_sum(list_transform(s.e, lambda v: v.s)), 0) AS BIGINT) AS bytes, array_to_string(list_transform(s.e, lambda v: v.k), ',') AS keys FROM f"""


_OPS = "ops AS (SELECT user_id % 16 AS cache, event_id AS seq, epoch(ts) AS secs, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set' ELSE 'get' END AS op, CAST(user_id % 400 AS VARCHAR) AS key, NULL AS path, NULL AS hash, 0 AS size, 0 AS tokens FROM events)"


@query("cache_replay", f"WITH {_OPS}, {_cache_sql('ops', 10, 36_000.0, cache.BYTES)}")
def cache_replay(spark, sf_dir):
    """16 caches of ten entries that live ten hours: purchases and signups store, other events look up."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("get")
    ops = I.table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("cache"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), op.alias("op"), (F.col("user_id") % 400).cast("string").alias("key"))
    return cache.replay(ops, capacity=10, ttl=36_000.0)


_ACTIONS = """ops AS (SELECT user_id % 16 AS cache, event_id AS seq, epoch(ts) AS secs, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 29 = 0 THEN 'invalidate_path' WHEN event_id % 23 = 0 THEN 'invalidate' WHEN event_id % 2 = 0 THEN 'set' ELSE 'get' END AS op,
  'k' || (user_id % 40) AS key, '/f' || (user_id % 5) AS path, 'h' || (event_id // 400) AS hash, 100 + event_id % 900 AS size, event_id % 50 AS tokens FROM events)"""


@query("smart_cache", f"WITH {_ACTIONS}, {_cache_sql('ops', 8, 864_000.0, 4_000)}")
def smart_cache(spark, sf_dir):
    """All actions on caches bounded by entries, bytes, time and the hashes of files."""
    n, u = F.col("event_id"), F.col("user_id")
    op = F.when(n % 97 == 0, "clear").when(n % 29 == 0, "invalidate_path").when(n % 23 == 0, "invalidate").when(n % 2 == 0, "set").otherwise("get")
    key, path, sha = F.concat(F.lit("k"), u % 40), F.concat(F.lit("/f"), u % 5), F.concat(F.lit("h"), F.floor(n / 400))
    ops = I.table(spark, sf_dir, "events").select((u % 16).alias("cache"), n.alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), op.alias("op"), key.alias("key"), path.alias("path"), sha.alias("hash"), (100 + n % 900).alias("size"), (n % 50).alias("tokens"))
    return cache.replay(ops, capacity=8, ttl=864_000.0, most_bytes=4_000)


@query("stream_chunk_by_time", """WITH RECURSIVE x AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos, epoch_us(ts) AS s FROM events),
  r AS (SELECT doc_id, pos, s, s AS anchor, CAST(0 AS BIGINT) AS chunk FROM x WHERE pos = 1
    UNION ALL SELECT x.doc_id, x.pos, x.s, CASE WHEN x.s - r.anchor >= 259200000000 THEN x.s ELSE r.anchor END, CASE WHEN x.s - r.anchor >= 259200000000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN x ON x.doc_id = r.doc_id AND x.pos = r.pos + 1),
  c AS (SELECT doc_id, chunk, min(s) AS start_us, count(*) AS n FROM r GROUP BY 1, 2) SELECT * FROM c QUALIFY chunk < max(chunk) OVER (PARTITION BY doc_id)""")


def stream_chunk_by_time(spark, sf_dir):
    """The event table read as a stream, with an empty starting state: the chunks that later events have closed, written by the stream to a table."""
    from ..streaming.chunks import chunk_stream

    ship(spark)
    source = spark.readStream.schema(I.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    lines = source.select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = files.work_dir(spark, "chunks")
    chunks = chunk_stream(lines, 3 * 24 * 3600)
    chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", files.work_dir(spark, "chunks-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(chunks.schema).parquet(out).select("doc_id", "chunk", F.unix_micros("start").alias("start_us"), "n")
