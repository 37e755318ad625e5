"""Content types, build tools, summarizers and code checks: tests of whole texts; parsers of compiler output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import spread
from . import duck as D
from . import inputs as I
from .registry import query

TEXTS_SQL = f"""{D.LOG_LINES}, {D.HTTP_LINES}, {D.BUILD_LINES}, {D.DIFF_LINES},
  texts AS (SELECT 'log' || doc_id AS id, string_agg(raw, chr(10) ORDER BY pos) AS c FROM log_lines GROUP BY 1
    UNION ALL SELECT 'build' || doc_id || '-' || (l_orderkey % 50), string_agg(raw, chr(10) ORDER BY pos) FROM build_lines GROUP BY 1
    UNION ALL SELECT 'diff' || doc_id, string_agg(raw, chr(10) ORDER BY pos) FROM diff_lines GROUP BY 1
    UNION ALL SELECT 'http' || user_id, string_agg(raw, chr(10) ORDER BY event_id) FROM http_lines GROUP BY 1
    UNION ALL SELECT 'doc' || doc_id, coalesce(text, '') FROM documents)"""


def texts(spark, sf_dir):
    """(id, c): logs, build output, diffs, requests and documents as whole texts."""
    from .logs import joined

    named = lambda kind, key: F.concat(F.lit(kind), F.col(key)).alias("id")
    logs = joined(I.log_lines(spark, sf_dir).select(named("log", "doc_id"), "pos", "raw"), "id", "pos", "raw", "c")
    build = I.build_lines(spark, sf_dir).select(F.concat(F.lit("build"), "doc_id", F.lit("-"), F.col("l_orderkey") % 50).alias("id"), "pos", "raw")
    diffs = joined(I.diff_lines(spark, sf_dir).select(named("diff", "doc_id"), "pos", "raw"), "id", "pos", "raw", "c")
    http = joined(I.http_lines(spark, sf_dir).select(named("http", "user_id"), "event_id", "raw"), "id", "event_id", "raw", "c")
    docs = spread(I.table(spark, sf_dir, "documents").select("doc_id", "text")).select(named("doc", "doc_id"), F.coalesce("text", F.lit("")).alias("c"))
    return logs.unionByName(joined(build, "id", "pos", "raw", "c")).unionByName(diffs).unionByName(http).unionByName(docs)


COUNTED_SQL = f"""{TEXTS_SQL}, lined AS (SELECT id, c, list_filter(string_split(c, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM texts),
  counted AS (SELECT id, c, len(ls) AS n, len(list_filter(ls, lambda x: {D.any_of('x', R.LOG_START)})) AS logs, len(list_filter(ls, lambda x: {D.any_of('x', R.BUILD_ERROR)})) AS builds FROM lined)"""


PIPELINE_TYPE_SQL = f"""CASE WHEN {D.any_of('c', R.DIFF_MARK)} THEN 'diff' WHEN n = 0 THEN 'generic'
  WHEN logs >= 0.1 * n AND logs >= 2 AND (logs >= builds OR logs >= 0.2 * n) THEN 'logs' WHEN builds >= 1 AND builds >= 0.05 * n AND (builds > logs OR logs < 0.1 * n) THEN 'build'
  WHEN logs > 0 THEN 'logs' WHEN builds > 0 THEN 'build' ELSE 'generic' END"""


@query("detect_pipeline_type", f"WITH {COUNTED_SQL} SELECT id, {PIPELINE_TYPE_SQL} AS pipeline_type FROM counted")
def detect_pipeline_type(spark, sf_dir):
    return pipeline_type(texts(spark, sf_dir)).select("id", "pipeline_type")


def pipeline_type(df):
    """``df`` (id, c) with pipeline_type: diff by any mark, else logs or build by their shares of the lines."""
    # a text with a mark of a diff needs no count of its lines
    marked = T.any_of(F.col("c"), R.DIFF_MARK)
    lines = F.when(~F.col("_diff"), F.filter(F.split("c", "\n"), lambda x: F.length(F.trim(x)) > 0)).otherwise(F.array().cast("array<string>"))
    count = lambda rules: F.size(F.filter("_ls", lambda x: T.any_of(x, rules)))
    x = df.withColumn("_diff", marked).withColumn("_ls", lines).withColumns({"_n": F.size("_ls"), "_logs": count(R.LOG_START), "_builds": count(R.BUILD_ERROR)})
    n, logs, builds = F.col("_n"), F.col("_logs"), F.col("_builds")
    kind = (
        F.when(F.col("_diff"), "diff")
        .when((logs >= 0.1 * n) & (logs >= 2) & ((logs >= builds) | (logs >= 0.2 * n)), "logs")
        .when((builds >= 1) & (builds >= 0.05 * n) & ((builds > logs) | (logs < 0.1 * n)), "build")
        .when(logs > 0, "logs")
        .when(builds > 0, "build")
        .otherwise("generic")
    )
    return x.withColumn("pipeline_type", kind).drop("_diff", "_ls", "_n", "_logs", "_builds")


#: Tool and the test that tells it, in this order; the same text for Spark and DuckDB but for how patterns are matched.
_TOOLS = [
    ("tsc", "contains(c, 'error TS') OR contains(c, 'warning TS')"),
    ("eslint", "(contains(c, 'error') AND contains(c, 'warning') AND {places}) OR contains(c, 'eslint')"),
    ("webpack", "contains(c, 'ERROR in') OR contains(c, 'webpack')"),
    ("vite", "contains(c, '[vite]')"),
    ("esbuild", "contains(c, '✘ [ERROR]')"),
    ("rust", "contains(c, 'error[E') OR contains(c, 'rustc')"),
    ("go", "{go}"),
]


_DUCK_MATCH, _SPARK_MATCH = "regexp_matches(c, '{}')", "c RLIKE '{}'"


def _tool(match: str) -> str:
    places, go = (match.format(p) for p in ("[0-9]+:[0-9]+", "[.]go:[0-9]+:[0-9]+:"))
    return "CASE " + " ".join(f"WHEN {test.format(places=places, go=go)} THEN '{name}'" for name, test in _TOOLS) + " ELSE 'generic' END"


@query("detect_build_tool", f"WITH {TEXTS_SQL} SELECT id, {_tool(_DUCK_MATCH)} AS tool FROM texts")
def detect_build_tool(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.expr(_tool(_SPARK_MATCH)).alias("tool"))


BUILD_TOOL_SQL = _tool(_DUCK_MATCH)


def build_tool():
    """The tool of the text in column c."""
    return F.expr(_tool(_SPARK_MATCH))


_FLAGS = ", ".join(f"{D.any_of('c', p)} AS {k}" for k, p in R.CONTENT_FLAGS.items())


@query("content_flags", f"WITH {TEXTS_SQL}, l AS (SELECT id, c, list_filter(string_split(c, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM texts) SELECT id, {_FLAGS}, len(ls) > 0 AND 1 - len(list_distinct(ls)) / CAST(len(ls) AS DOUBLE) > 0.2 AS has_duplicates, ceil(length(c) / 4.0) > 2000 AND NOT contains(c, '```') AS is_long_prose FROM l")
def content_flags(spark, sf_dir):
    x = texts(spark, sf_dir).withColumn("ls", F.filter(F.split("c", "\n"), lambda x: F.length(F.trim(x)) > 0))
    flags = [T.any_of(F.col("c"), p).alias(k) for k, p in R.CONTENT_FLAGS.items()]
    repeated = (F.size("ls") > 0) & (1 - F.size(F.array_distinct("ls")) / F.greatest(F.size("ls"), F.lit(1)) > 0.2)
    return x.select("id", *flags, repeated.alias("has_duplicates"), ((T.token_count(F.col("c")) > 2000) & ~F.contains("c", F.lit("```"))).alias("is_long_prose"))


SUMMARIZER_SQL = f"CASE WHEN len(list_filter(ls, lambda x: {D.any_of('x', R.SERVER_LINE)})) / CAST(len(ls) AS DOUBLE) >= 0.1 THEN 'server' WHEN {D.any_of('c', R.TEST_TEXT)} THEN 'test' WHEN {D.any_of('c', R.BUILD_TEXT)} THEN 'build' ELSE 'generic' END"


@query("choose_summarizer", f"WITH {TEXTS_SQL}, l AS (SELECT id, c, string_split(c, chr(10))[:100] AS ls FROM texts) SELECT id, {SUMMARIZER_SQL} AS summarizer FROM l")
def choose_summarizer(spark, sf_dir):
    """The kind is told by the first 100 lines for servers, as that test is defined, and by the whole text for others."""
    return texts(spark, sf_dir).select("id", summarizer_of("c").alias("summarizer"))


def summarizer_of(c: str):
    head = F.slice(F.split(c, "\n"), 1, 100)
    server = F.size(F.filter(head, lambda x: T.any_of(x, R.SERVER_LINE))) / F.size(head) >= 0.1
    return F.when(server, "server").when(T.any_of(F.col(c), R.TEST_TEXT), "test").when(T.any_of(F.col(c), R.BUILD_TEXT), "build").otherwise("generic")


_SNIPPETS = """snippets AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'const r = eval(input_' || event_id || '); r.__proto__' WHEN 'view' THEN 'while (true) { step(' || user_id || ') }'
  WHEN 'click' THEN 'const fs = require("fs"); process.exit(1)' WHEN 'signup' THEN 'x.repeat(' || (event_id * 1000) || '); import("../../lib")' ELSE 'return items.map(f_' || event_id || ')' END AS code FROM events)"""


def _reasons_sql(rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(code, {D.q(p)}) THEN {D.q(why)} END" for p, why in rules) + "], lambda x: x IS NOT NULL), '; ')"


def reasons(code, rules):
    return F.concat_ws("; ", *[F.when(code.rlike(T.java(p)), why) for p, why in rules])


@query("scan_code", f"WITH {_SNIPPETS}, r AS (SELECT event_id, {_reasons_sql(R.BLOCKED_CODE)} AS blocked, {_reasons_sql(R.CODE_WARNINGS)} AS warnings FROM snippets) SELECT event_id, blocked = '' AS safe, blocked, warnings FROM r")
def scan_code(spark, sf_dir):
    kinds = {
        "error": F.concat(F.lit("const r = eval(input_"), "event_id", F.lit("); r.__proto__")),
        "view": F.concat(F.lit("while (true) { step("), "user_id", F.lit(") }")),
        "click": F.lit('const fs = require("fs"); process.exit(1)'),
        "signup": F.concat(F.lit("x.repeat("), F.col("event_id") * 1000, F.lit('); import("../../lib")')),
    }
    code = F.concat(F.lit("return items.map(f_"), "event_id", F.lit(")"))
    for kind, made in kinds.items():
        code = F.when(F.col("event_type") == kind, made).otherwise(code)
    x = I.table(spark, sf_dir, "events").select("event_id", code.alias("code"))
    x = x.select("event_id", reasons(F.col("code"), R.BLOCKED_CODE).alias("blocked"), reasons(F.col("code"), R.CODE_WARNINGS).alias("warnings"))
    return x.select("event_id", (F.col("blocked") == "").alias("safe"), "blocked", "warnings")


# Compiler output: a header line, then a detail or place line, per line item.


def output_lines(spark, sf_dir, head, detail):
    """(doc_id, pos, raw): two lines for each line item of an order."""
    x = I.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    both = F.posexplode(F.array(head, detail)).alias("k", "raw")
    return x.withColumn("r", F.row_number().over(order)).select(F.col("l_orderkey").alias("doc_id"), "r", both).select("doc_id", (F.col("r") * 2 + F.col("k")).cast("long").alias("pos"), "raw")


def _output_sql(head: str, detail: str) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS r FROM lineitem),
  output AS (SELECT l_orderkey AS doc_id, r * 2 + k AS pos, CASE k WHEN 0 THEN {head} ELSE {detail} END AS raw FROM numbered, (VALUES (0), (1)) v(k))"""


def _signature_sql(code: str, message: str) -> str:
    return f"{code} || ':' || trim(substring({D.rewrite(message, [(chr(39) + '[^' + chr(39) + ']+' + chr(39), chr(39) + 'X' + chr(39)), ('[0-9]+', 'N'), ('[ ]+', ' ')])}, 1, 100))"


SIGNATURE = [(r"'[^']+'", "'X'"), (r'"[^"]+"', '"X"'), (r"`[^`]+`", "`X`"), (r"[0-9]+", "N"), (r"\s+", " ")]


def signature(code, message):
    """The message with its quoted parts and numbers made alike, after its code."""
    m = message
    for pattern, to in SIGNATURE:
        m = F.regexp_replace(m, pattern, to)
    return F.concat(code, F.lit(":"), F.trim(F.substring(m, 1, 100)))


def _islands(lines, head: str):
    """Lines numbered by the header that they follow; lines before the first one are left out."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("island", F.sum(F.col("raw").rlike(T.java(head)).cast("int")).over(w)).where("island > 0")


def _last(pattern: str, group: int):
    """The group of the island's last line that fits; null without one."""
    p = T.java(pattern)
    return F.max_by(F.when(F.col("raw").rlike(p), F.regexp_extract("raw", p, group)), F.when(F.col("raw").rlike(p), F.col("pos")))


_HEAD_RUST = "'error[E' || (300 + l_linenumber) || ']: cannot find value `v` for ''x' || (l_partkey % 9) || ''''"
_RUST = _output_sql(_HEAD_RUST, "CASE WHEN l_returnflag = 'N' THEN '  = note: try again' ELSE '  --> src/m' || (l_suppkey % 10) || '.rs:' || l_linenumber || ':' || l_suppkey END")


@query("parse_rust", f"""WITH {_RUST}, i AS (SELECT *, sum(CASE WHEN regexp_matches(raw, {D.q(R.RUST_HEAD)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM output),
  g AS (SELECT doc_id, min(pos) AS pos, 'E' || regexp_extract(arg_min(raw, pos), {D.q(R.RUST_HEAD)}, 1) AS code, regexp_extract(arg_min(raw, pos), {D.q(R.RUST_HEAD)}, 2) AS message, arg_max(raw, pos) FILTER (regexp_matches(raw, {D.q(R.RUST_PLACE)})) AS place FROM i WHERE island > 0 GROUP BY doc_id, island)
  SELECT doc_id, pos, code, message, coalesce(regexp_extract(place, {D.q(R.RUST_PLACE)}, 1), 'unknown') AS file, coalesce(CAST(regexp_extract(place, {D.q(R.RUST_PLACE)}, 2) AS INTEGER), 0) AS line FROM g""")


def parse_rust(spark, sf_dir):
    head = F.concat(F.lit("error[E"), 300 + F.col("l_linenumber"), F.lit("]: cannot find value `v` for 'x"), F.col("l_partkey") % 9, F.lit("'"))
    place = F.when(F.col("l_returnflag") == "N", "  = note: try again").otherwise(F.concat(F.lit("  --> src/m"), F.col("l_suppkey") % 10, F.lit(".rs:"), "l_linenumber", F.lit(":"), "l_suppkey"))
    return rust_errors(output_lines(spark, sf_dir, head, place)).select("doc_id", "pos", "code", "message", "file", "line")


def rust_errors(lines):
    g = _islands(lines, R.RUST_HEAD).groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("head"), _last(R.RUST_PLACE, 1).alias("file"), _last(R.RUST_PLACE, 2).alias("line"))
    part = lambda k: F.regexp_extract("head", T.java(R.RUST_HEAD), k)
    out = g.select("doc_id", "pos", F.concat(F.lit("E"), part(1)).alias("code"), part(2).alias("message"), F.coalesce("file", F.lit("unknown")).alias("file"), F.coalesce(F.col("line").cast("int"), F.lit(0)).alias("line"))
    return out.withColumn("signature", signature(F.col("code"), F.col("message"))).withColumn("severity", F.lit("error"))


_WEBPACK = _output_sql("'ERROR in ./src/w' || (l_partkey % 20) || '.js:' || l_linenumber || ':' || l_suppkey", "CASE WHEN l_returnflag = 'N' THEN 'note' ELSE 'Module build failed (from loader): Error ' || l_linenumber END")


@query("parse_webpack", f"""WITH {_WEBPACK}, i AS (SELECT *, sum(CASE WHEN regexp_matches(raw, {D.q(R.WEBPACK_HEAD)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM output),
  g AS (SELECT doc_id, min(pos) AS pos, arg_min(raw, pos) AS head, arg_max(raw, pos) FILTER (regexp_matches(raw, {D.q(R.WEBPACK_DETAIL)})) AS detail FROM i WHERE island > 0 GROUP BY doc_id, island)
  SELECT doc_id, pos, regexp_extract(head, {D.q(R.WEBPACK_HEAD)}, 1) AS file, CAST(regexp_extract(head, {D.q(R.WEBPACK_HEAD)}, 2) AS INTEGER) AS line, regexp_extract(detail, {D.q(R.WEBPACK_DETAIL)}, 1) AS message FROM g WHERE detail IS NOT NULL""")


def parse_webpack(spark, sf_dir):
    head = F.concat(F.lit("ERROR in ./src/w"), F.col("l_partkey") % 20, F.lit(".js:"), "l_linenumber", F.lit(":"), "l_suppkey")
    detail = F.when(F.col("l_returnflag") == "N", "note").otherwise(F.concat(F.lit("Module build failed (from loader): Error "), "l_linenumber"))
    return webpack_errors(output_lines(spark, sf_dir, head, detail)).select("doc_id", "pos", "file", "line", "message")


def webpack_errors(lines):
    """Errors with a message; a header without one is no error."""
    g = _islands(lines, R.WEBPACK_HEAD).groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.min_by("raw", "pos").alias("head"), _last(R.WEBPACK_DETAIL, 1).alias("message"))
    part = lambda k: F.regexp_extract("head", T.java(R.WEBPACK_HEAD), k)
    number = F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0))
    out = g.where("message is not null").select("doc_id", "pos", part(1).alias("file"), number.alias("line"), "message", F.lit("WEBPACK").alias("code"))
    return out.withColumn("signature", signature(F.col("code"), F.col("message"))).withColumn("severity", F.lit("error"))


_GO = _output_sql("'./pkg/g' || (l_partkey % 20) || '.go:' || l_linenumber || ':' || l_suppkey || ': undefined: name' || (l_suppkey % 7)", "'note: see above'")


@query("parse_go", f"WITH {_GO} SELECT doc_id, pos, regexp_extract(raw, {D.q(R.GO_ERROR)}, 1) AS file, CAST(regexp_extract(raw, {D.q(R.GO_ERROR)}, 2) AS INTEGER) AS line, regexp_extract(raw, {D.q(R.GO_ERROR)}, 4) AS message, {_signature_sql(D.q('GO'), f'regexp_extract(raw, {D.q(R.GO_ERROR)}, 4)')} AS signature FROM output WHERE regexp_matches(raw, {D.q(R.GO_ERROR)})")
def parse_go(spark, sf_dir):
    head = F.concat(F.lit("./pkg/g"), F.col("l_partkey") % 20, F.lit(".go:"), "l_linenumber", F.lit(":"), "l_suppkey", F.lit(": undefined: name"), F.col("l_suppkey") % 7)
    return go_errors(output_lines(spark, sf_dir, head, F.lit("note: see above"))).select("doc_id", "pos", "file", "line", "message", "signature")


def go_errors(lines):
    part = lambda k: F.regexp_extract("raw", T.java(R.GO_ERROR), k)
    out = lines.where(F.col("raw").rlike(T.java(R.GO_ERROR))).select("doc_id", "pos", part(1).alias("file"), part(2).cast("int").alias("line"), part(4).alias("message"), F.lit("GO").alias("code"))
    return out.withColumn("signature", signature(F.col("code"), F.col("message"))).withColumn("severity", F.lit("error"))


_ANY = _output_sql("'  at src/a' || (l_partkey % 20) || '.c:' || l_linenumber || ':' || l_suppkey", "CASE l_returnflag WHEN 'N' THEN 'warning: unused ''v' || l_suppkey || '''' WHEN 'A' THEN 'error[X' || l_linenumber || ']: bad value ' || l_suppkey ELSE 'note' END")


@query("parse_generic", f"""WITH {_ANY}, k AS (SELECT *, CASE WHEN regexp_matches(raw, {D.q(R.ANY_ERROR)}) THEN 'error' WHEN regexp_matches(raw, {D.q(R.ANY_WARNING)}) THEN 'warning' END AS severity, CASE WHEN regexp_matches(raw, {D.q(R.ANY_PLACE)}) THEN raw END AS place FROM output),
  s AS (SELECT *, count(severity) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM k),
  f AS (SELECT *, last_value(place IGNORE NULLS) OVER (PARTITION BY doc_id, span ORDER BY pos) AS seen FROM s)
  SELECT doc_id, pos, severity, coalesce(nullif(CASE severity WHEN 'error' THEN regexp_extract(raw, {D.q(R.ANY_ERROR)}, 1) ELSE regexp_extract(raw, {D.q(R.ANY_WARNING)}, 1) END, ''), upper(severity)) AS code,
    CASE severity WHEN 'error' THEN regexp_extract(raw, {D.q(R.ANY_ERROR)}, 2) ELSE regexp_extract(raw, {D.q(R.ANY_WARNING)}, 2) END AS message,
    coalesce(regexp_extract(seen, {D.q(R.ANY_PLACE)}, 1), 'unknown') AS file, coalesce(CAST(regexp_extract(seen, {D.q(R.ANY_PLACE)}, 2) AS INTEGER), 0) AS line FROM f WHERE severity IS NOT NULL""")


def parse_generic(spark, sf_dir):
    place = F.concat(F.lit("  at src/a"), F.col("l_partkey") % 20, F.lit(".c:"), "l_linenumber", F.lit(":"), "l_suppkey")
    told = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("warning: unused 'v"), "l_suppkey", F.lit("'"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("error[X"), "l_linenumber", F.lit("]: bad value "), "l_suppkey")).otherwise("note")
    return any_errors(output_lines(spark, sf_dir, place, told)).select("doc_id", "pos", "severity", "code", "message", "file", "line")


def any_errors(lines):
    """Error and warning lines with the last place named since the one before; a place is used once."""
    raw, fits = F.col("raw"), lambda p: F.col("raw").rlike(T.java(p))
    x = lines.withColumn("severity", F.when(fits(R.ANY_ERROR), "error").when(fits(R.ANY_WARNING), "warning")).withColumn("place", F.when(fits(R.ANY_PLACE), raw))
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = x.withColumn("span", F.count("severity").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("at", F.last("place", ignorenulls=True).over(Window.partitionBy("doc_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda k: F.when(F.col("severity") == "error", F.regexp_extract("raw", T.java(R.ANY_ERROR), k)).otherwise(F.regexp_extract("raw", T.java(R.ANY_WARNING), k))
    where = lambda k: F.regexp_extract("at", T.java(R.ANY_PLACE), k)
    out = x.where("severity is not null").select("doc_id", "pos", "severity", F.coalesce(F.nullif(part(1), F.lit("")), F.upper("severity")).alias("code"), part(2).alias("message"), F.coalesce(where(1), F.lit("unknown")).alias("file"), F.coalesce(where(2).cast("int"), F.lit(0)).alias("line"))
    return out.withColumn("signature", signature(F.col("code"), F.col("message")))


_ANALYZED = """SELECT l_orderkey AS doc_id, 'rust' AS tool, 'E' || (300 + l_linenumber) || ':cannot find ' || chr(39) || 'X' || chr(39) AS signature, count(*) AS n, 'cannot find ' || chr(39) || 'x' || chr(39) AS sample, 1 AS files FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, l_linenumber
  UNION ALL SELECT l_orderkey, 'go', 'GO:undefined', count(*), 'undefined', 1 FROM lineitem WHERE l_orderkey % 3 = 1 GROUP BY 1 UNION ALL SELECT l_orderkey, 'webpack', 'WEBPACK:bad', count(*), 'bad', 1 FROM lineitem WHERE l_orderkey % 3 = 2 GROUP BY 1"""


@query("analyze_build", _ANALYZED)
def analyze_build(spark, sf_dir):
    """Each order's output through the parser of its tool, grouped by signature."""
    from .logs import joined

    head = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("error[E"), 300 + F.col("l_linenumber"), F.lit("]: cannot find 'x'"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("./g.go:"), "l_linenumber", F.lit(":1: undefined"))).otherwise(F.concat(F.lit("ERROR in ./w.js:"), "l_linenumber", F.lit(":2")))
    lines = output_lines(spark, sf_dir, head, F.when(F.col("l_orderkey") % 3 == 0, F.lit("  --> src/m.rs:1:2")).otherwise("Module build failed (from x): bad"))
    tools = joined(lines, "doc_id", "pos", "raw", "c").select("doc_id", F.expr(_tool(_SPARK_MATCH)).alias("tool"))
    told = lines.join(tools, "doc_id")
    parsers = {"rust": rust_errors, "webpack": webpack_errors, "go": go_errors, "generic": any_errors}
    columns = ["doc_id", "pos", "file", "line", "message", "code", "severity", "signature"]
    errors = None
    for tool, parse in parsers.items():
        part = parse(told.where(F.col("tool") == tool).select("doc_id", "pos", "raw")).select(*columns, F.lit(tool).alias("tool"))
        errors = part if errors is None else errors.unionByName(part)
    return errors.groupBy("doc_id", "tool", "signature").agg(F.count("*").alias("n"), F.min_by("message", "pos").alias("sample"), F.count_distinct("file").alias("files"))
