"""Queries of compressors: by line shapes, stack traces, and dispatch by content type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import compress, config
from ..ship import ship
from . import detect
from . import duck as D
from . import inputs as I
from .registry import query
from .search import semantic_sql

# Oracles. Each piece reads a table of lines (id, pos, raw).
_LEVEL = "CASE " + " ".join(f"WHEN contains(upper(raw), '[{v}]') OR contains(upper(raw), ' {v} ') THEN '{v}'" for v in R.LINE_LEVELS) + " END"


def logs_sql(lines: str, out: str) -> str:
    return f"""{out}_g AS (SELECT id, trim({D.rewrite('raw', R.LOG_LINE)}) AS norm, min(pos) AS p, arg_min(raw, pos) AS sample, count(*) AS n, arg_min(coalesce({_LEVEL} IN ('ERROR', 'FATAL'), false), pos) AS e, arg_min(coalesce({_LEVEL} IN ('WARN', 'WARNING'), false), pos) AS w FROM {lines} WHERE trim(raw) <> '' GROUP BY 1, 2),
  {out} AS (SELECT id, string_agg(sample || CASE WHEN n > 1 THEN chr(10) || '  ... (' || (n - 1) || ' similar entries' || CASE WHEN NOT e AND NOT w AND n > 3 THEN ' omitted' ELSE '' END || ')' ELSE '' END, chr(10) ORDER BY e DESC, w DESC, n DESC, p) AS compressed FROM {out}_g GROUP BY 1)"""


def generic_sql(lines: str, out: str) -> str:
    norm = f"trim({D.rewrite('raw', R.GENERIC_LINE)})"
    return f"""{out}_a AS (SELECT id, pos, raw, CASE WHEN {norm} = lag({norm}) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM {lines}),
  {out}_b AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM {out}_a), {out}_c AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS m FROM {out}_b),
  {out}_d AS (SELECT id, pos, 0 AS sub, raw FROM {out}_c WHERE m < 3 OR fresh = 1 UNION ALL SELECT id, pos, 1, '  ... (repeated ' || (m - 1) || ' more times)' FROM {out}_c WHERE m >= 3 AND fresh = 1),
  {out}_g AS (SELECT id, {norm} AS norm, min((pos, sub)) AS p, count(*) AS n, bool_or(regexp_matches(raw, {D.q(R.ERROR_LINE)})) AS e, bool_or(regexp_matches(raw, {D.q(R.WARNING_LINE)})) AS w, string_agg(raw, chr(10) ORDER BY pos, sub) AS everything, arg_min(raw, (pos, sub)) AS sample FROM {out}_d WHERE trim(raw) <> '' GROUP BY 1, 2),
  {out} AS (SELECT id, string_agg(CASE WHEN n <= 3 THEN everything ELSE sample || chr(10) || '  ... (' || (n - 1) || CASE WHEN e THEN ' similar errors)' WHEN w THEN ' similar warnings)' ELSE ' similar lines omitted)' END END, chr(10) ORDER BY p) AS compressed FROM {out}_g GROUP BY 1)"""


def trace_sql(lines: str, out: str) -> str:
    return f"""{out}_a AS (SELECT *, regexp_matches(raw, '^\\s+at\\s') AND {D.any_of('raw', R.INTERNAL_FRAME)} AS inside FROM {lines}),
  {out}_b AS (SELECT *, CASE WHEN inside AND lag(inside) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM {out}_a), {out}_c AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM {out}_b),
  {out}_g AS (SELECT id, run, min(pos) AS p, count(*) AS n, arg_min(raw, pos) AS raw, bool_and(inside) AS inside FROM {out}_c GROUP BY 1, 2),
  {out} AS (SELECT id, string_agg(CASE WHEN inside THEN '    ... (' || n || ' internal frames omitted)' ELSE raw END, chr(10) ORDER BY p) AS compressed FROM {out}_g GROUP BY 1)"""


def errors_sql(lines: str, out: str) -> str:
    return f"""{out}_g AS (SELECT id, trim({D.rewrite('raw', R.NORMALIZE_ERROR)}) AS norm, min(pos) AS p, arg_min(raw, pos) AS sample, count(*) AS n FROM {lines} WHERE trim(raw) <> '' GROUP BY 1, 2),
  {out} AS (SELECT id, CAST(sum(n) AS BIGINT) || ' lines -> ' || count(*) || ' unique patterns (' || CAST(sum(n) - count(*) AS BIGINT) || ' duplicates removed)' || chr(10) || chr(10) || string_agg(sample || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END, chr(10) ORDER BY n DESC, p) AS compressed FROM {out}_g GROUP BY 1)"""


def hunks_sql(lines: str, out: str) -> str:
    return f"""{out}_a AS (SELECT *, max(CASE WHEN regexp_matches(raw, '^[+-]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR regexp_matches(raw, '^(diff|@@)') AS near FROM {lines}),
  {out} AS (SELECT id, string_agg(raw, chr(10) ORDER BY pos) AS compressed FROM {out}_a WHERE near GROUP BY 1)"""


_LOGS = f"{D.LOG_LINES}, lines AS (SELECT doc_id AS id, pos, raw FROM log_lines)"


def _lines(spark, sf_dir):
    return I.log_lines(spark, sf_dir).select("doc_id", "pos", "raw")


@query("compress_logs", f"WITH {_LOGS}, {logs_sql('lines', 'made')} SELECT id AS doc_id, compressed FROM made")
def compress_logs(spark, sf_dir):
    return compress.logs(_lines(spark, sf_dir), "doc_id")


@query("compress_generic", f"WITH {_LOGS}, {generic_sql('lines', 'made')} SELECT id AS doc_id, compressed FROM made")
def compress_generic(spark, sf_dir):
    return compress.generic(_lines(spark, sf_dir), "doc_id")


_TRACES = f"{D.LOG_LINES}, traces AS (SELECT doc_id AS id, pos, CASE WHEN pos = 1 THEN 'TypeError: bad value ' || doc_id ELSE '    at f' || event_id || ' (' || CASE WHEN event_type IN ('click', 'view') THEN 'node_modules/lib/index.js:1:2' ELSE '/src/a' || (event_id % 7) || '.ts:3:4' END || ')' END AS raw FROM log_lines)"


def trace_lines(spark, sf_dir):
    """(doc_id, pos, raw): a trace for each user, a frame for each event."""
    x = I.log_lines(spark, sf_dir)
    where = F.when(F.col("event_type").isin("click", "view"), F.lit("node_modules/lib/index.js:1:2")).otherwise(F.concat(F.lit("/src/a"), F.col("event_id") % 7, F.lit(".ts:3:4")))
    frame = F.concat(F.lit("    at f"), "event_id", F.lit(" ("), where, F.lit(")"))
    return x.select("doc_id", "pos", F.when(F.col("pos") == 1, F.concat(F.lit("TypeError: bad value "), "doc_id")).otherwise(frame).alias("raw"))


@query("compress_stacktrace", f"WITH {_TRACES}, {trace_sql('traces', 'made')} SELECT id AS doc_id, compressed FROM made")
def compress_stacktrace(spark, sf_dir):
    return compress.stacktrace(trace_lines(spark, sf_dir), "doc_id")


@query("collapse_frames", f"WITH {_TRACES}, {trace_sql('traces', 'made')} SELECT id AS doc_id, p AS start, n AS length FROM made_g WHERE inside")
def collapse_frames(spark, sf_dir):
    """Runs of internal frames."""
    x = compress.internal_runs(trace_lines(spark, sf_dir), "doc_id").where("inside")
    return x.groupBy("doc_id", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("run")


# Dispatch.


def content_type(c):
    """stacktrace, logs, config, code or generic, in this order of tests."""
    lines = F.split(c, "\n")
    share = F.size(F.filter(lines, lambda x: T.any_of(x, R.LOG_MARK))) / F.size(lines)
    trace = (c.rlike(R.TRACE_HEAD) & c.rlike(R.TRACE_FRAME)) | c.rlike(R.TRACE_OTHER)
    yaml = F.size(F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(T.java(R.YAML_LINE)))) >= 3
    json = c.rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull()
    return F.when(F.length(F.trim(c)) < 10, "generic").when(trace, "stacktrace").when(share >= 0.3, "logs").when(json | yaml, "config").when(T.any_of(c, R.CODE), "code").otherwise("generic")


_TYPE = f"""CASE WHEN length(trim(c)) < 10 THEN 'generic' WHEN (regexp_matches(c, {D.q(R.TRACE_HEAD)}) AND regexp_matches(c, {D.q(R.TRACE_FRAME)})) OR regexp_matches(c, {D.q(R.TRACE_OTHER)}) THEN 'stacktrace'
  WHEN len(list_filter(string_split(c, chr(10)), lambda x: {D.any_of('x', R.LOG_MARK)})) / CAST(len(string_split(c, chr(10))) AS DOUBLE) >= 0.3 THEN 'logs'
  WHEN (regexp_matches(c, '^\\s*[\\[{{]') AND json_valid(c)) OR len(list_filter(string_split(c, chr(10))[:10], lambda x: regexp_matches(x, {D.q(R.YAML_LINE)}))) >= 3 THEN 'config' WHEN {D.any_of('c', R.CODE)} THEN 'code' ELSE 'generic' END"""


@query("detect_content_type", f"WITH {D.LOG_LINES}, {D.CODE_FILES}, t AS (SELECT 'log' || doc_id AS id, string_agg(raw, chr(10) ORDER BY pos) AS c FROM log_lines GROUP BY 1 UNION ALL SELECT path, content FROM code_files UNION ALL SELECT 'props' || event_id, props FROM events UNION ALL SELECT 'doc' || doc_id, coalesce(text, '') FROM documents) SELECT id, {_TYPE} AS content_type FROM t")
def detect_content_type(spark, sf_dir):
    """The type of logs, source files, JSON texts and documents."""
    logs = compress.joined(I.log_lines(spark, sf_dir).select(F.concat(F.lit("log"), "doc_id").alias("id"), "pos", "raw"), "id", ["pos"], "raw", "c")
    files = I.code_files(spark, sf_dir).select(F.col("path").alias("id"), F.col("content").alias("c"))
    props = I.table(spark, sf_dir, "events").select(F.concat(F.lit("props"), "event_id").alias("id"), F.col("props").alias("c"))
    docs = I.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("c"))
    return logs.unionByName(files).unionByName(props).unionByName(docs).select("id", content_type(F.col("c")).alias("content_type"))


def by_type(texts, kind: str, ways: dict):
    """(id, kind, compressed): each text by the compressor of its kind; every branch filters its own texts, so that it runs its own plan."""
    out = None
    for name, way in ways.items():
        mine = texts.where(F.col(kind) == name)
        part = way(mine).join(mine.select("id", kind), "id") if way else mine.select("id", F.col("c").alias("compressed"), kind)
        part = part.select("id", kind, "compressed")
        out = part if out is None else out.unionByName(part)
    return out


def _by_lines(f):
    return lambda texts: f(compress.lines_of(texts, "id", "c"), "id")


def _config(texts):
    return texts.select("id", config.column(config.brief_config, F.col("c")).alias("compressed"))


WAYS = {"logs": _by_lines(compress.logs), "stacktrace": _by_lines(compress.stacktrace), "config": _config, "code": _by_lines(compress.generic), "generic": _by_lines(compress.generic)}


def auto(texts):
    """(id, content_type, compressed) of ``texts`` (id, c), each by the compressor of its type. A text that leaves no line to show, as the empty one, has no row."""
    return by_type(texts.withColumn("content_type", content_type(F.col("c"))), "content_type", WAYS)


TYPED_SQL = f"{detect.TEXTS_SQL}, typed AS (SELECT id, c, {_TYPE} AS kind FROM texts)"


def _lines_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT id, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS raw FROM typed WHERE {where})"


_AUTO = f"""{TYPED_SQL}, {_lines_sql('l1', "kind = 'logs'")}, {logs_sql('l1', 'm1')}, {_lines_sql('l2', "kind = 'stacktrace'")}, {trace_sql('l2', 'm2')}, {_lines_sql('l3', "kind IN ('code', 'generic')")}, {generic_sql('l3', 'm3')},
  made AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


AUTO_HASH_SQL = f"WITH {_AUTO} SELECT id, kind AS content_type, md5(compressed) AS hash FROM made JOIN typed USING (id) WHERE kind <> 'config'"


@query("compress_auto", f"WITH {_AUTO} SELECT id, kind AS content_type, {D.tokens('c')} AS tokens, {D.tokens('compressed')} AS compressed_tokens, md5(compressed) AS hash FROM made JOIN typed USING (id) WHERE kind <> 'config'")
def compress_auto(spark, sf_dir):
    """Texts of all types but configuration, whose compressors have queries of their own, each by the compressor of its type."""
    ship(spark)
    texts = detect.texts(spark, sf_dir)
    made = auto(texts).where("content_type <> 'config'").join(texts, "id")
    return made.select("id", "content_type", T.token_count(F.col("c")).alias("tokens"), T.token_count(F.col("compressed")).alias("compressed_tokens"), F.md5("compressed").alias("hash"))


def optimized_kind(c):
    """short, build, logs, errors or generic."""
    logs = T.any_of(c, [R.LOG_MARK[0], *R.SERVER_LINE])
    return F.when(F.length(c) < 500, "short").when(T.any_of(c, R.BUILD_HINT), "build").when(logs, "logs").when(T.any_of(c, R.CONTENT_FLAGS["has_errors"]), "errors").otherwise("generic")


_KIND = f"CASE WHEN length(c) < 500 THEN 'short' WHEN {D.any_of('c', R.BUILD_HINT)} THEN 'build' WHEN {D.any_of('c', [R.LOG_MARK[0], *R.SERVER_LINE])} THEN 'logs' WHEN {D.any_of('c', R.CONTENT_FLAGS['has_errors'])} THEN 'errors' ELSE 'generic' END"
_OPTIMIZED = f"""{detect.TEXTS_SQL}, typed AS (SELECT id, c, {_KIND} AS kind FROM texts), {_lines_sql('l1', "kind IN ('build', 'errors')")}, {errors_sql('l1', 'm1')}, {_lines_sql('l2', "kind = 'logs'")}, {logs_sql('l2', 'm2')}, {_lines_sql('l3', "kind = 'generic'")}, {generic_sql('l3', 'm3')},
  made AS (SELECT id, c AS compressed FROM typed WHERE kind = 'short' UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


@query("auto_optimize", f"WITH {_OPTIMIZED} SELECT id, kind AS detected, {D.tokens('c')} AS tokens, {D.tokens('compressed')} AS optimized_tokens, md5(compressed) AS hash FROM made JOIN typed USING (id)")
def auto_optimize(spark, sf_dir):
    """Texts under 500 characters stay; others by the first of build output, logs, errors, or any."""
    c, kind = F.col("c"), F.col("detected")
    x = detect.texts(spark, sf_dir).withColumn("detected", optimized_kind(c))
    made = F.when(kind == "short", c).when(kind.isin("build", "errors"), compress.error_groups_text(c)).when(kind == "logs", compress.logs_text(c)).otherwise(compress.generic_text(c))
    # exploded, so that the test for null doesn't make the text once more
    x = x.select("id", "detected", T.token_count(c).alias("tokens"), F.explode_outer(F.array(made)).alias("compressed")).where("compressed is not null")
    return x.select("id", "detected", "tokens", T.token_count(F.col("compressed")).alias("optimized_tokens"), F.md5("compressed").alias("hash"))


def build_summary_text(c):
    """The errors of build output by signature, the commonest first, as the parser of its tool reads them; null without any. The text is column c."""
    part = lambda x, p, k: F.regexp_extract(x, T.java(p), k)
    fits = lambda p: lambda x: x.rlike(T.java(p))
    lines = F.split(c, "\n", -1)
    each = lambda p, f: F.transform(F.filter(lines, fits(p)), f)
    details = F.transform(F.filter(F.split(c, r"\n(?=ERROR in .)", -1), lambda x: x.rlike("^ERROR in .")), lambda x: F.try_element_at(F.filter(F.split(x, "\n", -1), fits(R.WEBPACK_DETAIL)), F.lit(-1)))
    error = lambda x: fits(R.ANY_ERROR)(x)
    either = lambda x, k: F.when(error(x), part(x, R.ANY_ERROR, k)).otherwise(part(x, R.ANY_WARNING, k))
    ways = {
        "tsc": each(R.TSC, lambda x: F.concat(part(x, R.TSC, 5), F.lit(":"), F.trim(T.rewrite(part(x, R.TSC, 6), R.TSC_MESSAGE)))),
        "rust": each(R.RUST_HEAD, lambda x: detect.signature(F.concat(F.lit("E"), part(x, R.RUST_HEAD, 1)), part(x, R.RUST_HEAD, 2))),
        "go": each(R.GO_ERROR, lambda x: detect.signature(F.lit("GO"), part(x, R.GO_ERROR, 4))),
        "webpack": F.transform(F.filter(details, lambda x: x.isNotNull()), lambda x: detect.signature(F.lit("WEBPACK"), part(x, R.WEBPACK_DETAIL, 1))),
    }
    found = F.transform(F.filter(lines, lambda x: error(x) | fits(R.ANY_WARNING)(x)), lambda x: detect.signature(F.coalesce(F.nullif(either(x, 1), F.lit("")), F.when(error(x), "ERROR").otherwise("WARNING")), either(x, 2)))
    for tool, way in ways.items():
        found = F.when(F.col("tool") == tool, way).otherwise(found)
    return compress.counted_text(found)


def log_summary_text(c):
    """Requests and errors of servers, lines by level of others; null where no line is counted. The text is column c."""
    full, http = F.filter(F.split(c, "\n", -1), lambda x: F.trim(x) != ""), T.java(R.HTTP)
    codes = F.transform(F.filter(full, lambda x: x.rlike(http)), lambda x: F.regexp_extract(x, http, 3).cast("int"))
    levels = F.transform(full, T.log_level)
    number = lambda xs, name: F.size(F.filter(xs, lambda v: v == name))
    of_server = compress.let(codes, lambda v: F.when(F.size(v) > 0, F.concat(F.size(v), F.lit(" requests, "), F.size(F.filter(v, lambda k: k >= 400)), F.lit(" errors"))))
    other = compress.let(levels, lambda v: F.when(F.size(v) > 0, F.concat(F.size(v), F.lit(" lines, "), number(v, "error"), F.lit(" errors, "), number(v, "warning"), F.lit(" warnings"))))
    return F.when(detect.summarizer_of("c") == "server", of_server).otherwise(other)


def config_text(c):
    return config.column(config.brief_config, c)


#: Steps of each type: the tools that its chain names, done in turn until one saves nothing, at most five.
STEPS = {
    "build": [build_summary_text, compress.error_groups_text],
    "logs": [log_summary_text],
    "stacktrace": [compress.error_groups_text, compress.semantic_text],
    "diff": [compress.hunks_text],
    "config": [config_text],
    "code": [compress.semantic_text],
    "generic": [compress.semantic_text],
}


def chain_type(texts):
    """``texts`` (id, c) with pipeline_type: diff, logs or build, else the type of the content."""
    x = detect.pipeline_type(texts)
    return x.withColumn("pipeline_type", F.when(F.col("pipeline_type") == "generic", content_type(F.col("c"))).otherwise(F.col("pipeline_type")))


def piped(texts, steps: dict = STEPS, most: int = 5):
    """(id, pipeline_type, steps, c, tokens) of ``texts`` (id, c, pipeline_type): each type's steps in turn, ended by the first that saves nothing; tokens are those of the text before.

    A step that has nothing to show is left out.
    """
    ship(texts.sparkSession)
    c, kind = F.col("c"), F.col("pipeline_type")
    x = texts.select("id", "pipeline_type", "c", T.token_count(c).alias("tokens"), F.lit(True).alias("going"), F.lit(0).alias("steps"))
    for k in range(min(most, max(map(len, steps.values())))):
        mine = {}
        for name, chain in steps.items():
            if k < len(chain):
                mine.setdefault(chain[k], []).append(name)
        made = F.lit(None).cast("string")
        for step, names in mine.items():
            now = F.col("going") & kind.isin(names)
            made = F.when(now, step(F.when(now, c))).otherwise(made)  # steps in Python run for every row, and skip null
        if build_summary_text in mine:
            x = x.withColumn("tool", F.when(kind.isin(mine[build_summary_text]), detect.build_tool()))
        x = x.withColumn("made", made).select("*", F.explode_outer(F.array("made")).alias("compressed"))
        did = F.col("compressed").isNotNull()
        shrinks = ~did | (T.token_count(F.col("compressed")) < T.token_count(c))
        x = x.select("id", "pipeline_type", F.coalesce("compressed", "c").alias("c"), "tokens", (F.col("going") & shrinks).alias("going"), (F.col("steps") + did.cast("int")).alias("steps"))
    return x


def _signed_sql(code: str, message: str) -> str:
    return f"{code} || ':' || trim(substring({D.rewrite(message, detect.SIGNATURE)}, 1, 100))"


def _part(p: str, k: int) -> str:
    return f"regexp_extract(raw, {D.q(p)}, {k})"


def _fits(p: str) -> str:
    return f"regexp_matches(raw, {D.q(p)})"


def build_summary_sql(lines: str, out: str) -> str:
    any_part = lambda k: f"CASE WHEN {_fits(R.ANY_ERROR)} THEN {_part(R.ANY_ERROR, k)} ELSE {_part(R.ANY_WARNING, k)} END"
    tsc = f"{_part(R.TSC, 5)} || ':' || trim({D.rewrite(_part(R.TSC, 6), R.TSC_MESSAGE)})"
    any_code = f"coalesce(nullif({any_part(1)}, ''), CASE WHEN {_fits(R.ANY_ERROR)} THEN 'ERROR' ELSE 'WARNING' END)"
    rust_code = f"'E' || {_part(R.RUST_HEAD, 1)}"
    return f"""{out}_t AS (SELECT id, {detect.BUILD_TOOL_SQL} AS tool FROM typed WHERE kind = 'build'), {out}_l AS (SELECT * FROM {lines} JOIN {out}_t USING (id)),
  {out}_w AS (SELECT *, sum(CASE WHEN {_fits(R.WEBPACK_HEAD)} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS island FROM {out}_l WHERE tool = 'webpack'),
  {out}_d AS (SELECT id, arg_max(raw, pos) AS raw FROM {out}_w WHERE island > 0 AND {_fits(R.WEBPACK_DETAIL)} GROUP BY id, island),
  {out}_s AS (SELECT id, {tsc} AS signature FROM {out}_l WHERE tool = 'tsc' AND {_fits(R.TSC)}
    UNION ALL SELECT id, {_signed_sql(rust_code, _part(R.RUST_HEAD, 2))} FROM {out}_l WHERE tool = 'rust' AND {_fits(R.RUST_HEAD)}
    UNION ALL SELECT id, {_signed_sql("'GO'", _part(R.GO_ERROR, 4))} FROM {out}_l WHERE tool = 'go' AND {_fits(R.GO_ERROR)}
    UNION ALL SELECT id, {_signed_sql("'WEBPACK'", _part(R.WEBPACK_DETAIL, 1))} FROM {out}_d
    UNION ALL SELECT id, {_signed_sql(any_code, any_part(2))} FROM {out}_l WHERE tool NOT IN ('tsc', 'rust', 'go', 'webpack') AND ({_fits(R.ANY_ERROR)} OR {_fits(R.ANY_WARNING)})),
  {out} AS (SELECT id, CAST(sum(n) AS BIGINT) || ' errors in ' || count(*) || ' groups: ' || string_agg(signature || ' x' || n, '; ' ORDER BY n DESC, signature) AS compressed FROM (SELECT id, signature, count(*) AS n FROM {out}_s GROUP BY 1, 2) GROUP BY 1)"""


def log_summary_sql(lines: str, out: str) -> str:
    return f"""{out}_k AS (SELECT id, {detect.SUMMARIZER_SQL} AS summarizer FROM (SELECT id, c, string_split(c, chr(10))[:100] AS ls FROM typed WHERE kind = 'logs')), {out}_n AS (SELECT * FROM {lines} JOIN {out}_k USING (id) WHERE trim(raw) <> ''),
  {out} AS (SELECT id, count(*) || ' requests, ' || count(*) FILTER (CAST({_part(R.HTTP, 3)} AS INTEGER) >= 400) || ' errors' AS compressed FROM {out}_n WHERE summarizer = 'server' AND {_fits(R.HTTP)} GROUP BY 1
    UNION ALL SELECT id, count(*) || ' lines, ' || count(*) FILTER (lvl = 'error') || ' errors, ' || count(*) FILTER (lvl = 'warning') || ' warnings' FROM (SELECT id, {D.level('raw')} AS lvl FROM {out}_n WHERE summarizer <> 'server') GROUP BY 1)"""


def _semantic(source: str, out: str) -> str:
    return f"{out} AS (SELECT doc_id AS id, compressed FROM ({semantic_sql('0.5', f'(SELECT id AS doc_id, c AS text FROM {source}) docs')}))"


# Configuration, of which the tables have no texts and whose compressor has queries of its own, is left as it is here.
_PIPED = f"""{detect.COUNTED_SQL}, told AS (SELECT id, c, {detect.PIPELINE_TYPE_SQL} AS k FROM counted), typed AS MATERIALIZED (SELECT id, c, CASE WHEN k = 'generic' THEN {_TYPE} ELSE k END AS kind FROM told),
  {_lines_sql('l1', "kind = 'build'")}, {build_summary_sql('l1', 'm1')}, {_lines_sql('l2', "kind = 'logs'")}, {log_summary_sql('l2', 'm2')}, {_lines_sql('l3', "kind = 'diff'")}, {hunks_sql('l3', 'm3')}, {_lines_sql('l4', "kind = 'stacktrace'")}, {errors_sql('l4', 'm4')},
  plain AS (SELECT id, c FROM typed WHERE kind IN ('code', 'generic')), {_semantic('plain', 'm5')}, one AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4 UNION ALL SELECT * FROM m5),
  again AS (SELECT t.id, kind, coalesce(compressed, c) AS c FROM typed t LEFT JOIN one ON one.id = t.id WHERE kind IN ('build', 'stacktrace') AND (compressed IS NULL OR {D.tokens('compressed')} < {D.tokens('c')})),
  l6 AS (SELECT id, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS raw FROM again WHERE kind = 'build'), {errors_sql('l6', 'm6')}, traces AS (SELECT id, c FROM again WHERE kind = 'stacktrace'), {_semantic('traces', 'm7')},
  two AS (SELECT * FROM m6 UNION ALL SELECT * FROM m7)"""


@query("smart_pipeline", f"WITH {_PIPED} SELECT t.id, kind AS pipeline_type, CASE WHEN one.id IS NULL THEN 0 ELSE 1 END + CASE WHEN two.id IS NULL THEN 0 ELSE 1 END AS steps, {D.tokens('t.c')} AS tokens, {D.tokens('coalesce(two.compressed, one.compressed, t.c)')} AS final_tokens, md5(coalesce(two.compressed, one.compressed, t.c)) AS hash FROM typed t LEFT JOIN one ON one.id = t.id LEFT JOIN two ON two.id = t.id")
def smart_pipeline(spark, sf_dir):
    """The steps of each text's type in turn."""
    x = piped(chain_type(detect.texts(spark, sf_dir)))
    return x.select("id", "pipeline_type", "steps", "tokens", T.token_count(F.col("c")).alias("final_tokens"), F.md5("c").alias("hash"))
