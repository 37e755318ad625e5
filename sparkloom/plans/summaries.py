"""Critical entries, section findings, hunks of diffs, template variables, and summaries by log type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import ordered, retrieval
from ..sources.tables import spread
from . import duck as D
from . import inputs as I
from .logs import _SCORES, joined, scored
from .more import _parsed_tests
from .registry import query

_LEVELS = ["error", "warning", "info", "debug"]


@query("hier_critical", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lvl ORDER BY score DESC, pos) AS r FROM log_scores WHERE lvl IN ('error', 'warning')) SELECT doc_id, pos, lvl, score FROM r WHERE r <= CASE lvl WHEN 'error' THEN 20 ELSE 10 END QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lvl, pos) <= 20")
def hier_critical(spark, sf_dir):
    """A report's 20 critical entries: the best 20 errors and 10 warnings, then the best of these."""
    x = scored(spark, sf_dir).where("lvl in ('error', 'warning')").withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "lvl").orderBy(F.desc("score"), "pos")))
    x = x.where("r <= case lvl when 'error' then 20 else 10 end").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "lvl", "pos")))
    return x.where("r <= 20").select("doc_id", "pos", "lvl", "score")


@query("section_findings", f"""WITH {D.LOG_LINES}, x AS (SELECT *, (pos - 1) // 20 AS section FROM log_lines), c AS (SELECT doc_id, section, count(*) FILTER (lvl = 'error') AS e, count(*) FILTER (lvl = 'warning') AS w FROM x GROUP BY 1, 2),
  p AS (SELECT doc_id, section, trim({D.rewrite('lower(message)', R.LOG_PATTERN)}) AS p, count(*) AS n FROM x WHERE lvl = 'error' GROUP BY 1, 2, 3 HAVING count(*) > 1), o AS (SELECT doc_id, section, arg_max(p, (n, p)) AS common FROM p GROUP BY 1, 2),
  m AS (SELECT doc_id, section, max(n) AS most, avg(n) AS mean FROM (SELECT doc_id, section, substring(ts_text, 1, 16) AS minute, count(*) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT doc_id, section, concat_ws('; ', CASE WHEN e > 0 THEN e || ' error' || CASE WHEN e > 1 THEN 's' ELSE '' END || ' detected' END, CASE WHEN w > 0 THEN w || ' warning' || CASE WHEN w > 1 THEN 's' ELSE '' END END, 'Common error: ' || substring(common, 1, 50), CASE WHEN most > 3 * mean THEN 'Activity spike detected (' || most || 'x normal)' END) AS findings FROM c LEFT JOIN o USING (doc_id, section) LEFT JOIN m USING (doc_id, section)""")


def section_findings(spark, sf_dir):
    """Up to four findings for each section of 20 lines: errors, warnings, the commonest error, spikes."""
    keys = ["doc_id", "section"]
    x = I.log_lines(spark, sf_dir).withColumn("section", F.floor((F.col("pos") - 1) / 20))
    counts = x.groupBy(keys).agg(F.count_if(F.col("lvl") == "error").alias("errors"), F.count_if(F.col("lvl") == "warning").alias("warnings"))
    common = x.where("lvl = 'error'").groupBy(*keys, T.normalize_log_pattern(F.col("message")).alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    common = common.groupBy(keys).agg(F.max_by("p", F.struct("n", "p")).alias("common"))
    minutes = x.groupBy(*keys, F.substring("ts_text", 1, 16).alias("minute")).agg(F.count("*").alias("n")).groupBy(keys).agg(F.max("n").alias("most"), F.avg("n").alias("mean"))
    y = counts.join(common, keys, "left").join(minutes, keys, "left")
    found = F.concat_ws(
        "; ",
        F.when(F.col("errors") > 0, F.concat("errors", F.lit(" error"), F.when(F.col("errors") > 1, "s").otherwise(""), F.lit(" detected"))),
        F.when(F.col("warnings") > 0, F.concat("warnings", F.lit(" warning"), F.when(F.col("warnings") > 1, "s").otherwise(""))),
        F.concat(F.lit("Common error: "), F.substring("common", 1, 50)),
        F.when(F.col("most") > 3 * F.col("mean"), F.concat(F.lit("Activity spike detected ("), "most", F.lit("x normal)"))),
    )
    return y.select(*keys, found.alias("findings"))


_HUNK_CHANGE = "regexp_matches(raw, '^[+-]')"
_HUNKS = f"""{D.DIFF_LINES}, hunks AS (SELECT doc_id % 200 AS diff, doc_id AS hunk, string_agg(raw, chr(10) ORDER BY pos) FILTER (pos > 0) AS content, count(*) FILTER ({_HUNK_CHANGE}) AS changes FROM diff_lines GROUP BY 1, 2),
  t AS (SELECT diff, hunk, len({D.TF_TOKENS.format(c='content')}) AS l, unnest({D.TF_TOKENS.format(c='content')}) AS term FROM hunks), tf AS (SELECT diff, hunk, term, count(*) / CAST(any_value(l) AS DOUBLE) AS tf FROM t GROUP BY 1, 2, 3),
  df AS (SELECT diff, term, count(*) AS df FROM tf GROUP BY 1, 2), nn AS (SELECT diff, count(*) AS n FROM hunks GROUP BY 1),
  sc AS (SELECT tf.diff, tf.hunk, least(avg(tf * ln(n / CAST(df AS DOUBLE))) / 2, 1) AS s FROM tf JOIN df USING (diff, term) JOIN nn USING (diff) GROUP BY 1, 2)"""


@query("hunk_scores", f"WITH {_HUNKS} SELECT h.diff, h.hunk, round(greatest(0, least(1, coalesce(s, 0) + CASE WHEN {D.any_of('content', [R.HUNK_FAILURE])} THEN 0.3 ELSE 0 END + CASE WHEN {D.any_of('content', [R.HUNK_DEFINITION])} THEN 0.2 ELSE 0 END + least(changes / 50.0, 0.2)))::DOUBLE, 6) AS score FROM hunks h LEFT JOIN sc USING (diff, hunk)")
def hunk_scores(spark, sf_dir):
    return hunks_scored(spark, sf_dir).select("diff", "hunk", "score")


def hunks_scored(spark, sf_dir):
    """(diff, hunk, content, changes, score): a hunk for each order, 200 diffs of them."""
    x = I.diff_lines(spark, sf_dir)
    content = joined(x.where("pos > 0"), "doc_id", "pos", "raw", "content")
    changes = x.groupBy("doc_id").agg(F.count_if(F.col("raw").rlike(r"^[+-]")).alias("changes"))
    h = content.join(changes, "doc_id").select((F.col("doc_id") % 200).alias("diff"), F.col("doc_id").alias("hunk"), "content", "changes")
    terms = retrieval.tfidf(h, "diff", "hunk", T.tfidf_tokens(F.col("content"))).groupBy("diff", "hunk").agg(F.least(F.avg("tfidf") / 2, F.lit(1.0)).alias("s"))
    plus = F.when(F.col("content").rlike(R.HUNK_FAILURE), 0.3).otherwise(0.0) + F.when(F.col("content").rlike(R.HUNK_DEFINITION), 0.2).otherwise(0.0) + F.least(F.col("changes") / 50, F.lit(0.2))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) + plus)), 6)
    return h.join(terms, ["diff", "hunk"], "left").select("diff", "hunk", "content", "changes", score.alias("score"))


@query("diff_semantic", f"WITH {_HUNKS}, hs AS (SELECT h.diff, h.hunk, content, {D.tokens('content')} AS tokens, round(greatest(0, least(1, coalesce(s, 0) + CASE WHEN {D.any_of('content', [R.HUNK_FAILURE])} THEN 0.3 ELSE 0 END + CASE WHEN {D.any_of('content', [R.HUNK_DEFINITION])} THEN 0.2 ELSE 0 END + least(changes / 50.0, 0.2)))::DOUBLE, 6) AS score FROM hunks h LEFT JOIN sc USING (diff, hunk)), g AS (SELECT diff, list({{'p': hunk, 'c': tokens}} ORDER BY score DESC, hunk) AS xs, CAST(floor(sum(tokens) / 2) AS BIGINT) AS budget FROM hs GROUP BY 1), k AS (SELECT diff, unnest({D.greedy('xs', 'budget')}) AS hunk FROM g) SELECT diff, string_agg(content, chr(10) ORDER BY hunk) AS compressed FROM hs JOIN k USING (diff, hunk) GROUP BY 1")
def diff_semantic(spark, sf_dir):
    """The best hunks of each diff within half its tokens, greedily; one that doesn't fit is skipped."""
    x = hunks_scored(spark, sf_dir).withColumn("tokens", T.token_count(F.col("content")))
    x = x.withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy("diff")) / 2))
    kept = ordered.greedy_budget(x, "diff", "hunk", F.col("score"), F.col("tokens"), F.col("budget")).select("diff", F.explode("kept").alias("hunk"))
    return joined(x.join(kept, ["diff", "hunk"]), "diff", "hunk", "content", "compressed")


def _names(to: str) -> str:
    return to.strip("<>'\"")


_VARS_SQL = "list_concat(" * (len(R.TEMPLATE) - 1) + ", ".join("list_transform(regexp_extract_all(" + D.rewrite("raw", R.TEMPLATE[:i]) + f", {D.q(p)}), lambda v, j: {{'name': '{_names(to)}_' || j, 'value': v}})" + (")" if i else "") for i, (p, to) in enumerate(R.TEMPLATE))


@query("log_template_vars", f"WITH {D.RICH}, v AS (SELECT event_id, {D.rewrite('raw', R.TEMPLATE)} AS template, unnest({_VARS_SQL}) AS v FROM rich) SELECT event_id, template, v.name AS name, v.value AS value FROM v")
def log_template_vars(spark, sf_dir):
    """(event_id, template, name, value): what stands in a line for each variable of its template, numbered within its class."""
    x = spread(I.rich_lines(spark, sf_dir).select("event_id", F.col("raw").alias("template")))
    for i, (pattern, to) in enumerate(R.TEMPLATE):  # each class is looked for in what the classes before it left, which is a column: every rewriting is done once
        values = F.regexp_extract_all("template", F.lit(T.java(pattern)), F.lit(0))
        x = x.withColumns({f"_{i}": _numbered(values, _names(to)), "template": T.rewrite(F.col("template"), [(pattern, to)])})
    x = x.select("event_id", "template", F.explode(F.concat(*[f"_{i}" for i in range(len(R.TEMPLATE))])).alias("v"))
    return x.select("event_id", "template", "v.name", "v.value")


def _numbered(values, name: str):
    return F.transform(values, lambda v, j: F.struct(F.concat(F.lit(name + "_"), j + 1).alias("name"), v.alias("value")))


# Summaries by log type.


@query("summarize_server", f"""WITH {D.HTTP_LINES}, p AS (SELECT user_id % 100 AS server, CAST(regexp_extract(raw, ' (\\d{{3}}) ', 1) AS INTEGER) AS status, CAST(regexp_extract(raw, '(\\d+)ms$', 1) AS BIGINT) AS ms FROM http_lines)
  SELECT server, count(*) || ' requests, ' || count(*) FILTER (status >= 400) || ' errors, avg ' || CAST(floor(avg(ms) + 0.5) AS BIGINT) || 'ms' AS overview FROM p GROUP BY 1""")


def summarize_server(spark, sf_dir):
    from .scalars import http_requests

    p = http_requests(I.http_lines(spark, sf_dir)).withColumn("server", F.col("user_id") % 100)
    mean = F.floor(F.avg("response_ms") + 0.5).cast("string")
    return p.groupBy("server").agg(F.concat(F.count("*"), F.lit(" requests, "), F.count_if(F.col("status") >= 400), F.lit(" errors, avg "), mean, F.lit("ms")).alias("overview"))


@query("summarize_tests", "SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'signup')) || ' passed, ' || count(*) FILTER (event_type = 'error') || ' failed, ' || count(*) FILTER (event_type = 'signup') || ' skipped' AS overview FROM events GROUP BY 1")
def summarize_tests(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return _parsed_tests(spark, sf_dir).groupBy("user_id").agg(F.concat(n("pass"), F.lit(" passed, "), n("fail"), F.lit(" failed, "), n("skip"), F.lit(" skipped")).alias("overview"))


@query("summarize_build", f"""WITH {D.BUILD_LINES}, p AS (SELECT doc_id, regexp_extract(raw, '(TS\\d+)', 1) AS code FROM build_lines), c AS (SELECT doc_id, code, count(*) AS n FROM p GROUP BY 1, 2),
  t AS (SELECT doc_id, string_agg(code || ' x' || n, ', ' ORDER BY n DESC, code) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) <= 3) GROUP BY 1)
  SELECT doc_id, CAST(sum(n) AS BIGINT) || ' errors: ' || any_value(top) AS overview FROM c JOIN t USING (doc_id) GROUP BY 1""")


def summarize_build(spark, sf_dir):
    """The number of errors and the three commonest codes."""
    c = I.build_lines(spark, sf_dir).groupBy("doc_id", F.regexp_extract("raw", r"(TS\d+)", 1).alias("code")).agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "code"))).where("r <= 3")
    g = c.groupBy("doc_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("r", F.concat("code", F.lit(" x"), "n").alias("s")))).alias("x"))
    return g.select("doc_id", F.concat("total", F.lit(" errors: "), F.array_join(F.transform("x", lambda v: v["s"]), ", ")).alias("overview"))


_COUNTS_SQL = ", ".join(f"count(*) FILTER (lvl = '{v}') AS {v}" for v in _LEVELS)


@query("summarize_generic", f"WITH {_SCORES}, c AS (SELECT doc_id, count(*) AS lines, {_COUNTS_SQL} FROM log_lines GROUP BY 1), r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM log_scores), b AS (SELECT doc_id, string_agg(message, chr(10) ORDER BY r) AS entries FROM r JOIN log_lines USING (doc_id, pos) WHERE r <= 5 GROUP BY 1), t AS (SELECT doc_id, {D.rewrite('message', R.TEMPLATE)} AS t, count(*) AS n FROM log_lines GROUP BY 1, 2), m AS (SELECT doc_id, arg_max(t, (n, t)) AS template FROM t GROUP BY 1) SELECT * FROM c JOIN b USING (doc_id) JOIN m USING (doc_id)")
def summarize_generic(spark, sf_dir):
    """Each document's level counts, its five best entries and its commonest template."""
    x = I.log_lines(spark, sf_dir)
    counts = x.groupBy("doc_id").agg(F.count("*").alias("lines"), *[F.count_if(F.col("lvl") == v).alias(v) for v in _LEVELS])
    best = scored(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).where("r <= 5").join(x.select("doc_id", "pos", "message"), ["doc_id", "pos"])
    common = x.groupBy("doc_id", T.log_template(F.col("message")).alias("t")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("t", F.struct("n", "t")).alias("template"))
    return counts.join(joined(best, "doc_id", "r", "message", "entries"), "doc_id").join(common, "doc_id")
