"""Queries over documents, code files, conversations and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import multifile
from . import duck as D
from . import inputs as I
from .logs import joined
from .registry import query


@query("corpus_overview", "SELECT lang, count(*) AS n, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def corpus_overview(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("token_report", "SELECT source, count(*) AS files, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) FILTER (ceil(length(text) / 4.0) >= 1000) AS above FROM documents GROUP BY 1")
def token_report(spark, sf_dir):
    t = T.token_count(F.col("text"))
    return I.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(t).alias("tokens"), F.count_if(t >= 1000).alias("above"))


@query("dup_line_ratio", "SELECT doc_id, round(1 - count(DISTINCT line) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1")
def dup_line_ratio(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = I.table(spark, sf_dir, "documents").select("doc_id", lines.alias("x")).where(F.size("x") > 0)
    return d.select("doc_id", F.round(1 - F.size(F.array_distinct("x")) / F.size("x"), 6).alias("ratio"))


@query("segments", "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS seg, unnest(string_split(text, chr(10))) AS line FROM documents")
def segments(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg", "line")).withColumn("seg", F.col("seg").cast("long"))


@query("context_budget", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(floor(ceil(length(text) / 4.0) / 200000 * 100 + 0.5) AS BIGINT) AS percent, ceil(length(text) / 4.0) > 2000 AS long_prose FROM documents")
def context_budget(spark, sf_dir):
    t = T.token_count(F.col("text"))
    return I.table(spark, sf_dir, "documents").select("doc_id", t.alias("tokens"), T.js_round(t / R.CONTEXT_WINDOW * 100).alias("percent"), (t > 2000).alias("long_prose"))


@query("context_cost", "SELECT doc_id, CAST(ceil(ceil(length(text) / 4.0) * 3.0) AS BIGINT) AS micros FROM documents")
def context_cost(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.ceil(T.token_count(F.col("text")) * R.PRICES["sonnet"][0]).alias("micros"))


@query("is_valid_json", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END) AS valid FROM events")
def is_valid_json(spark, sf_dir):
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END")
    return I.table(spark, sf_dir, "events").select("event_id", valid_json(text).alias("valid"))


def valid_json(text):
    """Whether all of the text is one JSON value: the parser stops after the first value, so it must also stand in an array and in an object."""
    inside = [F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))]
    return F.coalesce(F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull(), F.lit(False))


@query("report_json", "SELECT lang, '{\"lang\":\"' || lang || '\",\"n\":' || count(*) || '}' AS report FROM documents GROUP BY lang")
def report_json(spark, sf_dir):
    g = I.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", F.to_json(F.struct("lang", "n")).alias("report"))


@query("toon_tabular", "SELECT 'langs[' || count(*) || ']{lang,n}:' || chr(10) || string_agg('  ' || lang || ',' || n, chr(10) ORDER BY lang) AS toon FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def toon_tabular(spark, sf_dir):
    g = I.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return toon(g, "langs", ["lang", "n"])


def toon(df, name: str, columns: list[str]):
    """One row ``toon``: a header with count and columns, then a row for each of ``df``, in order of the columns. For reports, which are small."""
    row = F.concat(F.lit("  "), F.concat_ws(",", *[T_escape(F.col(c).cast("string")) for c in columns]))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*columns, row.alias("_row")))).alias("x"))
    return rows.select(F.concat(F.lit(f"{name}["), F.size("x").cast("string"), F.lit("]{" + ",".join(columns) + "}:\n"), F.array_join(F.transform("x", lambda r: r["_row"]), "\n")).alias("toon"))


def T_escape(c):
    return F.when(c.contains(","), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("-")))


@query("read_all", f"WITH {D.CODE_FILES} SELECT p_partkey % 10 AS grp, string_agg('// === ' || path || ' ===' || chr(10) || content, chr(10) ORDER BY path) AS text FROM code_files GROUP BY 1")
def read_all(spark, sf_dir):
    x = I.code_files(spark, sf_dir).withColumn("grp", F.col("p_partkey") % 10).withColumn("body", F.concat(F.lit("// === "), "path", F.lit(" ===\n"), "content"))
    return joined(x, "grp", "path", "body", "text")


_LINES = f"{D.CODE_FILES}, ln AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS t FROM code_files)"


def code_lines(spark, sf_dir):
    x = I.code_files(spark, sf_dir).select("path", F.posexplode(F.split("content", "\n")).alias("k", "t"))
    return x.select("path", (F.col("k") + 1).cast("long").alias("line"), "t")


@query("quick_scan", f"WITH {_LINES}, k AS (SELECT path, line, CASE WHEN regexp_matches(t, '^def\\s+(\\w+)\\s*\\(') THEN 'function' WHEN regexp_matches(t, '^class\\s+(\\w+)') THEN 'class' WHEN regexp_matches(t, '^(?:from\\s+(\\S+)\\s+import|import\\s+(\\S+))') THEN 'import' END AS kind, regexp_extract(t, '^(?:def|class|from|import)\\s+(\\w+)', 1) AS name FROM ln) SELECT path, CAST(line AS BIGINT) AS line, kind, name FROM k WHERE kind IS NOT NULL")
def quick_scan(spark, sf_dir):
    t = F.col("t")
    kind = F.when(t.rlike(r"^(async\s+)?def\s+(\w+)\s*\("), "function").when(t.rlike(r"^class\s+(\w+)"), "class").when(t.rlike(r"^(?:from\s+(\S+)\s+import|import\s+(\S+))"), "import")
    return code_lines(spark, sf_dir).select("path", "line", kind.alias("kind"), F.regexp_extract(t, r"^(?:async\s+)?(?:def|class|from|import)\s+(\w+)", 1).alias("name")).where("kind is not null")


@query("extract_imports", f"WITH {_LINES} SELECT path, coalesce(nullif(regexp_extract(t, '^from\\s+(\\S+)\\s+import', 1), ''), regexp_extract(t, '^import\\s+(\\S+)', 1)) AS source FROM ln WHERE regexp_matches(t, '^(from\\s+\\S+\\s+import|import\\s+\\S+)')")
def extract_imports(spark, sf_dir):
    return imports(code_lines(spark, sf_dir))


def imports(lines):
    t = F.col("t")
    source = F.coalesce(F.nullif(F.regexp_extract(t, r"^from\s+(\S+)\s+import", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^import\s+(\S+)", 1), F.lit("")))
    return lines.select("path", source.alias("source")).where("source is not null")


@query("shared_imports", f"WITH {_LINES} SELECT coalesce(nullif(regexp_extract(t, '^from\\s+(\\S+)\\s+import', 1), ''), regexp_extract(t, '^import\\s+(\\S+)', 1)) AS source, count(DISTINCT path) AS files FROM ln WHERE regexp_matches(t, '^(from\\s+\\S+\\s+import|import\\s+\\S+)') GROUP BY 1 HAVING count(DISTINCT path) >= 2")
def shared_imports(spark, sf_dir):
    return extract_imports(spark, sf_dir).groupBy("source").agg(F.count_distinct("path").alias("files")).where("files >= 2")


@query("shared_types", f"WITH {_LINES} SELECT regexp_extract(t, '^class\\s+(\\w+)', 1) AS name, count(DISTINCT path) AS files FROM ln WHERE regexp_matches(t, '^class\\s+\\w+') GROUP BY 1 HAVING count(DISTINCT path) > 1")
def shared_types(spark, sf_dir):
    return quick_scan(spark, sf_dir).where("kind = 'class'").groupBy("name").agg(F.count_distinct("path").alias("files")).where("files > 1")


@query("extract_types", f"WITH {_LINES} SELECT path, regexp_extract(t, '^class\\s+(\\w+)', 1) AS name FROM ln WHERE regexp_matches(t, '^class\\s+\\w+')")
def extract_types(spark, sf_dir):
    return quick_scan(spark, sf_dir).where("kind = 'class'").select("path", "name")


@query("grep", f"WITH {_LINES} SELECT path, CAST(line AS BIGINT) AS line, strpos(t, 'g_1') AS col, t AS text FROM ln WHERE contains(t, 'g_1')")
def grep(spark, sf_dir):
    t = F.col("t")
    return code_lines(spark, sf_dir).where(t.rlike("g_1")).select("path", "line", F.regexp_instr(t, F.lit("g_1")).cast("long").alias("col"), t.alias("text"))


_KIND = "CASE WHEN regexp_matches(t, '^def\\s+g_1\\b') THEN 'definition' WHEN regexp_matches(t, '^(import|from)\\b.*\\bg_1\\b') THEN 'import' WHEN regexp_matches(t, '\\bg_1\\b') THEN 'usage' END"


@query("references", f"WITH {_LINES} SELECT path, CAST(line AS BIGINT) AS line, {_KIND} AS kind FROM ln WHERE {_KIND} IS NOT NULL")
def references(spark, sf_dir):
    t = F.col("t")
    kind = F.when(t.rlike(T.java(r"^def\s+g_1\b")), "definition").when(t.rlike(T.java(r"^(import|from)\b.*\bg_1\b")), "import").when(t.rlike(T.java(r"\bg_1\b")), "usage")
    return code_lines(spark, sf_dir).select("path", "line", kind.alias("kind")).where("kind is not null")


@query("find_usages", f"WITH {_LINES} SELECT path, CAST(line AS BIGINT) AS line, substr(t, 1, 100) AS context FROM ln WHERE regexp_matches(t, '\\bg_2\\b')")
def find_usages(spark, sf_dir):
    return code_lines(spark, sf_dir).where(F.col("t").rlike(T.java(r"\bg_2\b"))).select("path", "line", F.substring("t", 1, 100).alias("context"))


@query("dead_code", f"WITH {_LINES}, d AS (SELECT path, regexp_extract(t, '^def\\s+(\\w+)', 1) AS name FROM ln WHERE regexp_matches(t, '^def\\s+\\w+')), u AS (SELECT DISTINCT path AS upath, unnest(regexp_extract_all(t, '\\w+')) AS word FROM ln) SELECT path, name FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE word = name AND upath <> path)")
def dead_code(spark, sf_dir):
    defs = quick_scan(spark, sf_dir).where("kind = 'function'").select("path", "name")
    return multifile.unnamed_elsewhere(defs, code_lines(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0))).alias("name")))


@query("search_files", f"WITH {D.CODE_FILES} SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name FROM code_files WHERE regexp_matches(path, '^(.*/)?p2[^/]*\\.py$')")
def search_files(spark, sf_dir):
    return I.code_files(spark, sf_dir).where(F.col("path").rlike(T.glob_regex("**/p2*.py"))).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


@query("file_exists", f"WITH {D.CODE_FILES}, w AS (SELECT 'src/p' || o_orderkey || '.py' AS path FROM orders) SELECT w.path, EXISTS (SELECT 1 FROM code_files c WHERE c.path = w.path) AS found FROM w")
def file_exists(spark, sf_dir):
    wanted = I.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/p"), "o_orderkey", F.lit(".py")).alias("path"))
    listed = I.code_files(spark, sf_dir).select("path", F.lit(True).alias("found"))
    return wanted.join(listed, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


_EDGES = "lined AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS dst FROM lineitem), edges AS (SELECT DISTINCT src, dst FROM lined WHERE src <> dst)"


def edges(spark, sf_dir):
    """Distinct edges from each part to the one on the next line of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return I.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("src <> dst").distinct()


@query("dep_closure", f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst, 1 AS depth FROM edges WHERE src = 1 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst WHERE r.depth < 3) SELECT dst, min(depth) AS depth FROM r GROUP BY 1")
def dep_closure(spark, sf_dir):
    e = edges(spark, sf_dir)
    reached = front = e.where("src = 1").select("dst", F.lit(1).alias("depth"))
    for depth in (2, 3):
        front = front.select(F.col("dst").alias("src")).join(e, "src").select("dst", F.lit(depth).alias("depth")).distinct()
        reached = reached.unionByName(front)
    return reached.groupBy("dst").agg(F.min("depth").alias("depth"))


@query("call_graph_inverse", f"WITH {_EDGES} SELECT dst AS name, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS called_by FROM edges GROUP BY 1")
def call_graph_inverse(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: x.cast("string")), ",").alias("called_by"))


@query("analyze_context", "SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS messages, max(role = 'system' AND length(text) > 2000) AS long_system FROM conversations GROUP BY 1")
def analyze_context(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"), F.count("*").alias("messages"), F.max((F.col("role") == "system") & (F.length("text") > 2000)).alias("long_system"))


@query("similar_pairs", f"WITH {D.LOG_LINES}, p AS (SELECT DISTINCT trim({D.rewrite('lower(message)', R.LOG_CLUSTER)}) AS t FROM log_lines) SELECT a.t AS a, b.t AS b, round(1 - levenshtein(a.t, b.t) / CAST(greatest(length(a.t), length(b.t)) AS DOUBLE), 6) AS similarity FROM p a JOIN p b ON a.t < b.t WHERE 1 - levenshtein(a.t, b.t) / CAST(greatest(length(a.t), length(b.t)) AS DOUBLE) >= 0.7")
def similar_pairs(spark, sf_dir):
    """Distinct normalised messages at an edit similarity of 0.7; there are few of them whatever the number of lines, which a length band keeps apart."""
    p = I.log_lines(spark, sf_dir).select(T.normalize_log_cluster(F.col("message")).alias("t")).distinct().withColumn("n", F.length("t"))
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1 / 0.7)))
    a = p.select(F.col("t").alias("a"), F.col("n").alias("na"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = p.select(F.col("t").alias("b"), F.col("n").alias("nb"), band.alias("band"))
    sim = 1 - F.levenshtein("a", "b") / F.greatest("na", "nb")
    return a.join(b, "band").where("a < b").select("a", "b", F.round(sim, 6).alias("similarity")).where("similarity >= 0.7")


@query("detect_project", f"WITH {D.CODE_FILES} SELECT p_partkey % 10 AS project, max(path LIKE '%.py') AS python, max(path LIKE '%/package.json') AS node, max(path LIKE '%/Cargo.toml') AS rust, max(path LIKE '%/go.mod') AS go FROM code_files GROUP BY 1")
def detect_project(spark, sf_dir):
    path = F.col("path")
    return I.code_files(spark, sf_dir).groupBy((F.col("p_partkey") % 10).alias("project")).agg(F.max(path.endswith(".py")).alias("python"), F.max(path.endswith("/package.json")).alias("node"), F.max(path.endswith("/Cargo.toml")).alias("rust"), F.max(path.endswith("/go.mod")).alias("go"))
