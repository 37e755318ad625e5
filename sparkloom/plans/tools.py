"""Queries of the tools: listings, renderers, readers, dispatching summaries, embeddings, bounded functions, the registry and its middlewares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import code, compress, multifile, ordered, render, tools
from ..ship import ship
from ..sources import files
from . import captured, compressors, detect, structure
from . import duck as D
from . import inputs as I
from .registry import query
from .search import semantic, semantic_sql

# Listings.

_LISTING = f"{D.CODE_FILES}, {structure.TS_SQL}, listing AS (SELECT path FROM code_files UNION ALL SELECT path FROM ts_files)"


def listing(spark, sf_dir):
    return I.code_files(spark, sf_dir).select("path").unionByName(structure.ts_files(spark, sf_dir).select("path"))


@query("find_files", f"WITH {_LISTING}, p AS (SELECT path, CASE WHEN path LIKE '%.tsx' THEN 0 WHEN path LIKE '%.ts' THEN 1 WHEN contains(path, 'p1') THEN 2 END AS k FROM listing) SELECT path FROM p WHERE k IS NOT NULL ORDER BY k, path LIMIT 100")
def find_files(spark, sf_dir):
    """At most 100 files by patterns of endings and parts, as the operator's limit says."""
    return files.find(listing(spark, sf_dir), ["**/*.tsx", "*.ts", "p1*"])


@query("walk_search", f"WITH {_LISTING} SELECT path FROM listing WHERE regexp_matches(path, '^(.*/)?[^/]*\\.(ts|tsx)$') ORDER BY path LIMIT 500")
def walk_search(spark, sf_dir):
    """The search's listing: at most 500 files."""
    return files.listed(listing(spark, sf_dir), "**/*.{ts,tsx}", 500)


@query("walk_cli", f"WITH {_LISTING} SELECT path FROM listing WHERE regexp_matches(path, '^src/[^/]*$') ORDER BY path LIMIT 1000")
def walk_cli(spark, sf_dir):
    """The report's listing: at most 1000 files."""
    return files.listed(listing(spark, sf_dir), "src/*", 1000)


@query("host_glob", f"WITH {_LISTING} SELECT path FROM listing WHERE regexp_matches(path, '^(.*/)?index\\.js$') ORDER BY path LIMIT 100")
def host_glob(spark, sf_dir):
    """The glob that user code may call: at most 100 files."""
    return files.listed(listing(spark, sf_dir), "**/index.js", 100)


@query("files_glob", f"WITH {_LISTING} SELECT path FROM listing WHERE regexp_matches(path, '^src/p.[^/]*\\.py$')")
def files_glob(spark, sf_dir):
    return files.listed(listing(spark, sf_dir), "src/p?*.py")


@query("read_structure", "SELECT CAST(p_partkey % 16 AS VARCHAR) AS part, 2 * count(*) AS imports, count(*) AS functions, count(*) AS classes FROM part GROUP BY 1")
def read_structure(spark, sf_dir):
    """Files read and parsed: the number of elements of each kind."""
    ship(spark)
    read = files.read_files(spark, captured.written(spark, sf_dir), ["**/*.txt"])
    g = code.parse_code(read, "python").groupBy(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"))
    return g.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("imports", "functions", "classes")])


def _project(spark, sf_dir):
    return multifile.Multifile(I.code_files(spark, sf_dir))


@query("multifile_shared", "SELECT 'os' AS source, count(*) AS files FROM part UNION ALL SELECT 'mod' || (p_partkey % 9), count(*) FROM part GROUP BY p_partkey % 9 HAVING count(*) >= 2")
def multifile_shared(spark, sf_dir):
    """Imports that two or more files have."""
    return _project(spark, sf_dir).shared()


@query("multifile_lean", f"WITH {D.CODE_FILES} SELECT path, array_to_string(string_split(content, chr(10))[3:], chr(10)) AS content FROM code_files")
def multifile_lean(spark, sf_dir):
    """Files without the imports that others have too: here, without any."""
    return _project(spark, sf_dir).compress()


# Renderers, over one source for each part.

_SOURCE = structure._PARSED["parse_ts"]


def _elements(spark, sf_dir):
    ship(spark)
    content = F.replace(F.lit(_SOURCE[1]), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return code.parse_code(I.table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("path"), content.alias("content")), _SOURCE[0])


_K = "'src/' || p_partkey AS path"
_SKELETONS = {
    1: "export interface I{k}\ntype T\nexport function f{k}(x: number): string\nconst h = async (x) =>\nexport abstract class C{k} extends B\n  static async run(a: number): Promise<void>\nexport v",
    2: "export interface I{k}\ntype T\nexport function f{k}(x: number): string // Adds.\nconst h = async (x) =>\nexport abstract class C{k} extends B\n  static async run(a: number): Promise<void>\nexport v",
    3: "export interface I{k}\ntype T\n/** Adds.\ntwice */\nexport function f{k}(x: number): string\nconst h = async (x) =>\nexport abstract class C{k} extends B\n  static async run(a: number): Promise<void>\nexport v",
}


def _filled(text: str) -> str:
    return f"replace({D.q(text)}, '{{k}}', CAST(p_partkey AS VARCHAR))"


@query("skeleton_by_depth", " UNION ALL ".join(f"SELECT {_K}, {d} AS depth, {_filled(t)} AS skeleton FROM part" for d, t in _SKELETONS.items()))
def skeleton_by_depth(spark, sf_dir):
    """Signatures, with the first lines of comments, and with whole comments."""
    out = None
    for depth in _SKELETONS:
        part = render.skeletons(_elements(spark, sf_dir), depth).withColumn("depth", F.lit(depth))
        out = part if out is None else out.unionByName(part)
    return out


_OUTLINE = "IMPORTS: D, a, c +1\nTYPES: I{k}, T\nFUNCTIONS: f{k} (5-8), h (21-23)\nCLASSES: C{k} (9-14)\nEXPORTS: v"


@query("format_outline", f"SELECT {_K}, {_filled(_OUTLINE)} AS outline FROM part")
def format_outline(spark, sf_dir):
    return render.outlines(_elements(spark, sf_dir))


@query("format_search", f"SELECT {_K}, {_filled('Matches: 1' + chr(10) + 'functions C{k}.run (11-13)')} AS results FROM part")
def format_search(spark, sf_dir):
    """Elements whose name, signature or comment tells of promises."""
    return render.found(_elements(spark, sf_dir), "PROMISE")


_READ = f"""WITH {structure.TS_SQL}, c AS (SELECT path, k, p_size, {structure.CONTENT_SQL} AS content FROM ts_files)
  SELECT path, 'lines' AS mode, array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS text FROM c UNION ALL SELECT path, 'target', array_to_string(string_split(content, chr(10))[4:7], chr(10)) FROM c
  UNION ALL SELECT path, 'query', 'Matches: 1' || chr(10) || 'functions C_' || p_size || '.run (12-12)' FROM c
  UNION ALL SELECT path, 'structure', 'IMPORTS: a, b' || chr(10) || 'TYPES: T' || chr(10) || 'FUNCTIONS: f_' || k || ' (4-7), g_' || (k % 13) || ' (8-10)' || chr(10) || 'CLASSES: C_' || p_size || ' (11-13)' FROM c
  UNION ALL SELECT path, 'skeleton', 'type T' || chr(10) || 'export function f_' || k || '(x: number)' || chr(10) || 'function g_' || (k % 13) || '(x)' || chr(10) || 'export class C_' || p_size || chr(10) || '  run()' FROM c"""


@query("smart_file_read", _READ)
def smart_file_read(spark, sf_dir):
    """Five ways to read a part of a file: some lines, one element, elements that fit a query, an outline, a skeleton."""
    x, e = structure.ts_files(spark, sf_dir).select("path", "content"), structure.parsed_ts(spark, sf_dir)
    cut = lambda a, z: F.array_join(F.slice(F.split("content", "\n"), a, z - a + 1), "\n")
    target = e.where("bucket = 'functions' and exported").join(x, "path")
    row = lambda df, mode, text: df.select("path", F.lit(mode).alias("mode"), text.alias("text"))
    out = row(x, "lines", cut(2, 3)).unionByName(row(target, "target", cut(F.col("start_line"), F.col("end_line"))))
    out = out.unionByName(row(render.found(e, "run"), "query", F.col("results"))).unionByName(row(render.outlines(e), "structure", F.col("outline")))
    return out.unionByName(row(render.skeletons(e), "skeleton", F.col("skeleton")))


# Values and schemas.


@query("toon_fields", "SELECT o_orderkey, concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'F' END, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CASE WHEN length(o_orderpriority) > 6 THEN substring(o_orderpriority, 1, 3) || '...' ELSE o_orderpriority END END, '[2]', '{...}') AS toon FROM orders")
def toon_fields(spark, sf_dir):
    """A value of each kind in few characters."""
    x = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 2 == 0).alias("even"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), F.array("o_orderkey", "o_custkey").alias("keys"), F.struct("o_custkey").alias("more"))
    return x.select("o_orderkey", F.concat_ws(" ", *[render.compact(F.col(c), x.schema[c].dataType, 6) for c in x.columns]).alias("toon"))


@query("toon_result_tabular", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
  SELECT o_custkey, 'orders[' || any_value(n) || ']{o_orderkey,o_orderstatus,o_orderpriority,even}:' || chr(10) || string_agg('  ' || o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',' || CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'F' END, chr(10) ORDER BY r) || CASE WHEN any_value(n) > 20 THEN chr(10) || '  ... +' || (any_value(n) - 20) || ' more' ELSE '' END AS toon FROM o WHERE r <= 20 GROUP BY 1""")


def toon_result_tabular(spark, sf_dir):
    """Each customer's orders as a table of four columns and at most 20 rows, as the operator's limits say."""
    x = I.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 2 == 0).alias("even"))
    return render.tabular(x, "o_custkey", "o_orderkey", "orders")


_SCHEMA = '{"type":"object","properties":{"name":{"type":"string"},"size":{"type":"integer"},"kind":{"enum":[%s]},"tags":{"type":"array"},"more":{"type":"object","properties":{"x":{"type":"string"},"y":{"type":"string"}}},"any":{}},"required":[%s]}'


@query("schema_signatures", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'name size?:num kind?:a|b|c|... tags?:arr more?:{x,y} any?:any' ELSE 'name size:num kind?:a|b tags?:arr more?:{x,y} any?:any' END AS signature FROM part")
def schema_signatures(spark, sf_dir):
    """JSON Schemas in a compact notation; null for other texts."""
    many, few = _SCHEMA % ('"a","b","c","d","e"', '"name"'), _SCHEMA % ('"a","b"', '"name","size"')
    text = F.when(F.col("p_size") % 3 == 0, "{}").when(F.col("p_size") % 3 == 1, many).otherwise(few)
    return I.table(spark, sf_dir, "part").select("p_partkey", render.json_signature(text).alias("signature"))


@query("pattern_ids", f"WITH {D.LOG_LINES}, p AS (SELECT {D.rewrite('message', R.TEMPLATE)} AS template, count(*) AS n FROM log_lines GROUP BY 1) SELECT 'P' || substring(md5(template), 1, 12) AS id, template, n FROM p")
def pattern_ids(spark, sf_dir):
    """Templates with an id that depends on nothing but their text."""
    p = I.log_lines(spark, sf_dir).groupBy(T.log_template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))
    return p.select(F.concat(F.lit("P"), F.substring(F.md5("template"), 1, 12)).alias("id"), "template", "n")


@query("token_info", f"SELECT doc_id, {D.tokens('text')} AS tokens, text IS NOT NULL AS approximate FROM documents")
def token_info(spark, sf_dir):
    """Token counts and whether they are estimates: they always are, but for null."""
    t = T.token_count(F.col("text"))
    return I.table(spark, sf_dir, "documents").select("doc_id", t.alias("tokens"), t.isNotNull().alias("approximate"))


@query("cli_language", f"WITH {_LISTING}, e AS (SELECT regexp_extract(path, '(\\.[^./]*)$', 1) AS e FROM listing) SELECT CASE e WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'typescript' END AS language, count(*) AS files FROM e GROUP BY 1")
def cli_language(spark, sf_dir):
    """Files of each language, by their endings."""
    return listing(spark, sf_dir).groupBy(T.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


_ABOUT = ", ".join(f"({', '.join(map(D.q, (k, *v)))})" for k, v in R.CONTENT_TYPES.items())


@query("content_advice", f"WITH {compressors.TYPED_SQL}, a AS (SELECT * FROM (VALUES {_ABOUT}) t(content_type, description, compressor, reduction)) SELECT id, a.* FROM typed JOIN a ON a.content_type = typed.kind")
def content_advice(spark, sf_dir):
    """What each text is, the compressor for it and the reduction to expect."""
    x = detect.texts(spark, sf_dir).select("id", compressors.content_type(F.col("c")).alias("content_type"))
    about = spark.createDataFrame([(k, *v) for k, v in R.CONTENT_TYPES.items()], "content_type string, description string, compressor string, reduction string")
    return x.join(F.broadcast(about), "content_type")  # five rows


@query("sanitize_errors", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Unknown error' WHEN 'view' THEN 'no file <workdir>/a.ts' WHEN 'error' THEN 'failed at <home>/x: ' || event_id ELSE 'bad <home>\\app' END AS message FROM events")
def sanitize_errors(spark, sf_dir):
    """Errors without their stacks and the folders of their machine."""
    kind = F.col("event_type")
    raw = F.when(kind == "click", "").when(kind == "view", "no file /srv/work/a.ts").when(kind == "error", F.concat(F.lit("failed at /home/ann/x: "), "event_id", F.lit("\n    at f (g.js:1:2)"))).otherwise(r"bad C:\Users\ann\app")
    return I.table(spark, sf_dir, "events").select("event_id", tools.sanitize_error(raw, "/srv/work").alias("message"))


# Embeddings without a model.

_DIMENSION = 16
_WORDS = f"w AS (SELECT doc_id, unnest({D.TOKENS.format(c='text')}) AS w FROM documents), h AS (SELECT doc_id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % {_DIMENSION} AS place, CASE WHEN CAST('0x' || substring(md5(w), 9, 1) AS BIGINT) < 8 THEN 1.0 ELSE -1.0 END AS s FROM w), v AS (SELECT doc_id, place, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1)"


@query("embed_texts", f"WITH {_WORDS}, p AS (SELECT doc_id, unnest(range(0, {_DIMENSION})) AS place FROM documents) SELECT p.doc_id, CAST(p.place AS INTEGER) AS place, round(CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END, 6) AS value FROM p LEFT JOIN v ON v.doc_id = p.doc_id AND v.place = p.place LEFT JOIN n ON n.doc_id = p.doc_id")
def embed_texts(spark, sf_dir):
    """Unit vectors of texts by hashed words; a model takes their place through ``encode_texts``."""
    from ..sources.tables import spread

    docs = tools.hashed_vectors(spread(I.table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _DIMENSION)
    return docs.select("doc_id", F.posexplode("vector").alias("place", "value")).withColumn("value", F.round("value", 6))


# Bounded functions.


def _user_code(x):
    if x == 0:
        while True:
            pass
    if x % 7 == 0:
        raise ValueError(f"bad {x} in /home/ann/code")
    return "x" * 100 if x % 50 == 1 else x * 2


@query("code_execute", "SELECT event_id, CASE WHEN event_id = 0 OR event_id % 7 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '\"' || repeat('x', 39) ELSE CAST(event_id * 2 AS VARCHAR) END AS value, CASE WHEN event_id = 0 THEN 'took longer than 0.3 s' WHEN event_id % 7 = 0 THEN 'bad ' || event_id || ' in <home>/code' END AS error, CASE WHEN event_id = 0 OR event_id % 7 = 0 THEN 0 WHEN event_id % 50 = 1 THEN 26 ELSE CAST(ceil(length(CAST(event_id * 2 AS VARCHAR)) / 4.0) AS BIGINT) END AS tokens FROM events")
def code_execute(spark, sf_dir):
    """A function of the user on each event, bounded in time and in the length of its result; rows that fail tell why."""
    run = tools.bounded(spark, _user_code, seconds=0.3, most_tokens=10)
    return I.table(spark, sf_dir, "events").select("event_id", run("event_id").alias("r")).select("event_id", "r.value", "r.error", "r.tokens")


# The registry.

CATALOG = [
    ("auto_optimize", "optimize", "detect the kind of a text and optimize it"),
    ("smart_file_read", "code", "read lines, elements or an outline of a source file"),
    ("code_execute", "pipeline", "run a bounded function of the user"),
    ("session_stats", "analyze", "tokens in, out and saved for each tool"),
    ("compress_context", "compress", "compress a text by its type"),
    ("semantic_compress", "compress", "keep the most important lines of a text"),
    ("diff_compress", "compress", "compress a diff to its changed lines"),
    ("conversation_compress", "compress", "compress the older messages of a conversation"),
    ("conversation_memory", "compress", "remember and restore conversations"),
    ("multifile_compress", "compress", "compress the files of a project together"),
    ("analyze_context", "analyze", "find what fills a context"),
    ("analyze_build_output", "logs", "group errors in the output of a build"),
    ("context_budget", "analyze", "tokens and cost of a text in a context"),
    ("detect_retry_loop", "analyze", "find commands that are run again and again"),
    ("summarize_logs", "logs", "summarize logs of servers, tests and builds"),
    ("deduplicate_errors", "logs", "group errors of one shape"),
    ("code_skeleton", "code", "signatures of a source file"),
    ("smart_cache", "pipeline", "store and look up results"),
    ("smart_pipeline", "pipeline", "chain the steps for a text of its type"),
    ("optimization_tips", "analyze", "advice on saving tokens"),
    ("set_output_config", "pipeline", "verbosity and format of results"),
]


def _by_lines(f):
    return lambda df, **options: f(compress.lines_of(df, "id", "c"), "id", **options)


def registry(chain: tools.Chain | None = None) -> tools.Registry:
    """The catalogued tools that take texts (id, c); others raise, as they have queries of their own."""
    runs = {"compress_context": lambda df: compressors.auto(df), "diff_compress": _by_lines(compress.hunks), "deduplicate_errors": _by_lines(compress.error_groups), "summarize_logs": _by_lines(compress.logs), "context_budget": lambda df: df.select("id", T.token_count(F.col("c")).alias("tokens")), "smart_pipeline": lambda df: compressors.piped(compressors.chain_type(df))}

    def missing(name):
        def run(df, **options):
            raise NotImplementedError(f"{name} takes no texts")

        return run

    out = tools.Registry(chain)
    for name, category, description in CATALOG:
        out.add(tools.Tool(name, category, description, runs.get(name, missing(name))))
    return out


_TOOLS = "tools AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(D.q, t))})" for t in CATALOG) + ") t(name, category, description))"


@query("browse_tools", f"WITH {_TOOLS} SELECT category, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM tools GROUP BY 1")
def browse_tools(spark, sf_dir):
    return registry().table(spark).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def _discover_sql() -> str:
    from .search import bm25_sql

    return f"WITH {_TOOLS}, entries AS (SELECT name, name || ' ' || description AS text FROM tools), {bm25_sql('entries', 'name', 'compress text context')} SELECT name, score FROM bm WHERE score > 0"


@query("discover_tools", _discover_sql())
def discover_tools(spark, sf_dir):
    """Tools that fit a question, by lexical search."""
    from ..operators import retrieval

    entries = registry().table(spark).select("name", F.concat_ws(" ", "name", "description").alias("text"))
    return retrieval.bm25(entries, "name", "text", "compress text context").select("name", "score")


@query("run_tool", f"WITH {detect.TEXTS_SQL} SELECT id, {D.tokens('c')} AS tokens FROM texts")
def run_tool(spark, sf_dir):
    return registry().execute("context_budget", detect.texts(spark, sf_dir)).df


@query("lazy_savings", f"SELECT 150 AS lazy_tokens, {len(CATALOG)} * 100 AS full_tokens, CAST(floor((1 - 150 / ({len(CATALOG)} * 100.0)) * 100 + 0.5) AS BIGINT) AS savings_percent")
def lazy_savings(spark, sf_dir):
    """What two meta tools cost against the definitions of all tools, at 100 tokens each."""
    x = registry().table(spark).agg(F.lit(150).alias("lazy_tokens"), (F.count("*") * 100).alias("full_tokens"))
    return x.select("lazy_tokens", "full_tokens", T.js_round((1 - F.col("lazy_tokens") / F.col("full_tokens")) * 100).alias("savings_percent"))


@query("output_limits", "SELECT * FROM (VALUES ('minimal', 40, 5, false, 50), ('normal', 80, 15, true, 100), ('detailed', 200, 50, true, 200)) t(verbosity, description_chars, items, details, value_chars)")
def output_limits(spark, sf_dir):
    return spark.createDataFrame([(k, *v) for k, v in render.VERBOSITY.items()], "verbosity string, description_chars int, items int, details boolean, value_chars int")


TIPS = [("read", "Ask for lines, an element or an outline instead of a whole file."), ("build", "Group a build's errors before reading them."), ("logs", "Summarize logs by their shapes; read single lines only where a shape is new."), ("diff", "Read changed lines with a line of context."), ("retry", "Stop when one command fails three times in the same way."), ("context", "Compress the older messages of a long conversation.")]


@query("optimization_tips", "SELECT * FROM (VALUES " + ", ".join(f"({D.q(a)}, {D.q(b)})" for a, b in TIPS) + ") t(topic, tip)")
def optimization_tips(spark, sf_dir):
    return spark.createDataFrame(TIPS, "topic string, tip string")


class _Log(tools.Middleware):
    def __init__(self, name, priority, log, fails=False, skips=False):
        self.name, self.priority, self.log, self.fails, self.skips = name, priority, log, fails, skips

    def before(self, call):
        self.log.append(f"{self.name} before")
        if self.fails:
            raise RuntimeError("broken hook")
        return None if self.skips else call

    def after(self, call, outcome):
        self.log.append(f"{self.name} after")
        return outcome

    def on_error(self, call, error):
        self.log.append(f"{self.name} error")


@query("middleware_log", "SELECT * FROM (VALUES ('run', 'a before,b before,c before,c after,b after,a after'), ('skip', 's before'), ('fail', 'a before,c before,a error,c error'), ('unknown', '')) t(run, hooks)")
def middleware_log(spark, sf_dir):
    """The order in which hooks run: by priority before, in reverse after; a hook that fails is passed over, one that returns nothing skips the tool."""
    texts = spark.createDataFrame([("1", "text")], "id string, c string")
    out = []
    for run, tool, made in (("run", "context_budget", [("c", 3, False, False), ("a", 1, False, False), ("b", 2, True, False)]), ("skip", "context_budget", [("s", 1, False, True), ("a", 2, False, False)]), ("fail", "session_stats", [("a", 1, False, False), ("c", 2, False, False)]), ("unknown", "none", [("a", 1, False, False)])):
        log: list[str] = []
        registry(tools.Chain(*[_Log(n, p, log, f, s) for n, p, f, s in made])).execute(tool, texts)
        out.append((run, ",".join(log)))
    return spark.createDataFrame(out, "run string, hooks string")


# Façades.


@query("compress_context", compressors.AUTO_HASH_SQL)
def compress_context(spark, sf_dir):
    """Texts of all types but configuration, by name through the registry."""
    made = registry().execute("compress_context", detect.texts(spark, sf_dir)).df.where("content_type <> 'config'")
    return made.select("id", "content_type", F.md5("compressed").alias("hash"))


@query("semantic_compress", semantic_sql("0.3"))
def semantic_compress(spark, sf_dir):
    """Each document cut to three tenths of its tokens."""
    return semantic(spark, sf_dir, 0.3)


@query("diff_compress", f"WITH {D.DIFF_LINES}, s AS (SELECT doc_id, 'summary' AS strategy, count(*) FILTER (raw LIKE '+%') || ' additions, ' || count(*) FILTER (raw LIKE '-%') || ' deletions' AS compressed FROM diff_lines GROUP BY 1), c AS (SELECT *, max(CASE WHEN regexp_matches(raw, '^[+-]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM diff_lines) SELECT * FROM s UNION ALL SELECT doc_id, 'hunks-only', string_agg(raw, chr(10) ORDER BY pos) FROM c WHERE near = 1 OR regexp_matches(raw, '^(diff|@@)') GROUP BY 1")
def diff_compress(spark, sf_dir):
    """Diffs by two strategies; the third has a query of its own."""
    x = I.diff_lines(spark, sf_dir)
    plus, minus = (F.count_if(F.col("raw").startswith(p)) for p in "+-")
    summary = x.groupBy("doc_id").agg(F.concat(plus, F.lit(" additions, "), minus, F.lit(" deletions")).alias("compressed")).withColumn("strategy", F.lit("summary"))
    return summary.unionByName(compress.hunks(x, "doc_id").withColumn("strategy", F.lit("hunks-only")))


@query("analyze_build_output", f"WITH o AS ({detect._ANALYZED}) SELECT doc_id, tool, CAST(sum(n) AS BIGINT) || ' errors in ' || count(*) || ' groups: ' || string_agg(signature || ' x' || n, '; ' ORDER BY n DESC, signature) AS summary FROM o GROUP BY 1, 2")
def analyze_build_output(spark, sf_dir):
    """A line for each output: its errors by signature, the commonest first."""
    g = detect.analyze_build(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "signature", "n"))), lambda v: F.concat(v["signature"], F.lit(" x"), v["n"]))
    return g.groupBy("doc_id", "tool").agg(F.concat(F.sum("n"), F.lit(" errors in "), F.count("*"), F.lit(" groups: "), F.array_join(listed, "; ")).alias("summary"))


_SUMMARIZED = f"""{detect.TEXTS_SQL}, k AS (SELECT id, c, {detect.SUMMARIZER_SQL} AS summarizer FROM (SELECT id, c, string_split(c, chr(10))[:100] AS ls FROM texts)),
  l AS (SELECT id, summarizer, unnest(string_split(c, chr(10))) AS raw FROM k), n AS (SELECT * FROM l WHERE trim(raw) <> ''),
  s AS (SELECT id, count(*) || ' requests, ' || count(*) FILTER (CAST(regexp_extract(raw, {D.q(R.HTTP)}, 3) AS INTEGER) >= 400) || ' errors' AS summary FROM n WHERE summarizer = 'server' AND regexp_matches(raw, {D.q(R.HTTP)}) GROUP BY 1),
  g AS (SELECT id, count(*) || ' lines, ' || count(*) FILTER (lvl = 'error') || ' errors, ' || count(*) FILTER (lvl = 'warning') || ' warnings' AS summary FROM (SELECT id, {D.level('raw')} AS lvl FROM n WHERE summarizer <> 'server') GROUP BY 1)"""


@query("summarize_logs", f"WITH {_SUMMARIZED} SELECT id, summarizer, summary FROM (SELECT * FROM s UNION ALL SELECT * FROM g) JOIN k USING (id)")
def summarize_logs(spark, sf_dir):
    """Each text by the summarizer for it: requests and errors of servers, lines by level of others. Texts of blank lines only have no row."""
    # One reading of the texts: lines are counted by both ways, and each text's row tells which counts.
    x = detect.texts(spark, sf_dir).withColumn("summarizer", detect.summarizer_of("c"))
    lines = x.select("id", "summarizer", F.posexplode(F.split("c", "\n", -1)).alias("pos", "raw"))
    full, server, http = F.trim("raw") != "", F.col("summarizer") == "server", T.java(R.HTTP)
    lines = lines.withColumn("status", F.when(full & server & F.col("raw").rlike(http), F.regexp_extract("raw", http, 3).cast("int"))).withColumn("lvl", F.when(full & ~server, T.log_level(F.col("raw"))))
    g = lines.groupBy("id").agg(
        F.collect_list(F.when(F.col("pos") == 0, F.col("summarizer"))).alias("summarizers"),
        F.count("status").alias("requests"), F.count_if(F.col("status") >= 400).alias("failed"), F.count("lvl").alias("lines"), F.count_if(F.col("lvl") == "error").alias("errors"), F.count_if(F.col("lvl") == "warning").alias("warnings"),
    )
    of_server = F.when(F.col("requests") > 0, F.concat("requests", F.lit(" requests, "), "failed", F.lit(" errors")))
    other = F.when(F.col("lines") > 0, F.concat("lines", F.lit(" lines, "), "errors", F.lit(" errors, "), "warnings", F.lit(" warnings")))
    told = g.select("id", "summarizers", F.explode(F.filter(F.array(of_server, other), lambda v: v.isNotNull())).alias("summary"))
    return told.select("id", F.explode("summarizers").alias("summarizer"), "summary")


@query("deduplicate_errors", f"WITH {D.BUILD_LINES}, g AS (SELECT doc_id AS id, trim({D.rewrite('raw', R.NORMALIZE_ERROR)}) AS norm, min(pos) AS p, arg_min(raw, pos) AS sample, count(*) AS n FROM build_lines GROUP BY 1, 2) SELECT id, md5(CAST(sum(n) AS BIGINT) || ' lines -> ' || count(*) || ' unique patterns (' || CAST(sum(n) - count(*) AS BIGINT) || ' duplicates removed)' || chr(10) || chr(10) || string_agg(sample || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END, chr(10) ORDER BY n DESC, p)) AS hash FROM g GROUP BY 1")
def deduplicate_errors(spark, sf_dir):
    x = I.build_lines(spark, sf_dir).select(F.col("doc_id").alias("id"), "pos", "raw")
    return compress.error_groups(x, "id").select("id", F.md5("compressed").alias("hash"))


@query("code_skeleton", f"SELECT {_K}, {_filled(_SKELETONS[2])} AS skeleton FROM part")
def code_skeleton(spark, sf_dir):
    return render.skeletons(_elements(spark, sf_dir), 2)


@query("batch_score", f"WITH {D.LOG_LINES}, s AS (SELECT event_id, doc_id, pos, CASE lvl WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.1 END AS score FROM log_lines) SELECT event_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s")
def batch_score(spark, sf_dir):
    """Entries with a score by level and their rank in their document; ties by place."""
    from pyspark.sql import Window

    x = I.log_lines(spark, sf_dir).withColumn("score", T.level_score(F.col("lvl")))
    return x.select("event_id", "score", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")).cast("long").alias("rank"))


@query("budget_by_score", f"WITH {D.LOG_LINES}, t AS (SELECT doc_id, pos, {D.tokens('raw')} AS c, CASE lvl WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.1 END AS s FROM log_lines), g AS (SELECT doc_id, list({{'p': pos, 'c': c}} ORDER BY s DESC, pos) AS xs FROM t GROUP BY 1) SELECT doc_id, list_sort({D.greedy('xs', '200')}) AS kept FROM g")
def budget_by_score(spark, sf_dir):
    """The lines of a document that fit 200 tokens, by level."""
    x = I.log_lines(spark, sf_dir).withColumn("c", T.token_count(F.col("raw")))
    return ordered.greedy_budget(x, "doc_id", "pos", T.level_score(F.col("lvl")), F.col("c"), F.lit(200))


# Reductions: tokens before and after, by kind of text.

_BEFORE_AFTER = f"""{detect.TEXTS_SQL}, typed AS (SELECT id, c, regexp_extract(id, '^[a-z]+') AS kind FROM texts WHERE NOT id LIKE 'doc%'), l1 AS (SELECT id, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS raw FROM typed WHERE kind IN ('log', 'http')), {compressors.logs_sql('l1', 'm1')},
  l2 AS (SELECT id, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS raw FROM typed WHERE kind = 'build'), {compressors.errors_sql('l2', 'm2')}, l3 AS (SELECT id, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS raw FROM typed WHERE kind = 'diff'), {compressors.hunks_sql('l3', 'm3')},
  made AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


@query("reduction_report", f"WITH {_BEFORE_AFTER}, t AS (SELECT kind, {D.tokens('c')} AS a, {D.tokens('compressed')} AS b FROM made JOIN typed USING (id)) SELECT kind, CAST(sum(a) AS BIGINT) AS tokens, CAST(sum(b) AS BIGINT) AS compressed_tokens, CAST(floor((1 - sum(b) / CAST(sum(a) AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS percent FROM t GROUP BY 1")
def reduction_report(spark, sf_dir):
    """Tokens of logs, requests, build output and diffs before and after compression."""
    x = detect.texts(spark, sf_dir).where("id not like 'doc%'").withColumn("kind", F.regexp_extract("id", "^[a-z]+", 0))
    logs = _by_lines(compress.logs)
    made = compressors.by_type(x, "kind", {"log": logs, "http": logs, "build": _by_lines(compress.error_groups), "diff": _by_lines(compress.hunks)}).join(x.select("id", "c"), "id")
    g = made.groupBy("kind").agg(F.sum(T.token_count(F.col("c"))).alias("tokens"), F.sum(T.token_count(F.col("compressed"))).alias("compressed_tokens"))
    return g.withColumn("percent", T.js_round((1 - F.col("compressed_tokens") / F.col("tokens")) * 100))
