"""Import graphs, resolution, calls, elements, skeletons and chunks of source files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import code, multifile
from ..ship import ship
from . import duck as D
from . import inputs as I
from .registry import query

TS_SQL = """ts_files AS (SELECT p_partkey AS k, 'src/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END AS path, 'src/m' || (p_partkey * 7 % 101) AS absolute, './m' || (p_partkey * 5 % 211) AS relative, p_size FROM part)"""


CONTENT_SQL = "'import { a } from ''' || absolute || '''' || chr(10) || 'import { b } from ''' || relative || '''' || chr(10) || 'export type T = string' || chr(10) || 'export function f_' || k || '(x: number) {' || chr(10) || '  if (x) { return g_' || (k % 13) || '(x); }' || chr(10) || '  return h(b)' || chr(10) || '}' || chr(10) || 'function g_' || (k % 13) || '(x) {' || chr(10) || '  return h(x)' || chr(10) || '}' || chr(10) || 'export class C_' || p_size || ' {' || chr(10) || '  run() {}' || chr(10) || '}' || chr(10)"


def _tokens(c: str) -> str:
    return f"CAST(ceil(length({c}) / 4.0) AS BIGINT)"


def ts_files(spark, sf_dir):
    """(k, path, absolute, relative, content): TypeScript files, each with an import by path, one relative to its folder, functions, a class and a type."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/m"), k, F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.js"))
    absolute, relative = F.concat(F.lit("src/m"), k * 7 % 101), F.concat(F.lit("./m"), k * 5 % 211)
    content = F.concat(F.lit("import { a } from '"), absolute, F.lit("'\nimport { b } from '"), relative, F.lit("'\nexport type T = string\nexport function f_"), k, F.lit("(x: number) {\n  if (x) { return g_"), k % 13, F.lit("(x); }\n  return h(b)\n}\nfunction g_"), k % 13, F.lit("(x) {\n  return h(x)\n}\nexport class C_"), "p_size", F.lit(" {\n  run() {}\n}\n"))
    return I.table(spark, sf_dir, "part").select(k.alias("k"), path.alias("path"), absolute.alias("absolute"), relative.alias("relative"), content.alias("content"))


@query("import_graph", f"WITH {TS_SQL} SELECT DISTINCT a.path AS path, b.path AS dep FROM ts_files a JOIN ts_files b ON a.path <> b.path AND (contains(b.path, a.absolute) OR contains(a.absolute, regexp_replace(b.path, '\\.(ts|js|tsx|jsx)$', '')))")
def import_graph(spark, sf_dir):
    return multifile.contained(ts_files(spark, sf_dir).select("path", F.col("absolute").alias("source")))


_CANDIDATES = ", ".join(f"({i}, '{e}')" for i, e in enumerate(multifile.EXTENSIONS + ["/index" + e for e in multifile.EXTENSIONS]))


@query("resolve_imports", f"WITH {TS_SQL}, c AS (SELECT a.path, a.relative AS source, v.i, regexp_replace(a.path, '/[^/]*$', '') || substring(a.relative, 2) || v.e AS candidate FROM ts_files a, (VALUES {_CANDIDATES}) v(i, e)) SELECT c.path, c.source, arg_min(f.path, c.i) AS resolved FROM c LEFT JOIN ts_files f ON f.path = c.candidate GROUP BY 1, 2")
def resolve_imports(spark, sf_dir):
    x = ts_files(spark, sf_dir)
    return multifile.resolved(x.select("path", F.col("relative").alias("source")), x.select("path"))


@query("related_imports", f"WITH {D.CODE_FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS t FROM code_files), i AS (SELECT path, t AS line, regexp_extract(t, 'import\\s+(\\w+)$', 1) AS name FROM l WHERE regexp_matches(t, '^(import|from)\\s')), u AS (SELECT DISTINCT path, unnest(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM l WHERE NOT regexp_matches(t, '^(import|from)\\s')) SELECT DISTINCT path, name, line FROM i SEMI JOIN u USING (path, name)")
def related_imports(spark, sf_dir):
    """Import lines whose name occurs in the rest of the file."""
    from .documents import code_lines

    lines, brings = code_lines(spark, sf_dir).select("path", "t"), F.col("t").rlike(r"^(import|from)\s")
    named = lines.where(brings).select("path", F.regexp_extract("t", r"import\s+(\w+)\z", 1).alias("name"), F.col("t").alias("line"))
    used = lines.where(~brings).select("path", F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return named.join(used.hint("merge"), ["path", "name"], "left_semi").distinct()  # exploded words are taken for few, and must not be broadcast


# Sources of each language and their elements, read off the source by hand: bucket, name, parent, first and last line, exported, detail, doc.
_PARSED = {
    "parse_ts": (
        "typescript",
        "import D, { a, type b as c } from './m'\nimport 'side'\n/** Adds.\n * twice */\nexport function f{k}(x: number): string {\n  if (x) { return `}` }\n  return g(x)\n}\nexport abstract class C{k} extends B {\n  private n = 1\n  static async run(a: number): Promise<void> {\n    call()\n  }\n}\nexport interface I{k} {\n  a: string\n}\nexport type T<X> = A | B;\nexport enum E{k} { A }\nexport const v = 1\nconst h = async (x) => {\n  return 1\n}\nexport { a, v }\n",
        [
            ("imports", "D", None, 1, 1, False, "./m", ""), ("imports", "a", None, 1, 1, False, "./m", ""), ("imports", "c", None, 1, 1, False, "./m", ""), ("imports", "side", None, 2, 2, False, "side", ""),
            ("functions", "f{k}", None, 5, 8, True, "export function f{k}(x: number): string", "Adds.\ntwice"), ("classes", "C{k}", None, 9, 14, True, "export abstract class C{k} extends B", ""),
            ("functions", "run", "C{k}", 11, 13, False, "static async run(a: number): Promise<void>", ""), ("interfaces", "I{k}", None, 15, 17, True, "export interface I{k}", ""), ("types", "T", None, 18, 18, True, "A | B", ""),
            ("enums", "E{k}", None, 19, 19, True, "export enum E{k}", ""), ("variables", "v", None, 20, 20, True, "1", ""), ("functions", "h", None, 21, 23, False, "const h = async (x) =>", ""),
            ("exports", "a", None, 24, 24, True, "a", ""), ("exports", "v", None, 24, 24, True, "v", ""),
        ],
    ),
    "parse_python": (
        "python",
        "import os\nfrom a.b import c as d\nLIMIT = {k}\n\n\nclass C{k}(Base):\n    \"\"\"Doc.\"\"\"\n\n    def run(self, x: int) -> int:\n        return 1\n\n\nasync def f{k}(x):\n    return x\n\n\ndef _hidden():\n    pass\n",
        [
            ("imports", "os", None, 1, 1, False, "os", ""), ("imports", "d", None, 2, 2, False, "a.b", ""), ("variables", "LIMIT", None, 3, 3, True, "{k}", ""), ("classes", "C{k}", None, 6, 10, True, "class C{k}(Base)", "Doc."),
            ("functions", "run", "C{k}", 9, 10, True, "def run(self, x: int) -> int", ""), ("functions", "f{k}", None, 13, 14, True, "async def f{k}(x)", ""), ("functions", "_hidden", None, 17, 18, False, "def _hidden()", ""),
        ],
    ),
    "parse_go_code": (
        "go",
        'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\n// S is.\ntype S{k} struct {\n\ta int\n}\ntype N interface {\n\t~int | ~string\n}\ntype R{k} interface {\n\tRun()\n}\nfunc (s *S{k}) Run() {\n}\nfunc f{k}(x int) (int, error) {\n\treturn x, nil\n}\nconst Limit = 1\nvar (\n\tA = 2\n\tb = 3\n)\n',
        [
            ("imports", "fmt", None, 3, 3, False, "fmt", ""), ("imports", "x", None, 4, 4, False, "a/b", ""), ("classes", "S{k}", None, 7, 9, True, "type S{k} struct", "S is."), ("types", "N", None, 10, 12, True, "type N interface { ~int | ~string }", ""),
            ("interfaces", "R{k}", None, 13, 15, True, "type R{k} interface", ""), ("functions", "Run", "S{k}", 16, 17, True, "func (s *S{k}) Run()", ""), ("functions", "f{k}", None, 18, 20, False, "func f{k}(x int) (int, error)", ""),
            ("variables", "Limit", None, 21, 21, True, "1", ""), ("variables", "A", None, 23, 23, True, "2", ""), ("variables", "b", None, 24, 24, False, "3", ""),
        ],
    ),
    "parse_rust_code": (
        "rust",
        "use std::fmt;\nuse a::{b, c as d};\n/// Doc.\npub struct S{k} {\n  a: i32,\n}\nimpl fmt::Debug for S{k} {\n  fn fmt(&self) -> i32 {\n    1\n  }\n}\nimpl S{k} {\n  pub fn new() -> S{k} { S{k} { a: 1 } }\n}\npub fn f{k}<'a>(x: &'a i32) -> i32 {\n  let c = '{';\n  *x\n}\npub trait T{k} {\n  type Out;\n}\nconst LIMIT: i32 = 1;\n#[macro_export]\nmacro_rules! mm {\n  () => {}\n}\nmod inner;\n",
        [
            ("imports", "fmt", None, 1, 1, False, "std::fmt", ""), ("imports", "b", None, 2, 2, False, "a::b", ""), ("imports", "d", None, 2, 2, False, "a::c as d", ""), ("classes", "S{k}", None, 4, 6, True, "pub struct S{k}", "Doc."),
            ("interfaces", "impl fmt::Debug for S{k}", None, 7, 11, False, "impl fmt::Debug for S{k}", ""), ("functions", "fmt", "S{k}", 8, 10, False, "fn fmt(&self) -> i32", ""), ("functions", "new", "S{k}", 13, 13, True, "pub fn new() -> S{k}", ""),
            ("functions", "f{k}", None, 15, 18, True, "pub fn f{k}<'a>(x: &'a i32) -> i32", ""), ("interfaces", "T{k}", None, 19, 21, True, "pub trait T{k}", ""), ("types", "Out", "T{k}", 20, 20, False, "type Out", ""), ("variables", "LIMIT", None, 22, 22, False, "1", ""),
            ("functions", "mm", None, 24, 26, True, "macro_rules! mm", ""), ("classes", "inner", None, 27, 27, False, "mod inner", ""),
        ],
    ),
    "parse_php": (
        "php",
        "<?php\nuse App\\M;\nfinal class C{k} {\n    private ?int $n = 1;\n    /** Runs. */\n    public function run($x) {\n    }\n    private function no() {\n    }\n    const LIMIT = 1;\n}\ninterface I{k} {\n    function q();\n}\nenum S: string {\n    case A = 'a';\n}\n",
        [
            ("imports", "M", None, 2, 2, False, "App\\M", ""), ("classes", "C{k}", None, 3, 11, True, "final class C{k}", ""), ("variables", "n", "C{k}", 4, 4, False, "1", ""), ("functions", "run", "C{k}", 6, 7, True, "public function run($x)", "Runs."),
            ("functions", "no", "C{k}", 8, 9, False, "private function no()", ""), ("variables", "LIMIT", "C{k}", 10, 10, True, "1", ""), ("interfaces", "I{k}", None, 12, 14, True, "interface I{k}", ""), ("functions", "q", "I{k}", 13, 13, True, "function q()", ""),
            ("types", "S", None, 15, 17, True, "enum S: string", ""), ("variables", "A", "S", 16, 16, True, "'a'", ""),
        ],
    ),
    "parse_swift": (
        "swift",
        "import Foundation\npublic struct S{k} {\n    let a = 1\n    init() {\n    }\n    public func run(_ x: Int) -> Int {\n        return x\n    }\n}\npublic protocol P{k} {\n    associatedtype X\n}\nextension S{k} {\n}\npublic func f{k}() {\n}\n",
        [
            ("imports", "Foundation", None, 1, 1, False, "Foundation", ""), ("classes", "S{k}", None, 2, 9, True, "public struct S{k}", ""), ("variables", "a", "S{k}", 3, 3, False, "1", ""), ("functions", "init", "S{k}", 4, 5, False, "init()", ""),
            ("functions", "run", "S{k}", 6, 8, True, "public func run(_ x: Int) -> Int", ""), ("interfaces", "P{k}", None, 10, 12, True, "public protocol P{k}", ""), ("types", "X", "P{k}", 11, 11, False, "associatedtype X", ""),
            ("types", "S{k}", None, 13, 14, False, "extension S{k}", ""), ("functions", "f{k}", None, 15, 16, True, "public func f{k}()", ""),
        ],
    ),
}


def elements_sql(rows: list[tuple], source: str, path: str, key: str) -> str:
    """Elements ``rows`` for each row of ``source``; ``{k}`` stands for the key."""
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"replace({D.q(v)}, '{{k}}', CAST({key} AS VARCHAR))"
    one = "SELECT {p} AS path, {0} AS bucket, {1} AS name, {2} AS parent, {3} AS start_line, {4} AS end_line, {5} AS exported, {6} AS detail, {7} AS doc FROM {s}"
    return " UNION ALL ".join(one.format(D.q(r[0]), text(r[1]), text(r[2]), r[3], r[4], r[5], text(r[6]), text(r[7]), p=path, s=source) for r in rows)


def _parser(key: str, language: str, template: str, rows: list[tuple]):
    def run(spark, sf_dir):
        ship(spark)
        content = F.replace(F.lit(template), F.lit("{k}"), F.col("p_partkey").cast("string"))
        return code.parse_code(I.table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("path"), content.alias("content")), language)

    run.__name__ = key
    query(key, elements_sql(rows, "part", "'src/' || p_partkey", "p_partkey"))(run)


for _key, (_language, _template, _rows) in _PARSED.items():
    _parser(_key, _language, _template, _rows)


def parsed_ts(spark, sf_dir):
    ship(spark)
    return code.parse_code(ts_files(spark, sf_dir), "typescript")


@query("pipe_parse", f"WITH {TS_SQL} SELECT path, 2 AS imports, 3 AS functions, 1 AS classes, 1 AS types, 3 AS exports FROM ts_files")
def pipe_parse(spark, sf_dir):
    """The structure of each file as one row of counts."""
    g = parsed_ts(spark, sf_dir).groupBy("path")
    return g.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("imports", "functions", "classes", "types")], F.count_if("exported").alias("exports"))


@query("search_elements", f"WITH {TS_SQL} SELECT path, 'functions' AS bucket, 'f_' || k AS name, 4 AS start_line, 7 AS end_line FROM ts_files WHERE contains('f_' || k, 'f_1')")
def search_elements(spark, sf_dir):
    return parsed_ts(spark, sf_dir).where(F.lower("name").contains("f_1")).select("path", "bucket", "name", "start_line", "end_line")


@query("extract_element", f"WITH {TS_SQL} SELECT path, 'f_' || k AS name, 4 AS start_line, 7 AS end_line, array_to_string(string_split({CONTENT_SQL}, chr(10))[4:7], chr(10)) AS body FROM ts_files")
def extract_element(spark, sf_dir):
    """The lines of each file's exported functions."""
    x = parsed_ts(spark, sf_dir).where("bucket = 'functions' and exported").join(ts_files(spark, sf_dir).select("path", "content"), "path")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return x.select("path", "name", "start_line", "end_line", body.alias("body"))


def calls(bodies):
    """(path, name, called): the distinct names before an opening bracket in a body, but for words of the language and the name itself."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(T.java(r"\b([a-zA-Z_]\w*)\s*\(")), F.lit(1))))
    return bodies.select("path", "name", found.alias("called")).where(~F.col("called").isin(R.NOT_CALLS) & (F.col("called") != F.col("name")))


@query("call_graph", f"WITH {TS_SQL} SELECT path, 'f_' || k AS root, 'f_' || k AS name, 0 AS depth FROM ts_files UNION ALL SELECT path, 'f_' || k, 'g_' || (k % 13), 1 FROM ts_files UNION ALL SELECT path, 'f_' || k, 'h', 1 FROM ts_files")
def call_graph(spark, sf_dir):
    """(path, root, name, depth): functions of the same file reached by calls from each exported function, to a depth of 3."""
    x = parsed_ts(spark, sf_dir).where("bucket = 'functions'").join(ts_files(spark, sf_dir).select("path", "content"), "path")
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    edges = calls(x.select("path", "name", body.alias("body")))
    reached = front = x.where("exported").select("path", F.col("name").alias("root"), "name", F.lit(0).alias("depth"))
    for depth in (1, 2, 3):
        front = front.select("path", "root", "name").join(edges, ["path", "name"]).select("path", "root", F.col("called").alias("name"), F.lit(depth).alias("depth")).distinct()
        reached = reached.unionByName(front)
    return reached.groupBy("path", "root", "name").agg(F.min("depth").alias("depth"))


@query("file_dependencies", f"WITH {TS_SQL}, c AS (SELECT a.path, a.relative AS source, v.i, regexp_replace(a.path, '/[^/]*$', '') || substring(a.relative, 2) || v.e AS candidate FROM ts_files a, (VALUES {_CANDIDATES}) v(i, e)) SELECT c.path, c.source, arg_min(f.path, c.i) AS resolved, 3 AS exports FROM c LEFT JOIN ts_files f ON f.path = c.candidate GROUP BY 1, 2 UNION ALL SELECT path, absolute, NULL, 3 FROM ts_files")
def file_dependencies(spark, sf_dir):
    """Each file's imports, what they resolve to, and the number of its exports."""
    x = ts_files(spark, sf_dir)
    imports = x.select("path", F.explode(F.array("absolute", "relative")).alias("source"))
    exports = parsed_ts(spark, sf_dir).groupBy("path").agg(F.count_if("exported").alias("exports"))
    return multifile.resolved(imports, x.select("path")).join(exports, "path", "left")


_SKELETON = "'import { a } from ''' || absolute || '''' || chr(10) || 'import { b } from ''' || relative || '''' || chr(10) || 'export type T = string' || chr(10) || 'export function f_' || k || '(x: number) { ... }' || chr(10) || 'function g_' || (k % 13) || '(x) { ... }' || chr(10) || 'export class C_' || p_size || ' { ... }'"


@query("skeleton_brace", f"WITH {TS_SQL} SELECT path, {_SKELETON} AS skeleton FROM ts_files")
def skeleton_brace(spark, sf_dir):
    return multifile.skeletons(ts_files(spark, sf_dir), "path")


_MULTIFILE = f"""{TS_SQL}, j AS (SELECT *, k % 40 AS project, count(*) OVER (PARTITION BY k % 40, absolute) >= 2 AS shared_import,
  'import {{ a }} from ''' || absolute || '''' || chr(10) AS head, {CONTENT_SQL} AS content, {_SKELETON} AS skeleton FROM ts_files),
  l AS (SELECT *, CASE WHEN shared_import THEN substring(content, length(head) + 1) ELSE content END AS lean, CASE WHEN shared_import THEN substring(skeleton, length(head) + 1) ELSE skeleton END AS thin FROM j)"""


@query("compress_multifile", f"WITH {_MULTIFILE} SELECT path, shared_import, {_tokens('content')} AS tokens, {_tokens('lean')} AS lean_tokens, {_tokens('thin')} AS skeleton_tokens FROM l")
def compress_multifile(spark, sf_dir):
    """Files without the imports that two or more of a project's files share, and as skeletons; with their tokens before and after."""
    y = lean_files(spark, sf_dir)
    y = y.join(multifile.skeletons(y, "path", "lean"), "path")
    return y.select("path", "shared_import", T.token_count(F.col("content")).alias("tokens"), T.token_count(F.col("lean")).alias("lean_tokens"), T.token_count(F.col("skeleton")).alias("skeleton_tokens"))


def lean_files(spark, sf_dir):
    """(project, path, content, shared_import, lean): ``lean`` lacks the import line that other files of the project have too."""
    x = ts_files(spark, sf_dir).select((F.col("k") % 40).alias("project"), "path", "absolute", "content")
    y = x.withColumn("shared_import", F.count("*").over(Window.partitionBy("project", "absolute")) >= 2)
    gone = F.replace("content", F.concat(F.lit("import { a } from '"), "absolute", F.lit("'\n")), F.lit(""))
    return y.withColumn("lean", F.when(F.col("shared_import"), gone).otherwise(F.col("content")))


# A fold over steps: each takes the next file of the queue, or, once that is empty or the chunk full, the first file without a chunk.
_ONE = "list_filter(fs, lambda f: f.p = a.q[1])[1]"
_SEED = "list_filter(fs, lambda f: NOT list_contains(a.hp, f.p))[1]"
_CHUNKS = f"""{TS_SQL}, x AS (SELECT k // 40 AS project, path, absolute, {_tokens(CONTENT_SQL)} AS t FROM ts_files),
  e AS (SELECT DISTINCT a.project, a.path, b.path AS dep FROM x a JOIN x b ON a.project = b.project AND a.path <> b.path AND (contains(b.path, a.absolute) OR contains(a.absolute, regexp_replace(b.path, '\\.(ts|js|tsx|jsx)$', '')))),
  d AS (SELECT path, list(dep ORDER BY dep) AS ds FROM e GROUP BY 1), g AS (SELECT project, list({{'p': path, 't': t, 'd': coalesce(ds, []::VARCHAR[])}} ORDER BY path) AS fs, count(*) * 2 + sum(coalesce(len(ds), 0)) + 2 AS steps FROM x LEFT JOIN d USING (path) GROUP BY 1),
  s AS (SELECT project, list_reduce(list_transform(range(0, CAST(steps AS BIGINT)), lambda i: {{'q': []::VARCHAR[], 'u': CAST(0 AS BIGINT), 'c': CAST(-1 AS BIGINT), 'hp': []::VARCHAR[], 'hc': []::BIGINT[]}}), lambda a, i:
    CASE WHEN len(a.q) = 0 OR a.u >= 200 THEN CASE WHEN {_SEED} IS NULL THEN a ELSE {{'q': {_SEED}.d, 'u': {_SEED}.t, 'c': a.c + 1, 'hp': list_append(a.hp, {_SEED}.p), 'hc': list_append(a.hc, a.c + 1)}} END
      WHEN {_ONE} IS NULL OR list_contains(a.hp, a.q[1]) OR a.u + {_ONE}.t > 200 THEN {{'q': a.q[2:], 'u': a.u, 'c': a.c, 'hp': a.hp, 'hc': a.hc}}
      ELSE {{'q': list_concat(a.q[2:], {_ONE}.d), 'u': a.u + {_ONE}.t, 'c': a.c, 'hp': list_append(a.hp, a.q[1]), 'hc': list_append(a.hc, a.c)}} END) AS s FROM g)"""


@query("chunk_files", f"WITH {_CHUNKS} SELECT project, unnest(s.hp) AS path, unnest(s.hc) AS chunk FROM s")
def chunk_files(spark, sf_dir):
    """Projects of 40 files; packing is sequential, so a project is one task's work."""
    ship(spark)
    x = ts_files(spark, sf_dir).select(F.floor(F.col("k") / 40).alias("project"), "path", "absolute", T.token_count(F.col("content")).alias("tokens"))
    deps = multifile.contained(x.select("project", "path", F.col("absolute").alias("source")), ("project",)).groupBy("project", "path").agg(F.array_sort(F.collect_list("dep")).alias("deps"))
    y = x.join(deps, ["project", "path"], "left").select("project", "path", "tokens", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
    return y.groupBy("project").applyInPandas(lambda pdf: multifile.chunked(pdf, 200), "project long, path string, chunk long")
