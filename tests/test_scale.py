"""Plans and results that only larger tables would tell apart."""

import duckdb
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import rules
from sparkloom.functions import text as T
from sparkloom.operators import code, compress, fluent, multifile, render
from sparkloom.operators.fluent import Pipeline
from sparkloom.plans import compressors, detect
from sparkloom.ship import ship
from sparkloom.sources import files

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dead_code_never_broadcasts_words(spark):
    assert "Broadcast" not in plan(catalog.queries()["dead_code"](spark, DATA))
    rows = [("a", "f"), ("a", "g"), ("b", "g"), ("c", "h"), (None, "k")]
    names, words = spark.createDataFrame(rows, "path string, name string"), spark.createDataFrame([("a", "f"), ("b", "h"), ("b", "g"), ("a", "g"), (None, "f")], "path string, name string")
    assert sorted(map(str, (r.name for r in multifile.unnamed_elsewhere(names, words).collect()))) == ["f", "k"]


def test_preset_dead_code_makes_no_pairs_of_files(spark):
    ship(spark)
    files = spark.range(60).select(F.col("id").alias("pos"), F.concat(F.lit("p"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("class C:\n    pass\ndef f_"), "id", F.lit("():\n    pass\n")).alias("content"))
    got = fluent.PRESETS["dead_code"](Pipeline.of(files))
    assert "Broadcast" not in plan(got) and "Inner" not in plan(got)  # files that share a word are not joined with each other
    assert sorted(r.name for r in got.collect()) == sorted(f"f_{k}" for k in range(60))


def test_related_imports_never_broadcast_words(spark):
    assert "Broadcast" not in plan(catalog.queries()["related_imports"](spark, DATA))


def test_compact_numbers_are_whole(spark):
    x = spark.sql("select 123456789L as n, 'abcdefghi' as t, date'2020-01-02' as d, 1234567.5D as f")
    assert [x.select(render.compact(F.col(c), x.schema[c].dataType, 6).alias("v")).first().v for c in x.columns] == ["123456789", "abc...", "2020-01-02", "1234567.5"]


def test_files_beyond_a_megabyte_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 1_500_000)
    (tmp_path / "b.txt").write_text("y")
    read = {r.path: (r.content and len(r.content), r.error) for r in files.read_files(spark, str(tmp_path), ["*.txt"]).collect()}
    assert read == {"a.txt": (1_500_000, None), "b.txt": (1, None)}
    read = {r.path: (r.content, r.error) for r in files.read_files(spark, str(tmp_path), ["*.txt"], most=10).collect()}
    assert read == {"a.txt": (None, "too large: 1500000"), "b.txt": ("y", None)}


def test_long_python_files_in_pieces_have_the_elements_of_the_whole(monkeypatch):
    one = '@wrap\ndef f(x):\n    """Doc.\n\nclass no:\n"""\n    return x\n\n\nclass C(B):\n    def run(self): pass\n\n\nimport os\nLIMIT = (\nimported\n)\r\nfrom a import b as c\n'
    for text in (one * 40, one * 40 + "def broken(:\n", one * 20 + "x = '''\ndef no(): pass\nimport no\n'''\n" + one * 20):
        whole = code.elements(text, "python")
        monkeypatch.setattr(code, "PIECE_CHARS", 100)
        assert len(code._pieces(text)) > 30 and "".join(p for _, p in code._pieces(text)) == text
        assert code.elements(text, "python") == whole and bool(whole) == ("broken" not in text)
        monkeypatch.undo()


def test_pairs_of_imports_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(multifile, "PART_FILES", 3)
    rows = [(f"src/m{k}.ts", s) for k in range(30) for s in (f"src/m{k % 2}", f"m{k % 3}.")] + [("src/m1.ts", None)]
    df = multifile.contained(spark.createDataFrame(rows, "path string, source string"))
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted({(p, q) for p, s in rows if s for q, _ in rows if p != q and (s in q or q.removesuffix(".ts") in s)})
    assert plan(df).index("Join") < plan(df).index("Aggregate")  # no distinct over the pairs


def test_what_imports_mean_is_joined_as_lists(spark, monkeypatch):
    monkeypatch.setattr(multifile, "PART_FILES", 4)
    monkeypatch.setattr(multifile, "PART_DEPS", 3)
    rows = [(f"src/m{k}.ts", f"src/m{k % 3}") for k in range(60)]
    df = multifile.contained(spark.createDataFrame(rows, "path string, source string"))
    assert sorted(tuple(r) for r in df.collect()) == sorted((p, q) for p, s in rows for q, _ in rows if p != q and s in q)
    assert plan(df).index("explode(deps") < plan(df).index("Join")  # single files are neither sent nor sorted


def test_containment_within_projects(spark):
    rows = [(k % 3, f"src/m{k}.ts", f"src/m{k % 4}") for k in range(40)]
    got = sorted(tuple(r) for r in multifile.contained(spark.createDataFrame(rows, "project long, path string, source string"), ("project",)).collect())
    assert got == sorted((a, p, q) for a, p, s in rows for b, q, _ in rows if a == b and p != q and s in q)


def test_template_variables_rewrite_once(spark):
    df = catalog.queries()["log_template_vars"](spark, DATA)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == len(rules.TEMPLATE)


def test_summaries_read_the_texts_once(spark):
    assert "Join" not in plan(catalog.queries()["summarize_logs"](spark, DATA))


def test_auto_optimize_makes_texts_once(spark):
    assert "Join" not in plan(catalog.queries()["auto_optimize"](spark, DATA))


def test_smart_pipeline_makes_texts_once(spark):
    assert "Join" not in plan(catalog.queries()["smart_pipeline"](spark, DATA))


def test_rules_of_errors_tried_where_needed_give_what_all_give(spark):
    odd = ["a:\\x\\y.ts 1", "./a/b.js LINE 12 Col 3 cOLumn 4", "x  y\tz\x0b\f\r", "'q' \"r\" `s`", "2020-01-02T03:04:05.1Z 01/02/2003 04:05:06", "deadbeef" * 4 + " 123456", "(1, 2) [3,4] :5:6", "\u212a \u0130 line 3", "", "   ", "x\u00a0 12345\u2003y"]
    x = spark.createDataFrame([(v,) for v in odd], "x string").select("x", T.normalize_error(F.col("x")).alias("a"), compress._normalized_errors(F.array("x"))[0].alias("b"))
    assert x.where("not (a <=> b)").collect() == []


def test_texts_as_rows_are_told_as_lines_are(spark):
    texts = spark.createDataFrame([(0, ""), (1, "a 1\na 2\na 3\n\nb"), (2, "\n \n"), (3, "x ERROR y\nx 1\nx 2\nerror a\nx 3\nx 4\n+p\nq"), (4, None), (5, "z\n-a\nb\nc\nd")], "id int, c string")
    for name in ("error_groups", "logs", "generic", "hunks"):
        want = {r.id: r.compressed for r in getattr(compress, name)(compress.lines_of(texts, "id", "c"), "id").collect()}
        got = {r.id: r.t for r in texts.select("id", getattr(compress, f"{name}_text")(F.col("c")).alias("t")).collect() if r.t is not None}
        assert got == want, name


_PROSE = "\n".join(f"the {w} note {w} must fail on port {k}" if k % 4 == 0 else f"plain {w} line of {w * (k % 5)}" for k, w in enumerate(["alpha", "beta", "gamma", "delta"] * 8))
_ODD = {
    "prose": ("generic", 1, _PROSE),
    "words": ("generic", 1, "Ärger İs Über\tnaïve\n\n" + "x_1 y2 `z` ünï é\r\n" * 30),
    "one line": ("generic", 1, "word " * 100),
    "empty": ("generic", 1, ""),
    "code": ("code", 1, "import { a } from './m'\n" + "\n".join(f"export function f{k}(x) {{\n  return x + {k}\n}}" for k in range(20))),
    "trace": ("stacktrace", 2, "TypeError: bad value\n" + "    at f (/src/a.ts:3:4)\n" * 40 + "\n".join(f"    at {w}{w} (/src/{w}.ts:1:2)" for w in ("ab", "cd", "ef", "gh")) + "\nplain end"),
    "tsc": ("build", 2, "\n".join(f"src/a{k}.ts({k},2): error TS230{k % 2}: Cannot find name 'v{k}'." for k in range(9))),
    "rust": ("build", 2, "error[E0425]: cannot find `x` in 3\n --> a.rs:1:2\nerror[E0425]: cannot find `y` in 4\n --> a.rs:3:2\n" + "npm ERR! code 1\n" * 20),
    "webpack": ("build", 2, "ERROR in ./a.js:1:2\nModule not found: Error: Can't resolve 'x'\nERROR in ./b.js\nModule build failed (from l): bad 1\nModule build failed (from l): bad 2\n" + "npm ERR! code 1\n" * 20),
    "npm": ("build", 1, "npm ERR! code 1\n" * 10),
    "generic build": ("build", 2, "error: aborting due to 2 things\nwarning[W1]: unused\n" + "BUILD FAILED\n" * 20),
    "server": ("logs", 1, "\n".join(f"2024-01-02 03:04:05 GET /a/{k} {200 + 100 * (k % 4)} 5ms" for k in range(9))),
    "log": ("logs", 1, "\n".join(f"2024-01-02 03:04:05 [{v}] did {v}" for v in ("ERROR", "WARN", "INFO"))),
}


def test_smart_pipeline_does_the_steps_that_it_names(spark):
    texts = spark.createDataFrame([(k, v[2]) for k, v in _ODD.items()], "id string, c string")
    got = {r.id: r for r in compressors.piped(compressors.chain_type(texts)).collect()}
    assert {k: (r.pipeline_type, r.steps) for k, r in got.items()} == {k: v[:2] for k, v in _ODD.items()}
    con = duckdb.connect()
    con.sql("create table odd (id varchar, c varchar)")
    con.executemany("insert into odd values (?, ?)", [(k, v[2]) for k, v in _ODD.items()])
    sql = f"WITH {compressors._PIPED} SELECT t.id, coalesce(two.compressed, one.compressed, t.c) FROM typed t LEFT JOIN one ON one.id = t.id LEFT JOIN two ON two.id = t.id".replace(detect.TEXTS_SQL, "texts AS (SELECT * FROM odd)")
    assert {k: r.c for k, r in got.items()} == dict(con.sql(sql).fetchall())
    assert got["server"].c == "9 requests, 4 errors" and "cannot find `X` in N x2" in got["rust"].c and 0 < len(got["prose"].c) <= len(_PROSE) / 2
    whole = spark.createDataFrame([("k", '{"a": {"b": {"c": 1, "d": 2}}, "e": ' + str(list(range(30))) + "}")], "id string, c string")
    made = compressors.piped(compressors.chain_type(whole)).first()
    assert (made.pipeline_type, made.steps) == ("config", 1) and "more items" in made.c


def test_smart_pipeline_compresses_as_semantic_compress(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("c"))
    got = {r.id: r.c for r in compressors.piped(docs.withColumn("pipeline_type", F.lit("generic"))).collect()}
    assert got == {r.doc_id: r.compressed or "" for r in catalog.queries()["compress_semantic"](spark, DATA).collect()}
