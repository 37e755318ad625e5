"""Hand-computed values of functions and operators."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ordered
from sparkloom.operators.fluent import EmptyPipelineError, Pipeline


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_normalisers(spark):
    assert one(spark, "src/a.ts(12,5): error at /x/y.py line 7", T.normalize_error) == "src<FILE>(<LINE>): error at <FILE> line <LINE>"
    assert one(spark, "took 12.5ms at /a/b 'x'", T.normalize_log_grouping) == "took <n>ms at <path> '<str>'"
    assert one(spark, "GET /users/12", T.log_template) == "GET <PATH>"
    assert one(spark, "npm run test --watch src/a.ts", T.normalize_command) == "npm run test"


def test_boundary_is_ascii(spark):
    assert one(spark, "éerror", lambda c: c.rlike(T.java(r"\berror\b")))
    assert not one(spark, "xerror", lambda c: c.rlike(T.java(r"\berror\b")))


def test_levels_and_null(spark):
    assert one(spark, "2024-01-01 WARN slow", T.log_level) == "warning"
    assert one(spark, "nothing", T.log_level) == "info"
    assert one(spark, None, T.token_count) is None


def test_glob():
    import re

    rx = re.compile(T.glob_regex("src/**/*.{ts,py}").replace(r"\z", r"\Z"))
    assert rx.match("src/a.ts") and rx.match("src/x/y/a.py") and not rx.match("src/a.go") and not rx.match("lib/a.ts")


def test_runs_and_chunks(spark):
    df = spark.createDataFrame([(1, k, v, s) for k, (v, s) in enumerate([("a", 0), ("a", 5), ("b", 12), ("a", None), ("a", 30)], 1)], "d int, p int, v string, s long")
    assert sorted((r.start, r.value, r.length) for r in ordered.runs(df, "d", "p", F.col("v")).collect()) == [(1, "a", 2), (3, "b", 1), (4, "a", 2)]
    assert sorted((r.chunk, r.n) for r in ordered.anchored_chunks(df, "d", "p", F.col("s"), 10).collect()) == [(0, 2), (1, 2), (2, 1)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 6), (1, 1, 0.8, 6), (1, 2, 0.7, 4)], "d int, p int, s double, c long")
    assert ordered.greedy_budget(df, "d", "p", F.col("s"), F.col("c"), F.lit(10)).first().kept == [0, 2]


def test_pipeline_is_immutable_and_recovers(spark):
    p = Pipeline.from_data(spark, [(1, "b"), (2, "a"), (3, "b")], "pos int, v string")
    q = p.unique("v").sort("v")
    assert p.get_steps() == [] and q.get_steps() == ["unique", "sort"]
    assert [r.v for r in q.build().collect()] == ["a", "b"]
    assert p.map(x=F.col("missing")).recover(lambda e: p.build().limit(1)).build().count() == 1
    with pytest.raises(EmptyPipelineError):
        Pipeline().build()


def test_alike(spark):
    from sparkloom.operators.clustering import alike, similarity

    df = spark.createDataFrame([("", "", 0.7), ("kitten", "sitting", 0.5), ("abc", "xyz", 0.7), ("0123456789", "012345678x", 0.9), ("0123456789", "01234567xx", 0.9)], "a string, b string, t double")
    got = df.select(*[alike(F.col("a"), F.col("b"), t).alias(f"t{k}") for k, t in enumerate((0.5, 0.7, 0.9))], F.round(similarity(F.col("a"), F.col("b")), 6).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, 1.0), (True, False, False, 0.571429), (False, False, False, 0.0), (True, True, True, 0.9), (True, True, False, 0.8)]


def test_leaders_follow_input_order(spark):
    from sparkloom.operators.clustering import leaders
    from sparkloom.ship import ship

    ship(spark)
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["request one", "request two", "disk full", "request one", "request onx"])], "d long, p int, t string")
    got = {r.t: (r.leader, r.n) for r in leaders(df, "d", "p", "t", 0.7).collect()}
    assert got == {"request one": ("request one", 2), "request two": ("request one", 1), "disk full": ("disk full", 1), "request onx": ("request one", 1)}


def test_code_elements():
    from sparkloom.operators.code import elements

    py = "import os\nfrom a.b import c\nX = 1\nclass A:\n    def f(self):\n        def g(): pass\ndef _h(): pass\n"
    assert [(e.bucket, e.name, e.parent, e.exported) for e in elements(py, "python")] == [
        ("imports", "os", None, False), ("imports", "c", None, False), ("variables", "X", None, True), ("classes", "A", None, True), ("functions", "f", "A", True), ("functions", "g", "A", True), ("functions", "_h", None, False)
    ]
    assert elements("def broken(", "python") == [] and elements("x", "cobol") == []
    ts = "import {a} from './a';\nexport class B {\n  go(x: number) {\n    if (x) { }\n  }\n}\nexport const f = (x) => x;\nfunction g() {\n  const s = '}'; // }\n  return 1;\n}\nlet u = `{`\n"
    assert [(e.bucket, e.name, e.parent, e.start, e.end, e.exported) for e in elements(ts, "typescript")] == [
        ("imports", "a", None, 1, 1, False), ("classes", "B", None, 2, 6, True), ("functions", "go", "B", 3, 5, False), ("functions", "f", None, 7, 7, True), ("functions", "g", None, 8, 11, False), ("variables", "u", None, 12, 12, False)
    ]
    for language in ("typescript", "go", "rust", "php", "swift"):  # odd texts don't fail
        for odd in ("", "\n", "}}}", "{{{", "'", '"', "/*", "import", "func (", "class"):
            assert isinstance(elements(odd, language), list)


def test_cache_replay(spark):
    from sparkloom.operators.cache import replay
    from sparkloom.ship import ship

    ship(spark)
    ops = [(1, 0, 0.0, "set", "a"), (1, 1, 1.0, "get", "a"), (1, 2, 2.0, "set", "b"), (1, 3, 3.0, "set", "c"), (1, 4, 4.0, "get", "a"), (1, 5, 99.0, "get", "c")]
    r = replay(spark.createDataFrame(ops, "cache long, seq long, at double, op string, key string"), capacity=2, ttl=10).first()
    assert (r.hits, r.not_found, r.expired, r.evicted, r.entries) == (1, 1, 1, 1, 1)
    more = [("set", "a", "/x", "h1", 60), ("get", "a", "/x", "h2", 0), ("set", "a", "/x", "h1", 60), ("set", "b", "/y", "h1", 60), ("get", "a", "/x", "h1", 0), ("invalidate_path", "", "/y", None, 0), ("get", "b", "/y", "h1", 0), ("clear", "", None, None, 0), ("get", "b", None, None, 0)]
    r = replay(spark.createDataFrame([(1, k, float(k), *m, 7) for k, m in enumerate(more)], "cache long, seq long, at double, op string, key string, path string, hash string, size long, tokens long"), most_bytes=100).first()
    assert (r.hits, r.file_changed, r.not_found, r.evicted, r.invalidated, r.tokens_saved, r.entries, r.bytes) == (0, 1, 3, 1, 1, 0, 0, 0)


def test_files(spark, tmp_path):
    from sparkloom.sources.files import parse_numstat, parse_status, read_files, scan_files

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "node_modules" / "b.py").write_text("y")
    assert [r.path for r in scan_files(spark, str(tmp_path), "**/*.py").collect()] == ["src/a.py"]
    assert [(r.path, r.content, r.error) for r in read_files(spark, str(tmp_path), ["src/*.py", "**/a.py"]).collect()] == [("src/a.py", "x = 1", None)]
    lines = spark.createDataFrame([("3\t-\tsrc/a.py",), ("bad",)], "line string")
    assert [tuple(r) for r in parse_numstat(lines).collect()] == [(3, 0, "src/a.py")]
    status = spark.createDataFrame([("M  a",), (" M b",), ("?? c",)], "line string")
    assert [tuple(r) for r in parse_status(status).collect()] == [("a", True, False, False), ("b", False, True, False), ("c", False, False, True)]
