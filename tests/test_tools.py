"""Hand-computed values of tools, limits, memories, memos, presets and renderers."""

import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compress, fluent, memory, render, tools
from sparkloom.operators.fluent import Pipeline
from sparkloom.ship import ship


def test_limits_stop_a_block_and_are_taken_back():
    with pytest.raises(tools.Timeout), tools.limited(0.05):
        while True:
            pass
    with tools.limited(0.05):
        pass
    time.sleep(0.1)  # no alarm is left


def test_bounded_functions(spark):
    run = tools.bounded(spark, lambda x: {"a": [x, None]}, most_tokens=4)
    assert [tuple(r.r) for r in spark.createDataFrame([("é",), (None,)], "t string").select(run("t").alias("r")).collect()] == [('{\n  "a": "[2 ite', None, 5), ('{\n  "a": "[2 ite', None, 5)]


def test_lazily_makes_once():
    made = []
    model = tools.lazily(lambda: made.append(1) or "model")
    assert not model.ready and model() == model() == "model" and made == [1] and model.ready
    model.reset()
    assert not model.ready


def test_encoders_see_known_texts_only(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    got = tools.encode_texts(df, "t", lambda texts: [[len(t), 1.0, 9.0] for t in texts], 2).collect()
    assert [r.embedding for r in got] == [[2.0, 1.0], None, [0.0, 1.0]]
    v = {r.k: r.vector for r in tools.hashed_vectors(spark.createDataFrame([(1, "same words here"), (2, "here same words"), (3, None)], "k int, t string"), "k", "t", 8).collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1) and v[3] == [0.0] * 8


def test_registry_never_raises(spark):
    df = spark.createDataFrame([("1", "a\nb")], "id string, c string")
    r = tools.Registry()
    r.add(tools.Tool("lines", "t", "number of lines", lambda df, least=0: df.select(F.size(F.split("c", "\n")).alias("n")).where(F.col("n") >= least)))
    r.add(tools.Tool("bad", "t", "fails", lambda df: df.select("missing")))
    assert r.execute("lines", df, least=2).df.first().n == 2 and r.execute("lines", df).tokens_in == 1
    assert r.execute("bad", df).error and r.execute("none", df).error == "Unknown tool: none"

    class Handles(tools.Middleware):
        def on_error(self, call, error):
            return tools.Outcome(None, "handled")

    r.chain = tools.Chain(Handles())
    assert r.execute("bad", df).error == "handled"


def test_sanitized():
    assert tools.sanitized("bad /home/ann/x\nat y", "") == "bad <home>/x" and tools.sanitized("", "/w") == "Unknown error" and tools.sanitized("/w/a", "/w") == "<workdir>/a"


def test_memory_table(spark):
    t = memory.MemoryTable(spark, "k")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert t.get() is None and t.clear() is None and t.has(keys).where("known").count() == 0
    t.set(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    old = t.get()
    t.set(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, t.get().collect())) == [(1, "a"), (2, "c"), (3, "d")] and sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    assert t.clear(keys.where("k = 1")).count() == 2 and t.clear().count() == 0 and t.version == 4


def test_output_config():
    c = memory.OutputConfig()
    assert not c.toon and c.set(mode="toon").verbosity == "normal" and c.toon and c.reset() == memory.Output()
    with pytest.raises(ValueError):
        c.set(verbosity="loud")


def test_memo_keeps_for_a_time():
    made = []
    memo = fluent.Memo(seconds=0.05, most=2)
    make = lambda: made.append(1) or len(made)
    assert memo.get("a", make) == memo.get("a", make) == 1
    time.sleep(0.06)
    assert memo.get("a", make) == 2 and memo.get("b", make) == 3 and memo.get("c", make) == 4 and list(memo.held) == ["b", "c"]


def test_pipelines_over_files(spark, tmp_path):
    ship(spark)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def used():\n    pass\ndef lonely():\n    pass\n")
    (tmp_path / "src" / "b.py").write_text("from a import used\nused()\n")
    files = Pipeline.glob(spark, str(tmp_path), "**/*.py").read()
    assert [r.path for r in files.build().orderBy("pos").collect()] == ["src/a.py", "src/b.py"]
    assert sorted(r.name for r in fluent.PRESETS["signatures"](files).collect()) == ["lonely", "used"]
    assert [r.name for r in fluent.PRESETS["dead_code"](files).collect()] == ["lonely"]
    assert sorted((r.path, r.line, r.kind) for r in fluent.PRESETS["usages"](files, "used").collect()) == [("src/a.py", 1, "definition"), ("src/b.py", 1, "usage"), ("src/b.py", 2, "usage")]
    assert fluent.PRESETS["overview"](files).first().files == 2
    with pytest.raises(ValueError, match="no such step"):
        files.steps_of([{"fly": 1}])
    df, stats = files.steps_of([{"filter": F.col("path").endswith("a.py")}, {"limit": 5}]).run()
    assert df.count() == 1 and stats()["items"] == 1 and stats()["steps"] == 3


def test_empty_and_blank_texts(spark):
    texts = spark.createDataFrame([("a", ""), ("b", None), ("c", "\n\n"), ("d", "x")], "id string, c string")
    lines = compress.lines_of(texts, "id", "c")
    for f in (compress.logs, compress.error_groups):
        assert {r.id for r in f(lines, "id").collect()} == {"d"}
    assert {r.id: r.compressed for r in compress.generic(lines, "id").collect()} == {"c": "  ... (repeated 2 more times)", "d": "x"}
    assert {r.id: r.compressed for r in compress.stacktrace(lines, "id").collect()} == {"a": "", "c": "\n\n", "d": "x"}
    assert compress.hunks(lines, "id").count() == 0


def test_generic_tells_repeats(spark):
    text = "\n".join(["step 1", "step 2", "step 3", "other", "Error 1", "a", "Error 2", "b", "Error 3", "c", "Error 4"])
    got = compress.generic(compress.lines_of(spark.createDataFrame([("x", text)], "id string, c string"), "id", "c"), "id").first().compressed
    assert got.split("\n") == ["step 1", "  ... (repeated 2 more times)", "other", "Error 1", "  ... (3 similar errors)", "a", "b", "c"]


def test_schema_signature(spark):
    df = spark.createDataFrame([], "a string, b int, c array<int>, d boolean")
    assert render.schema_signature(df.schema) == "a? b?:num c?:arr d?:bool"


def test_segments(spark):
    from sparkloom.operators.segments import segment_content

    text = "one\ntwo\n\nall failed here\nsecond\n\n```py\nx\n\n~~~\n```\nafter\n~~~\nopen"
    rows = [(1, text), (2, ""), (3, None), (4, "an error\nat the end"), (5, "\n\n  lone  \n")]
    got = sorted(map(tuple, segment_content(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()))
    assert got == [
        (1, 0, 1, "paragraph", "one\ntwo"), (1, 3, 3, "line", "all failed here"), (1, 4, 4, "line", "second"), (1, 6, 10, "code-block", "```py\nx\n\n~~~\n```"),
        (1, 11, 11, "paragraph", "after"), (1, 12, 13, "code-block", "~~~\nopen"), (4, 0, 1, "paragraph", "an error\nat the end"), (5, 2, 2, "paragraph", "lone"),
    ]
