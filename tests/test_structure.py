"""Hand-computed values of skeletons, chunks, configuration summaries, substrings, git output and code references."""

import random
import subprocess
from collections import deque

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.operators import config, multifile
from sparkloom.plans import conversations, detect
from sparkloom.sources import files


def test_skeletons(spark):
    text = "import a from 'a'\nexport function f(x) {\n  if (x) {\n    y()\n  }\n}\nconst g = (x) => x\ntype T = 1\nlet z = 2\nfunction h({a, b}) {\n  type x\n}\nclass C {\n  run() {}\n"
    rows = [("a", text), ("b", ""), ("c", None), ("d", "  x\n}\nexport const v = 1")]
    got = {r.k: r.skeleton for r in multifile.skeletons(spark.createDataFrame(rows, "k string, content string"), "k").collect()}
    assert got["a"].split("\n") == ["import a from 'a'", "export function f(x) { ... }", "const g = (x) => ...", "type T = 1", "function h({a, b}) { ... }", "class C { ... }"]
    assert got["b"] == got["c"] == "" and got["d"] == "export const v = 1"


def test_chunks_take_in_dependencies_while_tokens_last():
    pdf = pd.DataFrame({"project": [1] * 4, "path": list("abcd"), "tokens": [6, 6, 3, 99], "deps": [["b", "c"], [], [], []]})
    out = dict(zip(*multifile.chunked(pdf, 10)[["path", "chunk"]].to_numpy().T, strict=True))
    assert out == {"a": 0, "c": 0, "b": 1, "d": 2}


def test_chunks_are_the_queue():
    """Against a plain queue, on random projects."""
    rng = random.Random(4)
    for _ in range(200):
        paths = [f"f{k}" for k in range(rng.randint(1, 12))]
        cost = {p: rng.randint(1, 9) for p in paths}
        needs = {p: sorted(rng.sample(paths, rng.randint(0, min(4, len(paths))))) for p in paths}
        pdf = pd.DataFrame({"project": [0] * len(paths), "path": paths, "tokens": cost.values(), "deps": needs.values()})
        got = dict(zip(*multifile.chunked(pdf, 12)[["path", "chunk"]].to_numpy().T, strict=True))
        home, n = {}, 0
        for p in sorted(paths):
            if p in home:
                continue
            waiting, used = deque([p]), 0
            while waiting and used < 12:
                q = waiting.popleft()
                if q not in home and (q == p or used + cost[q] <= 12):
                    home[q], used = n, used + cost[q]
                    waiting.extend(needs[q])
            n += 1
        assert got == home


def test_brief_json_and_yaml():
    assert config.brief([1, 2, 3, 4, 5, 6], 0, 2) == [1, 2, "... (4 more items)"]
    assert config.brief({"a": {"b": {"c": 1}}, "s": "x" * 101}, 0, 1) == {"a": "{1 keys}", "s": "x" * 97 + "..."}
    assert config.brief_json("{no") == "{no"
    assert config.brief_yaml("a:\n  b:\n      c: 1\n      d: 2\ne: 1", "minimal") == "a:\n  b:\n    ... (2 nested items)\ne: 1"


def test_contained_is_the_nested_loop(spark):
    rows = [("src/a.ts", "src/b"), ("src/b.ts", "zod"), ("src/bc.ts", "x/src/a/y")]
    got = {tuple(r) for r in multifile.contained(spark.createDataFrame(rows, "path string, source string")).collect()}
    stem = lambda p: p.removesuffix(".ts")
    assert got == {(p, q) for p, s in rows for q, _ in rows if p != q and (s in q or stem(q) in s)}


def test_resolved(spark):
    imports = spark.createDataFrame([("src/x/a.ts", "./b"), ("src/x/a.ts", "../c"), ("src/x/a.ts", "zod"), ("a.ts", "./c")], "path string, source string")
    listing = spark.createDataFrame([("src/x/b.tsx",), ("src/x/b.js",), ("src/c/index.ts",), ("c.py",)], "path string")
    assert {tuple(r) for r in multifile.resolved(imports, listing).collect()} == {("src/x/a.ts", "./b", "src/x/b.tsx"), ("src/x/a.ts", "../c", "src/c/index.ts"), ("src/x/a.ts", "zod", None), ("a.ts", "./c", "c.py")}


def test_code_references(spark):
    convo = spark.createDataFrame([(1, 0, "I created src/a.py today"), (1, 1, "src/a.py again, and b.md"), (2, 0, None)], "conv_id long, turn long, text string")
    assert {tuple(r) for r in conversations.references(convo).drop("at").collect()} == {(1, "src/a.py", "created", 0), (1, "b.md", "discussed", 1)}
    odd = spark.createDataFrame([(3, 0, "see lib/x.py.bak and x.py; removed x.py")], "conv_id long, turn long, text string")
    assert {tuple(r)[:3] for r in conversations.references(odd).collect()} == {(3, "lib/x.py", "deleted"), (3, "x.py", "deleted")}


def test_compiler_output(spark):
    lines = spark.createDataFrame([(1, 0, "noise"), (1, 1, "error[E0425]: no `x`"), (1, 2, "  --> a.rs:3:4"), (1, 3, "error[E0001]: bad 12")], "doc_id long, pos long, raw string")
    got = [(r.code, r.file, r.line, r.signature) for r in detect.rust_errors(lines).orderBy("pos").collect()]
    assert got == [("E0425", "a.rs", 3, "E0425:no `X`"), ("E0001", "unknown", 0, "E0001:bad N")]


def test_git_output(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f.txt").write_text("one\ntwo\n")
    run("add", "-A")
    run("-c", "user.name=A B", "-c", "user.email=a@b", "commit", "-qm", "first")
    log = files.git_output(spark, str(tmp_path), "log", "--format=%H%n%h%n%an%n%ad%n%B%n---COMMIT---")
    assert [(r.author, r.message) for r in files.parse_log(log, "root", "output").collect()] == [("A B", "first")]
    blame = files.parse_blame(files.git_output(spark, str(tmp_path), "blame", "--porcelain", "f.txt"), "root", "output")
    assert [(r.line, r.content) for r in blame.orderBy("line").collect()] == [(1, "one"), (2, "two")]
    assert files.git_output(spark, str(tmp_path), "no-such-command").first().error


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, pos long, raw string")
    for parse in (detect.rust_errors, detect.webpack_errors, detect.go_errors, detect.any_errors):
        assert parse(none).count() == 0
    texts = spark.createDataFrame([("a", ""), ("b", None)], "id string, c string")
    assert {r.pipeline_type for r in detect.pipeline_type(texts).collect()} == {"generic"}
    assert texts.select(F.size(multifile.substrings(F.lit("abab"), F.lit(2))).alias("n")).first().n == 2
