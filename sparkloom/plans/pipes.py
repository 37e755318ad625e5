"""Queries of the pipeline algebra, each a step or two of the builder."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators.fluent import PRESETS, Pipeline
from . import captured
from . import duck as D
from . import inputs as I
from .registry import query


def parts(spark, sf_dir) -> Pipeline:
    df = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name", "p_brand", "p_size", "p_retailprice")
    return Pipeline.of(df)


_P = "SELECT p_partkey AS pos, p_name, p_brand, p_size, p_retailprice FROM part"


@query("pipe_filter", f"SELECT * FROM ({_P}) WHERE p_size > 25 AND p_retailprice < 1500")
def pipe_filter(spark, sf_dir):
    return parts(spark, sf_dir).filter((F.col("p_size") > 25) & (F.col("p_retailprice") < 1500)).build()


@query("pipe_exclude", f"SELECT * FROM ({_P}) WHERE NOT regexp_matches(p_brand, 'Brand.*1')")
def pipe_exclude(spark, sf_dir):
    return parts(spark, sf_dir).exclude("p_brand", "Brand*1").build()


@query("pipe_map", f"SELECT pos, upper(p_name) AS shout FROM ({_P})")
def pipe_map(spark, sf_dir):
    return parts(spark, sf_dir).map(shout=F.upper("p_name")).build().select("pos", "shout")


@query("pipe_flatmap", f"SELECT pos, unnest(string_split(p_name, ' ')) AS word FROM ({_P})")
def pipe_flatmap(spark, sf_dir):
    return parts(spark, sf_dir).flat_map("word", F.split("p_name", " ")).build().select("pos", "word")


@query("pipe_reduce", f"SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM ({_P})")
def pipe_reduce(spark, sf_dir):
    return parts(spark, sf_dir).reduce(n=F.count("*"), total=F.sum("p_size").cast("long")).build()


@query("pipe_take", f"SELECT * FROM ({_P}) ORDER BY pos LIMIT 15")
def pipe_take(spark, sf_dir):
    return parts(spark, sf_dir).take(15).build()


@query("pipe_skip", f"SELECT * FROM ({_P}) ORDER BY pos OFFSET 40")
def pipe_skip(spark, sf_dir):
    return parts(spark, sf_dir).skip(40).build()


@query("pipe_sort", f"SELECT * FROM ({_P}) ORDER BY p_retailprice DESC, pos LIMIT 20")
def pipe_sort(spark, sf_dir):
    return parts(spark, sf_dir).sort("p_retailprice", ascending=False).build().limit(20)


@query("pipe_sort_default", f"SELECT * FROM (SELECT *, CAST(p_size AS VARCHAR) AS k FROM ({_P})) ORDER BY k, pos LIMIT 20")
def pipe_sort_default(spark, sf_dir):
    return parts(spark, sf_dir).map(k=F.col("p_size").cast("string")).sort("k").build().limit(20)


@query("pipe_unique", f"SELECT min(p_partkey) AS pos, p_brand, p_size FROM part GROUP BY 2, 3")
def pipe_unique(spark, sf_dir):
    df = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_brand", "p_size")
    return Pipeline.of(df).unique().build()


@query("pipe_unique_key", f"SELECT * FROM ({_P}) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pos) = 1")
def pipe_unique_key(spark, sf_dir):
    return parts(spark, sf_dir).unique("p_brand").build()


@query("pipe_tap", _P)
def pipe_tap(spark, sf_dir):
    return parts(spark, sf_dir).tap(Observation(), F.count("*").alias("rows")).build()


@query("pipe_from_data", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b')) t(pos, name)")
def pipe_from_data(spark, sf_dir):
    return Pipeline.from_data(spark, [(1, "a"), (2, "b")], "pos long, name string").build()


@query("pipe_recover", f"SELECT *, 'recovered' AS note FROM ({_P})")
def pipe_recover(spark, sf_dir):
    """A step that fails gives way to what comes right after it."""
    p = parts(spark, sf_dir)
    return p.map(note=F.col("no_such_column")).recover(lambda e: p.map(note=F.lit("recovered")).build()).build()


@query("split_ok_err", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events")
def split_ok_err(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return I.table(spark, sf_dir, "events").select("event_id", F.when(~bad, F.col("value")).alias("value"), F.when(bad, "failed").alias("error"))


# Pipelines over files: the code files written as one file for each folder, as in the queries of file scans.

_FILES = f"{D.CODE_FILES}, files AS (SELECT CAST(p_partkey % 16 AS VARCHAR) AS part, string_agg(content || chr(10), '' ORDER BY p_partkey) AS content, count(*) AS n FROM code_files GROUP BY 1)"


def _globbed(spark, sf_dir) -> Pipeline:
    return Pipeline.glob(spark, captured.written(spark, sf_dir), "**/*.txt")


def _part(df, *columns):
    return df.select(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), *columns)


@query("pipe_glob", f"WITH {_FILES} SELECT part, strlen(content) AS length FROM files WHERE part <> '3'")
def pipe_glob(spark, sf_dir):
    return _part(_globbed(spark, sf_dir).exclude("path", "part=3/").build(), "length")


@query("pipe_read_all", f"WITH {_FILES} SELECT part, md5(content) AS hash FROM files")
def pipe_read_all(spark, sf_dir):
    return _part(_globbed(spark, sf_dir).read().build(), F.md5("content").alias("hash"))


@query("pipe_steps", f"WITH {_FILES} SELECT part, 'os' AS name, sum(n) AS n FROM files GROUP BY 1")
def pipe_steps(spark, sf_dir):
    """A pipeline from a list of steps: files read and parsed, their imports of one module counted."""
    steps = [{"read": True}, {"parse": "python"}, {"filter": F.col("name") == "os"}]
    return _globbed(spark, sf_dir).steps_of(steps).build().groupBy(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), "name").agg(F.count("*").alias("n"))


@query("pipe_stats", "SELECT 2 AS steps, count(*) AS items FROM part WHERE p_size > 25")
def pipe_stats(spark, sf_dir):
    """What a pipeline tells of its run: its steps and the rows of its result."""
    df, stats = parts(spark, sf_dir).filter(F.col("p_size") > 25).map(shout=F.upper("p_name")).run()
    df.write.format("noop").mode("overwrite").save()
    told = stats()
    return spark.createDataFrame([(told["steps"], told["items"])], "steps int, items long")


@query("preset_overview", f"WITH {_FILES} SELECT 'unknown' AS language, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files")
def preset_overview(spark, sf_dir):
    return PRESETS["overview"](_globbed(spark, sf_dir).read())


def _sources(spark, sf_dir) -> Pipeline:
    return Pipeline.of(I.code_files(spark, sf_dir).select(F.col("path").alias("pos"), "path", "content"))


@query("preset_usages", f"WITH {D.CODE_FILES}, l AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS t FROM code_files) SELECT path, line, CASE WHEN regexp_matches(t, '\\b(class)\\s+C_7\\b') THEN 'definition' ELSE 'usage' END AS kind, substring(trim(t), 1, 100) AS context FROM l WHERE regexp_matches(t, '\\bC_7\\b')")
def preset_usages(spark, sf_dir):
    return PRESETS["usages"](_sources(spark, sf_dir), "C_7")


@query("preset_signatures", f"WITH {D.CODE_FILES} SELECT path, 'f_' || p_partkey AS name, 'def f_' || p_partkey || '(x)' AS signature FROM code_files")
def preset_signatures(spark, sf_dir):
    return PRESETS["signatures"](_sources(spark, sf_dir))


@query("preset_dead_code", f"WITH {D.CODE_FILES}, c AS (SELECT path, p_size, count(*) OVER (PARTITION BY p_size) AS n FROM code_files JOIN part USING (p_partkey)) SELECT path, 'f_' || p_partkey AS name FROM code_files UNION ALL SELECT path, 'C_' || p_size FROM c WHERE n = 1")
def preset_dead_code(spark, sf_dir):
    """Functions that nothing calls, and classes whose name stands in one file only."""
    return PRESETS["dead_code"](_sources(spark, sf_dir))


@query("pipe_compress_all", """SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_regionkey": ' || r_regionkey || ',' || chr(10) || '    "r_name": "' || r_name || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS compressed FROM region""")
def pipe_compress_all(spark, sf_dir):
    """A pipeline's end: all of its rows as one short text."""
    return Pipeline.of(I.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), "r_regionkey", "r_name")).compress().build()


@query("equi_join", "SELECT c_custkey, n_name, count(o_orderkey) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def equi_join(spark, sf_dir):
    """Rows of several tables that share their keys; Spark chooses between broadcast and sorted joins by their sizes."""
    c, n, o = (I.table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey).groupBy("c_custkey", "n_name").agg(F.count("o_orderkey").alias("orders"))
