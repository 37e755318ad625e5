"""Reports, serialised results and configuration texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import config, retrieval
from ..ship import ship
from . import duck as D
from . import inputs as I
from .registry import query
from .search import bm25_sql

# Reports.


@query("report_text", "SELECT string_agg(format('{:<10} {:>8}', lang, n), chr(10) ORDER BY n DESC, lang) AS report FROM (SELECT coalesce(lang, '-') AS lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 20)")
def report_text(spark, sf_dir):
    """A table of the 20 largest groups."""
    g = I.table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(20)
    rows = g.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang", F.format_string("%-10s %8d", "lang", "n").alias("s")))).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda r: r["s"]), "\n").alias("report"))


def toon_field(c, most: int):
    """null as -, and texts cut to ``most`` characters."""
    return F.coalesce(F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c), F.lit("-"))


@query("toon_result", "SELECT o_orderkey, 'o_orderkey: ' || o_orderkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) || 'o_orderpriority: ' || o_orderpriority AS toon FROM orders")
def toon_result(spark, sf_dir):
    """Each row as an object of one field a line."""
    fields = [F.concat(F.lit(f"{c}: "), toon_field(F.col(c).cast("string"), 100)) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")]
    return I.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", *fields).alias("toon"))


_JSON_ROW = """'{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}'"""


@query("toon_savings", f"""WITH g AS (SELECT o_custkey, '[' || string_agg({_JSON_ROW}, ',') || ']' AS json, 'rows[' || count(*) || ']{{o_orderkey,o_orderstatus,o_orderpriority}}:' || string_agg(chr(10) || '  ' || o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority, '') AS toon FROM orders GROUP BY 1) SELECT o_custkey, CAST(ceil(length(json) / 4.0) AS BIGINT) AS json_tokens, CAST(ceil(length(toon) / 4.0) AS BIGINT) AS toon_tokens, round(1 - length(toon) / CAST(length(json) AS DOUBLE), 6) AS saved FROM g""")
def toon_savings(spark, sf_dir):
    """Tokens of the orders of each customer as JSON and as a table with one header."""
    x = I.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    row = F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")
    header = len("rows[]{o_orderkey,o_orderstatus,o_orderpriority}:")
    table_row = F.length(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")) + 3
    g = x.groupBy("o_custkey").agg((F.sum(F.length(F.to_json(row)) + 1) + 1).alias("json"), (F.sum(table_row) + header + F.length(F.count("*").cast("string"))).alias("toon"))
    tokens = lambda c: F.ceil(F.col(c) / 4).cast("long")
    return g.select("o_custkey", tokens("json").alias("json_tokens"), tokens("toon").alias("toon_tokens"), F.round(1 - F.col("toon") / F.col("json"), 6).alias("saved"))


# Configuration texts.


def config_texts(spark, sf_dir):
    """(o_custkey, json, yaml): a customer's orders as JSON and as nested YAML."""
    row = F.struct("o_orderkey", "o_orderstatus", F.struct("o_orderpriority", F.array("o_custkey", "o_orderkey").alias("keys")).alias("more"))
    y = F.concat(F.lit("order"), "o_orderkey", F.lit(":\n  status: "), "o_orderstatus", F.lit("\n  more:\n      deep:\n        key: "), "o_orderkey")
    g = I.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r"), y.alias("y")))).alias("x"))
    return g.select("o_custkey", F.to_json(F.transform("x", lambda v: v["r"])).alias("json"), F.array_join(F.transform("x", lambda v: v["y"]), "\n").alias("yaml"))


_ORDERS = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
_BRIEF_ROW = """'  {' || chr(10) || '    "o_orderkey": ' || o_orderkey || ',' || chr(10) || '    "o_orderstatus": "' || o_orderstatus || '",' || chr(10) || '    "more": "{2 keys}"' || chr(10) || '  }'"""
_BRIEF_JSON = f"""SELECT o_custkey, '[' || chr(10) || string_agg({_BRIEF_ROW}, ',' || chr(10) ORDER BY r) FILTER (n <= 5 OR r <= 2) || CASE WHEN any_value(n) > 5 THEN ',' || chr(10) || '  "... (' || (any_value(n) - 2) || ' more items)"' ELSE '' END || chr(10) || ']' AS compressed FROM o GROUP BY 1"""
_BRIEF_YAML = "SELECT o_custkey, string_agg('order' || o_orderkey || ':' || chr(10) || '  status: ' || o_orderstatus || chr(10) || '  more:' || chr(10) || '    ... (2 nested items)', chr(10) ORDER BY r) AS compressed FROM o GROUP BY 1"


@query("compress_json", f"WITH {_ORDERS} {_BRIEF_JSON}")
def compress_json(spark, sf_dir):
    ship(spark)
    return config_texts(spark, sf_dir).select("o_custkey", config.column(config.brief_json, F.col("json")).alias("compressed"))


@query("compress_yaml", f"WITH {_ORDERS} {_BRIEF_YAML}")
def compress_yaml(spark, sf_dir):
    ship(spark)
    return config_texts(spark, sf_dir).select("o_custkey", config.column(config.brief_yaml, F.col("yaml"), "minimal").alias("compressed"))


@query("compress_config", f"WITH {_ORDERS}, j AS ({_BRIEF_JSON}), y AS ({_BRIEF_YAML}) SELECT * FROM j WHERE o_custkey % 2 = 0 UNION ALL SELECT * FROM y WHERE o_custkey % 2 <> 0")
def compress_config(spark, sf_dir):
    ship(spark)
    text = F.when(F.col("o_custkey") % 2 == 0, F.col("json")).otherwise(F.col("yaml"))
    return config_texts(spark, sf_dir).select("o_custkey", config.column(config.brief_config, text).alias("compressed"))


@query("pipe_compress", """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, '[' || chr(10) || array_to_string(list_transform(range(0, CASE WHEN n > 5 THEN 2 ELSE n END), lambda i: '  "{3 keys}"'), ',' || chr(10)) || CASE WHEN n > 5 THEN ',' || chr(10) || '  "... (' || (n - 2) || ' more items)"' ELSE '' END || chr(10) || ']' AS compressed FROM c""")
def pipe_compress(spark, sf_dir):
    """A pipeline's end: each group's rows as indented JSON, shortened."""
    ship(spark)
    x = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("x"))
    return x.select("l_orderkey", config.column(config.brief_json, F.to_json("x"), "minimal").alias("compressed"))


@query("catalog_search", "WITH entries AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part), " + bm25_sql("entries", "p_partkey", "small polished part") + " SELECT p_partkey, score, matched_terms FROM bm WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def catalog_search(spark, sf_dir):
    """The 20 parts whose names fit a query best: lexical search over short entries."""
    entries = I.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return retrieval.bm25(entries, "p_partkey", "text", "small polished part").orderBy(F.desc("score"), "p_partkey").limit(20)
