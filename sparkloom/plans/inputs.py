"""Inputs derived from the driver's tables: logs, requests, build output, commands, code, diffs and conversations, as many rows as their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_type(table: dict[str, str], other: str):
    out = F.lit(other)
    for kind, to in table.items():
        out = F.when(F.col("event_type") == kind, to).otherwise(out)
    return out


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tail = F.concat("event_type", F.lit(" request "), "event_id", F.lit(" took "), F.floor("value").cast("string"), F.lit("ms for '/api/user/"), "user_id", F.lit("'"))
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("doc_id"),
        F.row_number().over(order).cast("long").alias("pos"),
        _by_type({"error": "error", "purchase": "warning", "click": "debug"}, "info").alias("lvl"),
        F.concat(ts, F.lit(" ["), _by_type({"error": "ERROR", "purchase": "WARN", "click": "DEBUG"}, "INFO"), F.lit("] "), tail).alias("raw"),
        tail.alias("message"),
        ts.alias("ts_text"),
        "ts",
        "event_id",
        "user_id",
        "event_type",
        "value",
    )


def rich_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat(F.lit(" trace="), F.md5(F.col("event_id").cast("string")), F.lit(" from 10.0."), F.col("event_id") % 256, F.lit("."), F.col("user_id") % 256, F.lit(":8080 at /srv/app/"), "event_type", F.lit(".log"))
    return log_lines(spark, sf_dir).select("doc_id", "pos", "event_id", F.concat("raw", more).alias("raw"))


def http_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.concat(F.lit("GET /items/"), F.col("event_id") % 50, F.lit("?u="), "user_id", F.lit(" "), _by_type({"error": "500", "signup": "404"}, "200"), F.lit(" "), F.floor("value").cast("string"), F.lit("ms")).alias("raw"))


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    file = F.col("l_partkey") % 20
    order = Window.partitionBy(file).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    raw = F.concat(F.lit("src/p"), file, F.lit(".ts("), "l_linenumber", F.lit(","), "l_suppkey", F.lit("): error TS"), 2300 + F.col("l_linenumber"), F.lit(": Cannot find name 'v"), F.col("l_orderkey") % 7, F.lit("'."))
    return x.select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("pos"), file.alias("doc_id"), raw.alias("raw"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(order).cast("long").alias("pos"), _by_type({"view": "npm run test --watch", "click": "npm test src/a.ts", "error": "npm run build"}, "git status").alias("cmd"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    content = F.concat(F.lit("import os\nfrom mod"), k % 9, F.lit(" import x\ndef f_"), k, F.lit("(x):\n    return g_"), k % 13, F.lit("(x)\nclass C_"), "p_size", F.lit(":\n    pass"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), k, content.alias("content"))


def convo(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("We decided to use plan "), "turn", F.lit(" for file_"), "conv_id", F.lit(".py\n- keep item "), "turn", F.lit("\n"), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    head = x.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("k"))
    name = head.select("doc_id", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("diff --git a/f"), "k", F.lit(" b/f"), "k").alias("raw"))
    hunk = head.select("doc_id", F.lit(1).cast("long").alias("pos"), F.lit("@@ -1,3 +1,3 @@").alias("raw"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    body = x.select(F.col("l_orderkey").alias("doc_id"), (1 + F.row_number().over(order)).cast("long").alias("pos"), F.concat(sign, F.lit("line "), "l_linenumber", F.lit(" of "), "l_suppkey").alias("raw"))
    return name.unionByName(hunk).unionByName(body)
