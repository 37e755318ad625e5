"""File scans and captured git output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files
from . import duck as D
from . import inputs as I
from .registry import query


def written(spark, sf_dir):
    """The code files as text files in the shared folder, 16 folders of them."""
    root = files.work_dir(spark, "files")
    I.code_files(spark, sf_dir).select(F.col("content").alias("value"), (F.col("p_partkey") % 16).alias("part"), F.col("p_partkey").alias("key")).repartition(16, "part").sortWithinPartitions("part", "key").drop("key").write.partitionBy("part").text(root)
    return root


_WRITTEN = f"{D.CODE_FILES}, written AS (SELECT CAST(p_partkey % 16 AS VARCHAR) AS part, string_agg(content || chr(10), '' ORDER BY p_partkey) AS value FROM code_files GROUP BY 1)"


@query("scan_files", f"WITH {_WRITTEN} SELECT part, strlen(value) AS length FROM written")
def scan_files(spark, sf_dir):
    listed = files.scan_files(spark, written(spark, sf_dir), "**/*.txt")
    return listed.select(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), "length")


@query("read_text", f"WITH {_WRITTEN} SELECT part, len(string_split(value, chr(10))) AS lines, md5(value) AS hash FROM written")
def read_text(spark, sf_dir):
    """Each file as one text: its folder, lines and hash."""
    x = spark.read.text(written(spark, sf_dir), wholetext=True, recursiveFileLookup=True)
    return x.select(F.regexp_extract(F.input_file_name(), r"part=(\d+)", 1).alias("part"), F.size(F.split("value", "\n")).alias("lines"), F.md5("value").alias("hash"))


@query("pipe_read", f"WITH {_WRITTEN} SELECT part, length(value) AS chars, CAST(NULL AS VARCHAR) AS error FROM written")
def pipe_read(spark, sf_dir):
    """Files with their content, or an error for those that are too large."""
    return files.read_files(spark, written(spark, sf_dir), ["**/*.txt"]).select(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), F.length("content").alias("chars"), "error")


@query("load_multi", f"WITH {_WRITTEN} SELECT part, md5(value) AS hash FROM written WHERE regexp_matches(part, '^(1.*|2|3)$')")
def load_multi(spark, sf_dir):
    """Several globs; a file that fits more than one comes once."""
    return files.read_files(spark, written(spark, sf_dir), ["part=1*/*.txt", "part={1,2,3}/**"]).select(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), F.md5("content").alias("hash"))


_LOG = """entries AS (SELECT o_custkey, o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority || ' order' || chr(10) || 'total ' || o_orderkey AS m FROM orders)"""


@query("git_log_parse", f"WITH {_LOG} SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, h AS hash, h[:7] AS short_hash, 'author' || (o_custkey % 7) AS author, d AS date, m AS message FROM entries")
def git_log_parse(spark, sf_dir):
    return files.parse_log(log_texts(spark, sf_dir), "o_custkey", "output")


def log_texts(spark, sf_dir):
    """(o_custkey, output): a captured log for each customer, a commit for each order."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    author = F.concat(F.lit("author"), F.col("o_custkey") % 7)
    entry = F.concat_ws("\n", h, F.substring(h, 1, 7), author, F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat("o_orderpriority", F.lit(" order")), F.concat(F.lit("total "), "o_orderkey"))
    x = I.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("x"))
    return x.select("o_custkey", F.array_join(F.transform("x", lambda r: r["e"]), "\n---COMMIT---\n").alias("output"))


@query("git_log", f"WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM entries) SELECT o_custkey, k, h[:7] AS short_hash, 'author' || (o_custkey % 7) AS author, d AS date FROM k WHERE k < 100")
def git_log(spark, sf_dir):
    """At most 100 commits of each log, as the operator's limit says."""
    return git_log_parse(spark, sf_dir).where("k < 100").select("o_custkey", "k", "short_hash", "author", "date")


@query("git_blame_parse", "SELECT o_custkey, sha1(CAST(o_orderkey AS VARCHAR))[:7] AS hash, 'clerk ' || (o_orderkey % 9) AS author, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line, 'order ' || o_orderkey AS content FROM orders")
def git_blame_parse(spark, sf_dir):
    return _blamed(spark, sf_dir).select("o_custkey", "hash", "author", "line", "content")


def _blamed(spark, sf_dir):
    x = I.table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    head = F.concat(F.sha1(F.col("o_orderkey").cast("string")), F.lit(" 1 "), "r", F.lit(" 1"))
    part = F.concat_ws("\n", head, F.concat(F.lit("author clerk "), F.col("o_orderkey") % 9), F.concat(F.lit("author-time "), F.col("o_orderkey") + 1_700_000_000), F.concat(F.lit("\torder "), "o_orderkey"))
    texts = x.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("r", part.alias("p")))).alias("x"))
    return files.parse_blame(texts.select("o_custkey", F.array_join(F.transform("x", lambda r: r["p"]), "\n").alias("output")), "o_custkey", "output")


@query("git_blame", "SELECT o_custkey, 'clerk ' || (o_orderkey % 9) AS author, count(*) AS n FROM orders GROUP BY 1, 2")
def git_blame(spark, sf_dir):
    """Lines of each file by author."""
    return _blamed(spark, sf_dir).groupBy("o_custkey", "author").agg(F.count("line").alias("n"))


@query("git_diff", "SELECT l_orderkey, count(*) AS files, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_suppkey END) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1")
def git_diff(spark, sf_dir):
    """Totals of captured numstat output."""
    from .more import git_numstat

    return git_numstat(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


@query("git_status", "SELECT o_orderkey % 100 AS repo, count(*) FILTER (o_orderstatus = 'F') AS staged, count(*) FILTER (o_orderstatus = 'O') AS modified, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS untracked FROM orders GROUP BY 1")
def git_status(spark, sf_dir):
    from .more import git_status_parse

    g = git_status_parse(spark, sf_dir).groupBy((F.col("o_orderkey") % 100).alias("repo"))
    return g.agg(*[F.count_if(c).alias(c) for c in ("staged", "modified", "untracked")])


@query("git_branch", "SELECT n_nationkey, 'b' || n_regionkey AS current, 2 AS branches FROM nation")
def git_branch(spark, sf_dir):
    """The current branch and the number of branches from captured ``git branch`` output."""
    x = I.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("  main\n* b"), "n_regionkey", F.lit("\n")).alias("output"))
    return x.select("n_nationkey", F.regexp_extract("output", r"(?m)^\* (.+)$", 1).alias("current"), F.size(F.filter(F.split("output", "\n"), lambda b: F.trim(b) != "")).alias("branches"))
