"""Clusters of log messages: leaders, profiles, representatives, merging, levels and outliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import clustering
from . import duck as D
from . import inputs as I
from .logs import scores, scores_sql
from .registry import query

_NORM = f"trim({D.rewrite('lower(message)', R.LOG_CLUSTER)})"
_LEVELS = ["error", "warning", "info", "debug"]
_DOMINANT_SQL = "CASE greatest(error, warning, info, debug) " + " ".join(f"WHEN {x} THEN '{x}'" for x in _LEVELS) + " END"


def _alike(a: str, b: str, threshold: float) -> str:
    return f"1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b}), 1) AS DOUBLE) >= {threshold} - 1e-9"


def _heads(name: str, source: str, text: str, order: str, threshold: float) -> str:
    """CTE (doc_id, heads): the greedy choice as a fold over the texts of a document in their order."""
    return f"{name} AS (SELECT doc_id, list_reduce(list_transform(list({text} ORDER BY {order}), lambda t: [t]), lambda a, x: CASE WHEN len(list_filter(a, lambda l: {_alike('l', 'x[1]', threshold)})) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[]) AS heads FROM {source} GROUP BY 1)"


def _clustered(threshold: float) -> str:
    """CTEs up to m0 (doc_id, norm, first, n, leader)."""
    return f"""{D.LOG_LINES}, lines AS (SELECT doc_id, pos, lvl, message, ts_text, {_NORM} AS norm FROM log_lines), d0 AS (SELECT doc_id, norm, min(pos) AS first, count(*) AS n FROM lines GROUP BY 1, 2), {_heads('h0', 'd0', 'norm', 'first', threshold)},
  m0 AS (SELECT doc_id, norm, first, n, list_filter(heads, lambda l: {_alike('l', 'norm', threshold)})[1] AS leader FROM d0 JOIN h0 USING (doc_id))"""


def _profiled(k: int) -> str:
    """CTEs p<k> (doc_id, leader, n, dominant, importance, first ...) of the clusters in m<k>."""
    counts = ", ".join(f"count(*) FILTER (lvl = '{x}') AS {x}" for x in _LEVELS)
    return f"""e{k} AS (SELECT doc_id, leader, pos, lvl, message, ts_text FROM lines JOIN m{k} USING (doc_id, norm)), {scores_sql(f'e{k}', 'doc_id, leader', f's{k}')},
  g{k} AS (SELECT doc_id, leader, count(*) AS n, avg(score) AS mean, arg_min(message, (-score, pos)) AS representative, min(pos) AS first, min(ts_text) AS first_seen, max(ts_text) AS last_seen, round(avg(length(message)), 6) AS mean_length, {counts} FROM e{k} JOIN s{k} USING (doc_id, leader, pos, lvl) GROUP BY 1, 2),
  p{k} AS (SELECT doc_id, leader, n, representative, first, first_seen, last_seen, mean_length, dominant, round(least(1, mean + least(n / 10.0, 0.3) + CASE dominant WHEN 'error' THEN 0.2 WHEN 'warning' THEN 0.1 ELSE 0 END)::DOUBLE, 5) AS importance FROM (SELECT *, {_DOMINANT_SQL} AS dominant FROM g{k}))"""


def _merged(k: int, threshold: float) -> str:
    """CTE m<k+1>: the clusters of m<k> merged in order of their importance."""
    return f"""{_heads(f'h{k + 1}', f'p{k}', 'leader', 'importance DESC, first', threshold)},
  j{k + 1} AS (SELECT doc_id, leader, list_filter(heads, lambda l: {_alike('l', 'leader', threshold)})[1] AS merged FROM p{k} JOIN h{k + 1} USING (doc_id)), m{k + 1} AS (SELECT doc_id, norm, merged AS leader FROM m{k} JOIN j{k + 1} USING (doc_id, leader))"""


def _lines(spark, sf_dir):
    return I.log_lines(spark, sf_dir).select("doc_id", "pos", "lvl", "message", "ts_text", T.normalize_log_cluster(F.col("message")).alias("norm"))


def named(lines, threshold: float):
    """``lines`` with ``leader``, the pattern of the cluster that each belongs to."""
    return lines.join(clustering.leaders(lines, "doc_id", "pos", "norm", threshold).select("doc_id", "norm", "leader"), ["doc_id", "norm"])


def profiles(lines):
    """A row for each cluster of ``lines`` (doc_id, leader, pos, lvl, message, ts_text): size, levels, best entry and importance, by scores among its own entries."""
    keys = ["doc_id", "leader"]
    g = scores(lines, keys).groupBy(keys).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean"),
        F.min_by("message", F.struct(-F.col("score"), "pos")).alias("representative"),
        F.min("pos").alias("first"),
        F.min("ts_text").alias("first_seen"),
        F.max("ts_text").alias("last_seen"),
        F.round(F.avg(F.length("message")), 6).alias("mean_length"),
        *[F.count_if(F.col("lvl") == x).alias(x) for x in _LEVELS],
    )
    most, dominant = F.greatest(*_LEVELS), F.lit(None).cast("string")
    for x in reversed(_LEVELS):
        dominant = F.when(F.col(x) == most, x).otherwise(dominant)
    g = g.withColumn("dominant", dominant)
    bonus = F.when(F.col("dominant") == "error", 0.2).when(F.col("dominant") == "warning", 0.1).otherwise(0.0)
    importance = F.round(F.least(F.lit(1.0), F.col("mean") + F.least(F.col("n") / 10, F.lit(0.3)) + bonus), 5)
    return g.select(*keys, "n", "representative", "first", "first_seen", "last_seen", "mean_length", "dominant", importance.alias("importance"))


def merged(clusters, threshold: float):
    """(doc_id, leader, merged): the cluster that each of ``clusters`` (doc_id, leader, importance, first) goes to; the more important ones lead."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("importance"), "first"))
    told = clustering.leaders(clusters.select("doc_id", F.col("leader").alias("norm"), rank.alias("pos")), "doc_id", "pos", "norm", threshold)
    return told.select("doc_id", F.col("norm").alias("leader"), F.col("leader").alias("merged"))


@query("cluster_logs", f"WITH {_clustered(0.7)} SELECT doc_id, norm, first, n, leader FROM m0")
def cluster_logs(spark, sf_dir):
    return clustering.leaders(_lines(spark, sf_dir), "doc_id", "pos", "norm")


@query("cluster_summary", f"WITH {_clustered(0.7)}, {_profiled(0)} SELECT doc_id, count(*) AS clusters, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, " + ", ".join(f"count(*) FILTER (dominant = '{x}') AS {x}" for x in _LEVELS) + " FROM p0 GROUP BY 1")
def cluster_summary(spark, sf_dir):
    """Clusters of each document: how many, the largest, those of one entry, and how many each level dominates."""
    p = profiles(named(_lines(spark, sf_dir), 0.7))
    return p.groupBy("doc_id").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), *[F.count_if(F.col("dominant") == x).alias(x) for x in _LEVELS])


@query("cluster_profiles", f"WITH {_clustered(0.7)}, {_profiled(0)} SELECT * FROM p0")
def cluster_profiles(spark, sf_dir):
    return profiles(named(_lines(spark, sf_dir), 0.7))


@query("cluster_reps", f"WITH {_clustered(0.7)}, {_profiled(0)} SELECT doc_id, leader, pos, score FROM s0 QUALIFY row_number() OVER (PARTITION BY doc_id, leader ORDER BY score DESC, pos) <= 2")
def cluster_reps(spark, sf_dir):
    """The two best entries of each cluster."""
    x = scores(named(_lines(spark, sf_dir), 0.7), ["doc_id", "leader"])
    r = F.row_number().over(Window.partitionBy("doc_id", "leader").orderBy(F.desc("score"), "pos"))
    return x.withColumn("r", r).where("r <= 2").select("doc_id", "leader", "pos", "score")


@query("merge_clusters", f"WITH {_clustered(0.9)}, {_profiled(0)}, {_merged(0, 0.8)} SELECT doc_id, leader, merged FROM j1")
def merge_clusters(spark, sf_dir):
    """Clusters at 0.9 whose patterns are alike at 0.8 merged, in order of their importance."""
    return merged(profiles(named(_lines(spark, sf_dir), 0.9)), 0.8)


_LEVEL_SQL = "SELECT doc_id, {k} AS level, count(*) AS clusters, max(n) AS largest FROM p{k} GROUP BY 1"


@query("hierarchical_clusters", f"WITH {_clustered(0.9)}, {_profiled(0)}, {_merged(0, 0.75)}, {_profiled(1)}, {_merged(1, 0.6)}, {_profiled(2)} " + " UNION ALL ".join(_LEVEL_SQL.format(k=k) for k in range(3)))
def hierarchical_clusters(spark, sf_dir):
    """Clusters at 0.9, merged at 0.75 and again at 0.6: (doc_id, level, clusters, largest)."""
    now, out = named(_lines(spark, sf_dir), 0.9), None
    for level, threshold in enumerate((None, 0.75, 0.6)):
        if threshold:
            now = now.join(merged(p, threshold), ["doc_id", "leader"]).drop("leader").withColumnRenamed("merged", "leader")
        p = profiles(now)
        told = p.groupBy("doc_id").agg(F.count("*").alias("clusters"), F.max("n").alias("largest")).withColumn("level", F.lit(level))
        out = told if out is None else out.unionByName(told)
    return out


_ODD = "CASE lvl WHEN 'error' THEN 'segmentation fault (core dumped) in worker ' || user_id ELSE message END"


@query("log_outliers", f"WITH {D.LOG_LINES}, lines AS (SELECT doc_id, pos, lvl, trim({D.rewrite(f'lower({_ODD})', R.LOG_CLUSTER)}) AS norm FROM log_lines), d0 AS (SELECT doc_id, norm, min(pos) AS first FROM lines WHERE lvl <> 'error' GROUP BY 1, 2), {_heads('h', 'd0', 'norm', 'first', 0.7)} SELECT doc_id, pos, norm FROM lines LEFT JOIN h USING (doc_id) WHERE coalesce(list_max(list_transform(heads, lambda l: 1 - levenshtein(l, norm) / CAST(greatest(length(l), length(norm), 1) AS DOUBLE))), 0) < 0.5")
def log_outliers(spark, sf_dir):
    """Entries that are half like none of the patterns of their document's entries of other levels than error."""
    x = I.log_lines(spark, sf_dir)
    message = F.when(F.col("lvl") == "error", F.concat(F.lit("segmentation fault (core dumped) in worker "), "user_id")).otherwise(F.col("message"))
    x = x.select("doc_id", "pos", "lvl", T.normalize_log_cluster(message).alias("norm"))
    return outliers(x, clustering.leaders(x.where("lvl <> 'error'"), "doc_id", "pos", "norm"))


def outliers(lines, clusters, threshold: float = 0.5):
    """``lines`` (doc_id, pos, norm) whose best similarity to the patterns of their document's clusters is under ``threshold``; all of a document without clusters.

    Each distinct text is compared with the patterns once, in its own row, so nothing is paired across rows.
    """
    patterns = clusters.groupBy("doc_id").agg(F.collect_set("leader").alias("patterns"))
    texts = lines.select("doc_id", "norm").distinct().join(patterns, "doc_id", "left")
    best = F.coalesce(F.array_max(F.transform("patterns", lambda p: clustering.similarity(p, F.col("norm")))), F.lit(0.0))
    return lines.join(texts.where(best < threshold).select("doc_id", "norm"), ["doc_id", "norm"]).select("doc_id", "pos", "norm")
