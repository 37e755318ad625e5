"""Helpers shared by the operators: materialised intermediate tables, row keys, and joins that a frequent key doesn't slow down."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of longs may be broadcast up to this size in memory, where a row takes about ROW_BYTES and 16 bytes a column. Beyond it joins shuffle.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 32
#: Of the keys of a join, those with more than 1 / HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are joined by broadcast.
HOT_KEYS, HOT_LEAST = 20_000, 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the setting is missing, as in tests on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scopes = threading.local()


def _scope() -> list[list[DataFrame]]:
    if not hasattr(_scopes, "held"):
        _scopes.held = []
    return _scopes.held


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    for scope in _scope()[-1:]:
        scope.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._table)


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, with which broadcasts of finished steps go everywhere, then each executor's: a heap that a finished step has filled goes back to the system."""
    spark._jvm.java.lang.System.gc()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        n = spark.sparkContext.defaultParallelism  # a task for each core
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def owned(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``make`` with its result materialised, after which all tables that it materialised on the way are deleted."""

    @wraps(make)
    def run(*args: Any, **options: Any) -> DataFrame:
        _scope().append([])
        try:
            out = make(*args, **options)
            out = out if hasattr(out, "_table") else materialize(out)
        finally:
            made = _scope().pop()
        discard(*[t for t in made if t._table != out._table])
        collect_garbage(out.sparkSession)
        for scope in _scope()[-1:]:
            scope.append(out)
        return out

    return run


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def record_id(doc_id: str, text: str) -> Column:
    """The row's id; a null id is replaced by a negative number made from the text, the same on every attempt."""
    return F.coalesce(F.col(doc_id).cast("long"), -F.abs(F.shiftrightunsigned(F.xxhash64(F.col(text), F.lit("null id")), 1)) - 1)


def small(table: DataFrame) -> DataFrame:
    """``table``, a few columns of longs, marked for broadcast if a count shows that it has at most BROADCAST_BYTES; else as it is, to be shuffled."""
    most = BROADCAST_BYTES // (ROW_BYTES + 16 * len(table.columns))
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``, which has one column of the same name."""
    return df.join(small(ids), key, "left_semi")


def by_key(rows: DataFrame, table: DataFrame, keys: list[str], count: str, whole: bool = True) -> DataFrame:
    """``rows`` joined with ``table`` (keys, count, ...), materialised, which has a row for each key and counts the rows of each.

    A small table is broadcast whole, unless ``whole`` is false. Of a larger one, keys that hold a large share of the rows are joined by broadcast: there are fewer than HOT_KEYS of them, whatever the size of the
    tables. For the others no task holds much more than an even share.
    """
    if whole and (few := small(table)) is not table:
        return rows.join(few, keys)
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(count) > least))
    if hot.isEmpty():
        return rows.join(table, keys)
    cold = rows.join(hot, keys, "left_anti").join(table.where(F.col(count) <= least), keys)
    return cold.unionByName(rows.join(hot, keys))


def lean(table: DataFrame, size: str, width: int) -> DataFrame:
    """``table``, with an array of ``size`` elements of ``width`` bytes in each row, marked for broadcast if sums show that it has at most BROADCAST_BYTES; else as it is."""
    n, total = table.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(table) if n * (ROW_BYTES + 64) + (total or 0) * width <= BROADCAST_BYTES else table
