"""Tables of Parquet files, spread over all cores where their files are few."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables under this size are left as they are: dealing their rows out costs more than it brings.
SPREAD_BYTES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt out to as many partitions as there are cores if it comes from fewer files: a file of one row group is one task's work.

    Tables that make a full partition for each core, as all large ones, are returned as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    full = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")))
    if size < SPREAD_BYTES or size >= cores * full or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
