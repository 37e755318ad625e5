"""State that outlives a query: remembered rows by key, in versions of a Parquet table, and the configuration of outputs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir


class MemoryTable:
    """Rows by key, such as conversations' memories. Each change writes a new version; a version once written is never changed.

    Rows of a key that is set again are replaced. Readers of an older version are not disturbed.
    """

    def __init__(self, spark: SparkSession, key: str, path: str | None = None):
        self.spark, self.key, self.path, self.version = spark, key, path or work_dir(spark, "memory"), 0
        self.schema = None

    def get(self) -> DataFrame | None:
        """All rows; None before anything has been set."""
        return None if self.schema is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def _write(self, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{self.path}/v{self.version + 1}")
        self.version, self.schema = self.version + 1, df.schema
        return self.get()

    def set(self, rows: DataFrame) -> DataFrame:
        """The table with ``rows``, one for each key."""
        held = self.get()
        return self._write(rows if held is None else held.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def has(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key) with ``known``."""
        held = self.get()
        if held is None:
            return keys.withColumn("known", F.lit(False))
        return keys.join(held.select(self.key, F.lit(True).alias("known")), self.key, "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def clear(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The table without the rows of ``keys``, or without any."""
        held = self.get()
        if held is None:
            return None
        return self._write(held.limit(0) if keys is None else held.join(keys.select(self.key), self.key, "left_anti"))


@dataclass(frozen=True)
class Output:
    mode: str = "plain"
    verbosity: str = "normal"
    use_toon: bool = False
    include_stats: bool = True


class OutputConfig:
    """The one configuration of a session's outputs: get, set some of it, reset."""

    MODES, VERBOSITIES = ("plain", "markdown", "json", "toon"), ("minimal", "normal", "detailed")

    def __init__(self) -> None:
        self.now = Output()

    def set(self, **changes: object) -> Output:
        made = replace(self.now, **changes)
        if made.mode not in self.MODES or made.verbosity not in self.VERBOSITIES:
            raise ValueError(f"no such output: {made}")
        self.now = made
        return made

    def reset(self) -> Output:
        self.now = Output()
        return self.now

    @property
    def toon(self) -> bool:
        return self.now.use_toon or self.now.mode == "toon"
