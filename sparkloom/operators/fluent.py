"""A lazy, immutable pipeline builder over DataFrames: steps are recorded, and ``build`` compiles them to one plan.

Rows carry an order column; every step that depends on order names it. Predicates and mappings are Columns, so that Catalyst sees them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class EmptyPipelineError(ValueError):
    """A pipeline without a source was built."""


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """``source`` and the steps so far; each method returns a new pipeline."""

    source: DataFrame | None = None
    steps: tuple[Step, ...] = ()
    order: str = "pos"

    @staticmethod
    def from_data(spark: SparkSession, rows: list, schema: str, order: str = "pos") -> Pipeline:
        return Pipeline(spark.createDataFrame(rows, schema), (), order)

    @staticmethod
    def of(df: DataFrame, order: str = "pos") -> Pipeline:
        return Pipeline(df, (), order)

    def _with(self, name: str, run: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return replace(self, steps=(*self.steps, Step(name, run)))

    def filter(self, predicate: Column) -> Pipeline:
        return self._with("filter", lambda df: df.filter(predicate))

    def exclude(self, column: str, pattern: str) -> Pipeline:
        """Drop rows whose column holds the pattern, in which ``*`` is any text."""
        rx = ".*".join(_quote(p) for p in pattern.split("*"))
        return self._with("exclude", lambda df: df.filter(~F.col(column).rlike(rx)))

    def map(self, **columns: Column) -> Pipeline:
        return self._with("map", lambda df: df.withColumns(columns))

    def flat_map(self, name: str, array: Column) -> Pipeline:
        return self._with("flat_map", lambda df: df.withColumn(name, F.explode(array)))

    def reduce(self, **aggregates: Column) -> Pipeline:
        return self._with("reduce", lambda df: df.agg(*[c.alias(k) for k, c in aggregates.items()]))

    def take(self, n: int) -> Pipeline:
        return self._with("take", lambda df: df.orderBy(self.order).limit(n))

    def skip(self, n: int) -> Pipeline:
        return self._with("skip", lambda df: df.orderBy(self.order).offset(n))

    def sort(self, by: str, ascending: bool = True) -> Pipeline:
        """By a column, ties by the order column; binary order of strings."""
        return self._with("sort", lambda df: df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), self.order))

    def unique(self, *keys: str) -> Pipeline:
        """The first row of each key, or of each whole row without the order column."""

        def run(df: DataFrame) -> DataFrame:
            by = keys or tuple(c for c in df.columns if c != self.order)
            return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(self.order))).where("_r = 1").drop("_r")

        return self._with("unique", run)

    def tap(self, observation: Observation, *metrics: Column) -> Pipeline:
        return self._with("tap", lambda df: df.observe(observation, *metrics))

    def recover(self, otherwise: Callable[[Exception], DataFrame]) -> Pipeline:
        """If the step just before fails while the plan is made, its result is ``otherwise(error)``."""
        if not self.steps:
            return self
        last = self.steps[-1]

        def run(df: DataFrame) -> DataFrame:
            try:
                return last.run(df)
            except Exception as e:  # noqa: BLE001  whatever the caller's step raises is the caller's to handle
                return otherwise(e)

        return replace(self, steps=(*self.steps[:-1], Step(f"{last.name}+recover", run)))

    # Sources and steps over files: rows (pos, path), with content once they are read.

    @staticmethod
    def glob(spark: SparkSession, root: str, pattern: str) -> Pipeline:
        """The files under ``root`` whose path fits, in order of their paths."""
        from ..sources.files import scan_files

        listed = scan_files(spark, root, pattern).select(F.col("path").alias("pos"), "path", F.lit(root).alias("root"), "length")
        return Pipeline(listed, ())

    def read(self) -> Pipeline:
        """``content`` and ``error`` of each file; an error instead of content where a file is too large or can't be read."""
        from ..sources.files import read_files

        def run(df: DataFrame) -> DataFrame:
            roots = [r.root for r in df.select("root").distinct().limit(2).collect()]
            if len(roots) > 1:
                raise ValueError("read() takes the files of one root")
            read = read_files(df.sparkSession, roots[0], ["**"]) if roots else None
            return df.join(read, "path", "left") if read is not None else df.withColumns({"content": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})

        return self._with("read", run)

    def parse(self, language: str | None = None) -> Pipeline:
        """A row for each element of each file; without ``language`` a file's ending tells it. ``pos`` is (path, line)."""
        from ..functions import text as T
        from ..ship import ship
        from .code import parse_code

        def run(df: DataFrame) -> DataFrame:
            ship(df.sparkSession)
            files = df.select("path", "content", (F.lit(language) if language else T.detect_language(F.col("path"))).alias("language"))
            return parse_code(files).withColumn(self.order, F.struct("path", "start_line", "name"))

        return self._with("parse", run)

    def compress(self, detail: str = "normal") -> Pipeline:
        """One row: all rows, in order, as indented JSON, shortened to the levels that ``detail`` keeps."""
        from ..ship import ship
        from .config import brief_json, column

        def run(df: DataFrame) -> DataFrame:
            ship(df.sparkSession)
            row = F.struct(F.col(self.order).alias("_order"), F.struct(*[c for c in df.columns if c != self.order]).alias("row"))
            rows = df.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]).alias("x"))
            return rows.select(column(brief_json, F.to_json("x"), detail).alias("compressed"))

        return self._with("compress", run)

    def steps_of(self, steps: list[dict]) -> Pipeline:
        """The pipeline that a list of steps tells: each a dictionary of one step's name and its argument, or a list of arguments."""
        known = {"filter": "filter", "exclude": "exclude", "map": "map", "flatMap": "flat_map", "limit": "take", "take": "take", "skip": "skip", "sort": "sort", "unique": "unique", "read": "read", "parse": "parse", "compress": "compress", "reduce": "reduce"}
        out = self
        for step in steps:
            if len(step) != 1 or next(iter(step)) not in known:
                raise ValueError(f"no such step: {step}")
            (name, given), = step.items()
            run = getattr(out, known[name])
            if isinstance(given, dict):
                out = run(**given)
            elif given is True or given is None:
                out = run()
            else:
                out = run(*given) if isinstance(given, list | tuple) else run(given)
        return out

    def run(self) -> tuple[DataFrame, Callable[[], dict]]:
        """(result, stats): ``stats()``, once the result has been computed, tells the steps, the rows and the seconds since the call."""
        began, seen = time.time(), Observation()
        df = self.build().observe(seen, F.count(F.lit(1)).alias("items"))
        return df, lambda: {"steps": len(self.steps), "items": seen.get["items"], "seconds": time.time() - began}

    def get_steps(self) -> list[str]:
        return [s.name for s in self.steps]

    def build(self) -> DataFrame:
        if self.source is None:
            raise EmptyPipelineError("EMPTY_PIPELINE")
        df = self.source
        for s in self.steps:
            df = s.run(df)
        return df


def _quote(text: str) -> str:
    return "".join("\\" + c if c in ".+?^${}()|[]\\" else c for c in text)


class Memo:
    """Results by key, kept for ``seconds`` and at most ``most`` of them; the oldest go first. Keep DataFrames that were persisted or written."""

    def __init__(self, seconds: float = 300.0, most: int = 100):
        self.seconds, self.most = seconds, most
        self.held: dict[str, tuple[float, object]] = {}

    def get(self, key: str, make: Callable[[], object]) -> object:
        now = time.monotonic()
        if key in self.held and now - self.held[key][0] <= self.seconds:
            return self.held[key][1]
        value = make()
        self.held.pop(key, None)
        while len(self.held) >= self.most:
            del self.held[next(iter(self.held))]
        self.held[key] = (now, value)
        return value


def overview(files: Pipeline) -> DataFrame:
    """Preset: files and lines of each language."""
    from ..functions import text as T

    x = files.build()
    return x.groupBy(T.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))


def usages(files: Pipeline, symbol: str) -> DataFrame:
    """Preset: (path, line, kind, context) of the lines that name ``symbol``: where it is defined, or used; at most one row a line."""
    from ..functions import text as T

    rows = files.build().select("path", F.posexplode(F.split("content", "\n")).alias("line", "t")).withColumn("line", F.col("line") + 1)
    name = _quote(symbol)
    define = T.java(rf"\b(function|class|interface|type|const|let|var|def|fn|func|struct)\s+{name}\b")
    kind = F.when(F.col("t").rlike(define), "definition").when(F.col("t").rlike(T.java(rf"\b{name}\b")), "usage")
    return rows.select("path", "line", kind.alias("kind"), F.substring(F.trim("t"), 1, 100).alias("context")).where("kind is not null")


def signatures(files: Pipeline) -> DataFrame:
    """Preset: (path, name, signature) of exported functions."""
    x = files.parse().build()
    return x.where("bucket = 'functions' and exported").select("path", "name", F.col("detail").alias("signature"))


def dead_code(files: Pipeline) -> DataFrame:
    """Preset: (path, name) of exported elements that no other file names."""
    from .multifile import unnamed_elsewhere

    names = files.parse().build().where("exported and bucket <> 'imports'").select("path", "name").distinct()
    words = files.build().select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return unnamed_elsewhere(names, words)


PRESETS = {"overview": overview, "usages": usages, "signatures": signatures, "dead_code": dead_code}
