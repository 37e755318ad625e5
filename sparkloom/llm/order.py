"""Cutting a table into ranges of a key, each a task's work, for operators that need a row's neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a range holds on average, and the most ranges of that size; beyond so many rows ranges grow with the square root of the table,
#: so that neither the list of bounds nor a task's share grows as fast as the table.
RANGE_ROWS, MANY_RANGES = 1_000, 4_096
_GROUP = 128


def n_ranges(rows: int) -> int:
    """Ranges for so many rows: of RANGE_ROWS each, up to MANY_RANGES of them; beyond that they grow in number and in size alike."""
    most = MANY_RANGES * RANGE_ROWS
    return max(1, rows // RANGE_ROWS) if rows <= most else int(MANY_RANGES * (rows / most) ** 0.5)


def range_bounds(df: DataFrame, key: str) -> list[int]:
    """Ascending values of ``key`` that occur in ``df``, the smallest first: ranges of about equal rows begin at them."""
    rows, least = df.agg(F.count("*"), F.min(key)).first()
    if not rows:
        return []
    parts = n_ranges(rows)
    cuts = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    return sorted({least, *(int(x) for x in cuts)})


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``: found in two steps, among groups of bounds and within one."""
    groups = [bounds[k : k + _GROUP] for k in range(0, len(bounds), _GROUP)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= key))
    return F.transform(F.array(group), lambda g: (g - 1) * _GROUP + F.size(F.filter(F.element_at(table, F.greatest(g, F.lit(1))), lambda b: b <= key)))[0]
