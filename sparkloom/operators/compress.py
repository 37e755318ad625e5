"""Compressors of texts as tables of lines: repeated lines are told once, with their number.

``lines`` are rows (key, pos, raw), a row for each line of a text. Every compressor returns (key, compressed). Lines are grouped by partial aggregates and
never compared with each other, so the work grows with the number of lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

#: Lines of one shape that are still shown, by detail.
SHOWN = {"minimal": 2, "normal": 3, "detailed": 5}


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, raw): the lines of each text, numbered from 0; null has none."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))


def joined(df: DataFrame, key: str, order: list[str | Column], text: str, name: str) -> DataFrame:
    """(key, name): the texts of each key in order, a line feed between them."""
    row = F.struct(*order, F.col(text).alias("_t"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_t"]), "\n").alias(name))


def note(n: Column, what: Column) -> Column:
    return F.concat(F.lit("\n  ... ("), n, F.lit(" "), what, F.lit(")"))


def log_level(raw: Column) -> Column:
    """The first of the levels that stands in brackets or between blanks."""
    up, out = F.upper(raw), F.lit(None).cast("string")
    for level in reversed(R.LINE_LEVELS):
        out = F.when(up.contains(f"[{level}]") | up.contains(f" {level} "), level).otherwise(out)
    return out


def log_groups(lines: DataFrame, key: str) -> DataFrame:
    """(key, norm, p, sample, n, e, w): lines of one shape, their first line, and whether that is an error or a warning. Blank lines are left out."""
    x = lines.where(F.trim("raw") != "").withColumn("norm", T.normalize_log_line(F.col("raw"))).withColumn("level", log_level(F.col("raw")))
    first = lambda c: F.coalesce(F.min_by(c, "pos"), F.lit(False))
    return x.groupBy(key, "norm").agg(
        F.min("pos").alias("p"),
        F.min_by("raw", "pos").alias("sample"),
        F.count("*").alias("n"),
        first(F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False))).alias("e"),
        first(F.coalesce(F.col("level").isin("WARN", "WARNING"), F.lit(False))).alias("w"),
    )


def logs(lines: DataFrame, key: str, detail: str = "normal") -> DataFrame:
    """A line for each shape and the number of others like it: errors first, then warnings, then by number; ties by place."""
    g = log_groups(lines, key)
    many = ~F.col("e") & ~F.col("w") & (F.col("n") > SHOWN[detail])
    told = F.concat("sample", F.when(F.col("n") > 1, note(F.col("n") - 1, F.when(many, "similar entries omitted").otherwise("similar entries"))).otherwise(""))
    g = g.withColumn("line", told).withColumns({"a": ~F.col("e"), "b": ~F.col("w"), "c": -F.col("n")})
    return joined(g, key, ["a", "b", "c", "p"], "line", "compressed")


def without_repeats(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, pos, sub, raw): of ``least`` or more lines of one shape in a row, the first and a note with the number of the others."""
    order = Window.partitionBy(key).orderBy("pos")
    x = lines.withColumn("norm", T.normalize_generic(F.col("raw")))
    fresh = (F.lag("norm").over(order).isNull() | (F.col("norm") != F.lag("norm").over(order))).cast("int")
    x = x.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    x = x.withColumn("m", F.count("*").over(Window.partitionBy(key, "run")))
    line = F.struct(F.lit(0).alias("sub"), F.col("raw").alias("raw"))
    more = F.struct(F.lit(1).alias("sub"), F.concat(F.lit("  ... (repeated "), F.col("m") - 1, F.lit(" more times)")).alias("raw"))
    kept = x.where((F.col("m") < least) | (F.col("fresh") == 1))
    return kept.select(key, "pos", F.explode(F.when(F.col("m") < least, F.array(line)).otherwise(F.array(line, more))).alias("x")).select(key, "pos", "x.sub", "x.raw")


def generic(lines: DataFrame, key: str, detail: str = "normal") -> DataFrame:
    """Runs of one shape told once, then lines of one shape together where the shape first stands: all of them if few, else the first and a number."""
    most = SHOWN[detail]
    x = without_repeats(lines, key).where(F.trim("raw") != "").withColumn("norm", T.normalize_generic(F.col("raw"))).withColumn("at", F.struct("pos", "sub"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy(key, "norm").orderBy("at")))
    error, warning = (F.bool_or(F.col("raw").rlike(T.java(p))) for p in (R.ERROR_LINE, R.WARNING_LINE))
    g = x.groupBy(key, "norm").agg(F.min("at").alias("p"), F.count("*").alias("n"), error.alias("e"), warning.alias("w"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("at", "raw")))).alias("few"))
    what = F.when(F.col("e"), "similar errors").when(F.col("w"), "similar warnings").otherwise("similar lines omitted")
    told = F.when(F.col("n") <= most, F.array_join(F.transform("few", lambda v: v["raw"]), "\n")).otherwise(F.concat(F.col("few")[0]["raw"], note(F.col("n") - 1, what)))
    return joined(g.withColumn("line", told), key, ["p"], "line", "compressed")


def internal_runs(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with inside (a frame of a library or the runtime) and run, a number that consecutive inside lines share."""
    inside = F.coalesce(F.col("raw").rlike(r"^\s+at\s") & T.any_of(F.col("raw"), R.INTERNAL_FRAME), F.lit(False))
    order = Window.partitionBy(key).orderBy("pos")
    x = lines.withColumn("inside", inside)
    fresh = (~(F.col("inside") & F.coalesce(F.lag("inside").over(order), F.lit(False)))).cast("int")
    return x.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))


def stacktrace(lines: DataFrame, key: str) -> DataFrame:
    """Each run of internal frames as one line with their number; all else as it is."""
    g = internal_runs(lines, key).groupBy(key, "run").agg(F.min("pos").alias("p"), F.count("*").alias("n"), F.min_by("raw", "pos").alias("raw"), F.bool_and("inside").alias("inside"))
    line = F.when(F.col("inside"), F.concat(F.lit("    ... ("), "n", F.lit(" internal frames omitted)"))).otherwise(F.col("raw"))
    return joined(g.withColumn("line", line), key, ["p"], "line", "compressed")


def error_groups(lines: DataFrame, key: str) -> DataFrame:
    """Lines made alike by places, quoted parts and numbers: the first of each shape with its number, the commonest first, under a line with the totals."""
    x = lines.where(F.trim("raw") != "").withColumn("norm", T.normalize_error(F.col("raw")))
    g = x.groupBy(key, "norm").agg(F.min("pos").alias("p"), F.min_by("raw", "pos").alias("sample"), F.count("*").alias("n"))
    g = g.withColumn("c", -F.col("n")).withColumn("line", F.concat("sample", F.when(F.col("n") > 1, F.concat(F.lit(" (x"), "n", F.lit(")"))).otherwise("")))
    totals = g.groupBy(key).agg(F.sum("n").alias("lines"), F.count("*").alias("shapes"))
    head = F.concat("lines", F.lit(" lines -> "), "shapes", F.lit(" unique patterns ("), F.col("lines") - F.col("shapes"), F.lit(" duplicates removed)\n\n"))
    return joined(g, key, ["c", "p"], "line", "body").join(totals, key).select(key, F.concat(head, F.col("body")).alias("compressed"))


def hunks(lines: DataFrame, key: str, around: int = 1) -> DataFrame:
    """A diff's headers and its changed lines with ``around`` lines before and after each."""
    changed = F.col("raw").rlike(r"^[+-]")
    near = F.max(changed.cast("int")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)) == 1
    return joined(lines.withColumn("near", near | F.col("raw").rlike(r"^(diff|@@)")).where("near"), key, ["pos"], "raw", "compressed")


# The same for texts as Columns: a text's lines are sorted by shape within its row, so texts that are rows already are neither taken apart over a shuffle nor joined again.
# Null where no line is left to show.


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _runs(items: Column, differ) -> Column:
    """(lo, n) of each run of ``items``, an array by name, where ``differ`` tells of no two neighbours."""
    place = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(place, lambda i: (i == 0) | F.coalesce(differ(F.get(items, i - 1), F.get(items, i)), F.lit(True)))
    return let(starts, lambda s: F.transform(s, lambda lo, j: F.struct(lo.alias("lo"), (F.coalesce(F.get(s, j + 1), F.size(items)) - lo).alias("n"))))


def _told(rows: Column, line, top=lambda rows, groups: F.lit("")) -> Column:
    """The lines of all shapes of ``rows`` (norm, pos, sub, raw) in order; ``line`` has the struct to sort by of a group (lo, n) of the sorted rows, its last field the text."""
    rows = F.sort_array(F.filter(rows, lambda r: F.trim(r["raw"]) != ""))

    def joined_groups(s: Column) -> Column:
        return let(_runs(s, lambda a, b: a["norm"] != b["norm"]), lambda g: F.concat(top(s, g), F.array_join(F.transform(F.sort_array(F.transform(g, lambda x: line(s, x, F.get(s, x["lo"])))), lambda v: v["line"]), "\n")))

    return let(rows, lambda s: F.when(F.size(s) > 0, joined_groups(s)))


#: What a line must hold for a rule of NORMALIZE_ERROR, in their order, to change it; lower-cased letters mean either case, an empty list any line. A search for a string costs far less than a pattern's.
_ERROR_NEEDS = [[":\\"], ["/"], ["./"], [":"], ["("], ["["], ["line"], ["col"], ["'"], ['"'], ["`"], ["-", ":"], ["/", ":"], [], [], []]
_BLANKS = ["  ", "\t", "\r", "\x0b", "\f"]


def _where_needed(x: Column, pattern: str, to: str, needs: list[str]) -> Column:
    may = F.lit(True)
    for need in needs:
        may = may & (F.lower(x) if need.isalpha() else x).contains(need)
    for mark, part in (("{32,}", "[0-9a-fA-F]{32}"), ("{5,}", "[0-9]{5}")):
        if mark in pattern:
            may = may & x.rlike(part)
    if pattern == r"\s+":
        may = F.lit(False)
        for blank in _BLANKS:
            may = may | x.contains(blank)
    return F.when(may, F.regexp_replace(x, T.java(pattern), to)).otherwise(x)


def _rule(*rule):
    return lambda x: _where_needed(x, *rule)


def _normalized_errors(lines: Column) -> Column:
    """``T.normalize_error`` of each line of an array; a rule is tried where the line holds what it needs."""
    for (pattern, to), needs in zip(R.NORMALIZE_ERROR, _ERROR_NEEDS, strict=True):
        lines = F.transform(lines, _rule(pattern, to, needs))
    return F.transform(lines, lambda x: F.trim(x))


def _rows(c: Column, norm) -> Column:
    return F.transform(F.split(c, "\n", -1), lambda x, i: F.struct(norm(x).alias("norm"), i.alias("pos"), F.lit(0).alias("sub"), x.alias("raw")))


def _error_rows(c: Column) -> Column:
    named = lambda ls: F.transform(F.arrays_zip(_normalized_errors(ls).alias("norm"), ls.alias("raw")), lambda x, i: F.struct(x["norm"].alias("norm"), i.alias("pos"), F.lit(0).alias("sub"), x["raw"].alias("raw")))
    return let(F.split(c, "\n", -1), named)


def error_groups_text(c: Column) -> Column:
    """``error_groups`` of a text."""
    head = lambda s, g: F.concat(F.size(s), F.lit(" lines -> "), F.size(g), F.lit(" unique patterns ("), F.size(s) - F.size(g), F.lit(" duplicates removed)\n\n"))
    line = lambda s, g, x: F.struct((-g["n"]).alias("c"), x["pos"].alias("p"), F.concat(x["raw"], F.when(g["n"] > 1, F.concat(F.lit(" (x"), g["n"], F.lit(")"))).otherwise("")).alias("line"))
    return _told(_error_rows(c), line, head)


def logs_text(c: Column, detail: str = "normal") -> Column:
    """``logs`` of a text."""

    def line(s: Column, g: Column, x: Column) -> Column:
        e, w = (F.coalesce(log_level(x["raw"]).isin(*names), F.lit(False)) for names in (("ERROR", "FATAL"), ("WARN", "WARNING")))
        many = ~e & ~w & (g["n"] > SHOWN[detail])
        told = F.concat(x["raw"], F.when(g["n"] > 1, note(g["n"] - 1, F.when(many, "similar entries omitted").otherwise("similar entries"))).otherwise(""))
        return F.struct((~e).alias("a"), (~w).alias("b"), (-g["n"]).alias("c"), x["pos"].alias("p"), told.alias("line"))

    return _told(_rows(c, T.normalize_log_line), line)


def generic_text(c: Column, detail: str = "normal", least: int = 3) -> Column:
    """``generic`` of a text."""
    most = SHOWN[detail]

    def kept(rows: Column, g: Column) -> Column:
        x = F.get(rows, g["lo"])
        more = F.concat(F.lit("  ... (repeated "), g["n"] - 1, F.lit(" more times)"))
        return F.when(g["n"] < least, F.slice(rows, g["lo"] + 1, g["n"])).otherwise(F.array(x, F.struct(T.normalize_generic(more).alias("norm"), x["pos"].alias("pos"), F.lit(1).alias("sub"), more.alias("raw"))))

    def line(s: Column, g: Column, x: Column) -> Column:
        mine = F.slice(s, g["lo"] + 1, g["n"])
        error, warning = (F.exists(mine, lambda v: v["raw"].rlike(T.java(p))) for p in (R.ERROR_LINE, R.WARNING_LINE))
        what = F.when(error, "similar errors").when(warning, "similar warnings").otherwise("similar lines omitted")
        told = F.when(g["n"] <= most, F.array_join(F.transform(mine, lambda v: v["raw"]), "\n")).otherwise(F.concat(x["raw"], note(g["n"] - 1, what)))
        return F.struct(x["pos"].alias("p"), x["sub"].alias("q"), told.alias("line"))

    without = let(_rows(c, T.normalize_generic), lambda rows: F.flatten(F.transform(_runs(rows, lambda a, b: a["norm"] != b["norm"]), lambda g: kept(rows, g))))
    return _told(without, line)


def counted_text(items: Column) -> Column:
    """``items``, an array of errors' signatures, each with its number, the commonest first; null for none."""
    row = lambda s, x: F.struct((-x["n"]).alias("c"), F.get(s, x["lo"]).alias("item"), x["n"].alias("n"))
    listed = lambda s, g: F.array_join(F.transform(F.sort_array(F.transform(g, lambda x: row(s, x))), lambda v: F.concat(v["item"], F.lit(" x"), v["n"])), "; ")
    told = lambda s: let(_runs(s, lambda a, b: a != b), lambda g: F.concat(F.size(s), F.lit(" errors in "), F.size(g), F.lit(" groups: "), listed(s, g)))
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, told(s)))


def hunks_text(c: Column) -> Column:
    """``hunks`` of a text, with one line around."""

    def near(ls: Column, x: Column, i: Column) -> Column:
        changed = lambda k: F.coalesce(F.get(ls, k).rlike(r"^[+-]"), F.lit(False))
        return changed(i - 1) | changed(i) | changed(i + 1) | x.rlike(r"^(diff|@@)")

    return let(F.split(c, "\n", -1), lambda ls: let(F.filter(ls, lambda x, i: near(ls, x, i)), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n"))))


def _words(line: str) -> list[str]:
    """``T.tfidf_tokens`` of a line."""
    return [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", line.lower(), flags=re.ASCII), flags=re.ASCII) if len(w) >= 2 and w not in _STOPWORDS]


_STOPWORDS = frozenset(R.STOPWORDS)


def most_important(text: str, boosts: list[float], ratio: float) -> str:
    """A text's most important lines that fit ``ratio`` of its tokens, in order; ties by place. A short text, or one of a single line, stays.

    A line counts by its terms that are rare in the text, by its place and by ``boosts``, the weight of its keywords; a line that doesn't fit is skipped.
    """
    lines = text.split("\n")
    if math.ceil(len(text) / 4) < 50 or len(lines) < 2:
        return text
    words = [Counter(_words(line)) for line in lines]
    having, n = Counter(w for ws in words for w in ws), len(lines)
    ranked = []
    for i, (ws, boost) in enumerate(zip(words, boosts, strict=True)):
        size = ws.total()
        rare = min(sum(k / size * math.log(n / having[w]) for w, k in ws.items()) / len(ws) / 2, 1.0) if ws else 0.0
        at = i / n
        place = 1.0 if at <= 0.1 or at >= 0.9 else 0.85 if at <= 0.2 or at >= 0.8 else 0.7 if at <= 0.3 or at >= 0.7 else 0.6
        ranked.append((-round(R.IMPORTANCE["tfidf"] * rare + R.IMPORTANCE["position"] * place + R.IMPORTANCE["keyword"] * boost, 6), i))
    costs = [math.ceil(len(line) / 4) for line in lines]
    room, kept = math.floor(sum(costs) * ratio), []
    for _, i in sorted(ranked):
        if costs[i] <= room:
            kept.append(i)
            room -= costs[i]
    return "\n".join(lines[i] for i in sorted(kept))


def semantic_text(c: Column, ratio: float = 0.5) -> Column:
    """``most_important`` of a text; null for null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, boosts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else most_important(t, b, ratio) for t, b in zip(texts, boosts, strict=True)], dtype=object)

    return run(c, F.transform(F.split(c, "\n", -1), T.keyword_boost))
