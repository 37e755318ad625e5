"""Scalar text functions, Column to Column: normalisers, tests, tokens, levels and detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

#: An ASCII word boundary: Java's own takes letters with accents for word characters at boundaries but not in \w.
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A pattern of the shared dialect as Java takes it: ASCII boundaries, and ``$`` that means the very end unless lines are asked for."""
    out = pattern.replace(r"\b", _B)
    return out if "(?m" in out else out.replace(r"\$", "\0").replace("$", r"\z").replace("\0", r"\$")


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, java(pattern), to)
    return c


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(java(p))
    return out


def space_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def normalize_error(c: Column) -> Column:
    return F.trim(rewrite(c, R.NORMALIZE_ERROR))


def normalize_log_grouping(c: Column) -> Column:
    return F.trim(F.lower(rewrite(c, R.LOG_GROUPING)))


def normalize_log_pattern(c: Column) -> Column:
    return F.trim(rewrite(F.lower(c), R.LOG_PATTERN))


def normalize_log_cluster(c: Column) -> Column:
    return F.trim(rewrite(F.lower(c), R.LOG_CLUSTER))


def normalize_log_line(c: Column) -> Column:
    return F.trim(rewrite(c, R.LOG_LINE))


def normalize_generic(c: Column) -> Column:
    return F.trim(rewrite(c, R.GENERIC_LINE))


def log_template(c: Column) -> Column:
    return rewrite(c, R.TEMPLATE)


def normalize_command(c: Column) -> Column:
    return F.trim(rewrite(c, R.COMMAND))


def normalize_http_path(c: Column) -> Column:
    return rewrite(c, R.HTTP_PATH)


def first_token(c: Column) -> Column:
    token = F.regexp_extract(F.trim(rewrite(c, R.FIRST_TOKEN)), r"^\w+", 0)
    return F.when(token == "", "unknown").otherwise(F.lower(token))


def bm25_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+"), lambda x: F.length(x) >= 2)


def tfidf_tokens(c: Column) -> Column:
    return F.filter(bm25_tokens(c), lambda x: ~x.isin(R.STOPWORDS))


def log_level(c: Column) -> Column:
    out = F.lit("info")
    for level, pattern in reversed(R.LOG_LEVELS):
        out = F.when(c.rlike(java(pattern)), level).otherwise(out)
    return out


def log_timestamp(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, java(p), g), F.lit("")) for p, g in R.TIMESTAMPS])


def log_message(c: Column) -> Column:
    """A line without its timestamp, level and leading brackets; the whole line if nothing is left."""
    line, ts = F.trim(c), log_timestamp(F.trim(c))
    at = F.locate(ts, line) if isinstance(ts, str) else F.position(ts, line)
    cut = F.when(ts.isNull(), line).otherwise(F.trim(F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(ts), F.length(line)))))
    cut = F.trim(F.regexp_replace(cut, r"(?i)^\[?\s*(ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL)\s*\]?\s*[-:.]?\s*", ""))
    cut = F.trim(F.regexp_replace(cut, r"^[\[\]\-:]+\s*", ""))
    return F.when(cut == "", line).otherwise(cut)


def token_count(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def position_score(i: Column, n: Column, boost: int = 5) -> Column:
    end = n - 1 - i
    middle = (i - boost) / F.nullif((n - 2 * boost).cast("double"), F.lit(0.0))
    return F.when(n <= 1, 1.0).when(i < boost, 1 - i / boost * 0.3).when(end < boost, 0.7 + (1 - end / boost) * 0.3).otherwise(0.3 + 0.8 * F.abs(middle - 0.5))


def position_weight(p: Column) -> Column:
    return F.when((p <= 0.1) | (p >= 0.9), 1.0).when((p <= 0.2) | (p >= 0.8), 0.85).when((p <= 0.3) | (p >= 0.7), 0.7).otherwise(0.6)


def keyword_boost(c: Column) -> Column:
    total = F.lit(0.0)
    for weight, pattern in R.KEYWORD_BOOST:
        total = total + F.when(c.rlike(java(pattern)), weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def keyword_score(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("|".join(R.HIGH_WORDS)), 1.0).when(low.rlike("|".join(R.MEDIUM_WORDS)), 0.7).when(c.rlike(r"(?i)at\s+\w+|file\s*:|line\s*\d+|traceback"), 0.8).otherwise(0.3)


def level_score(level: Column) -> Column:
    out = F.lit(0.3)
    for name, score in R.LEVEL_SCORES.items():
        out = F.when(level == name, score).otherwise(out)
    return out


def base_command(c: Column) -> Column:
    parts = F.split(F.trim(c), r"\s+")
    return F.when(parts[0].isin(R.PACKAGE_MANAGERS), F.array_join(F.slice(parts, 1, 2), " ")).otherwise(parts[0])


def common_retry(c: Column) -> Column:
    low, out = F.lower(normalize_command(c)), F.lit(False)
    for command in R.RETRY_COMMANDS:
        out = out | low.startswith(command)
    return out


def command_type(c: Column) -> Column:
    low, out = F.lower(c), F.lit("command")
    for tool in ("cargo", "go"):
        out = F.when(low.rlike(tool + r"\s+(build|test|check)" if tool == "cargo" else tool + r"\s+(build|test)"), F.when(low.contains("test"), "test").otherwise("build")).otherwise(out)
    for kind, pattern in reversed(R.COMMAND_TYPES):
        out = F.when(low.rlike(java(pattern)), kind).otherwise(out)
    return out


def detect_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.EXTENSIONS.items() for x in kv]), ext), F.lit("unknown"))


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), F.floor((ms % 60_000) / 1000).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit("h "), F.floor((ms % 3_600_000) / 60_000).cast("string"), F.lit("m")))
    )


def glob_regex(glob: str) -> str:
    """An anchored pattern of a path glob: ``{a,b}``, ``**/``, ``**``, ``*`` within a name, ``?``."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        depth += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": ".", ".": r"\.", "{": "(", "}": ")"}.get(c, "|" if c == "," and depth else c)
        k += 1
    return f"^{out}\\z"
