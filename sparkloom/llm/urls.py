"""URL filters: rules of host and path, and beyond them gradient-boosted trees on lexical features, trained from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: Labelled rows that the trees are trained on, at most about this many, chosen by a hash of the URL.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.3, 32, 20

#: The rules of the query, (verdict, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule fits its host and all subdomains if the path begins with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features as doubles: lengths, depth, digit ratio, entropy, parameter counts and the shape of the host."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)

    def count(pattern: str, c: Column) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    chars = F.split(text, "")
    entropy = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: F.when(c == "", acc).otherwise(acc - F.transform(F.array((n - F.length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1))), lambda p: p * F.log2(p))[0]),
    )
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count("/", path),
        "labels": count(r"\.", host),
        "hyphens": count("-", host),
        "digit_ratio": count("[0-9]", text) / F.greatest(n, F.lit(1)),
        "path_digits": count("[0-9]", path),
        "entropy": entropy,
        "parameters": count("=", text),
        "fragment": text.contains("#").cast("double"),
        "secure": text.startswith("https:").cast("double"),
        "vowel_ratio": count("[aeiou]", host) / F.greatest(F.length(host), F.lit(1)),
        "extension": path.rlike(r"\.[a-z]+$").cast("double"),
    }


def suffix_part(host: Column, path: Column) -> tuple[Column, Column]:
    """The keys of the rates: host suffix and first path part."""
    return F.concat(F.lit("."), F.element_at(F.split(host, r"\."), -1)), F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))


def with_rates(urls: DataFrame, host: str, path: str, rates: DataFrame | None, prior: float) -> DataFrame:
    """``urls`` with _suffix_rate and _part_rate, the shares of blocked URLs in training by host suffix and by first path part; ``prior`` for one not seen."""
    for name, key in zip(("_suffix_rate", "_part_rate"), suffix_part(F.col(host), F.col(path)), strict=True):
        if rates is None:
            urls = urls.withColumn(name, F.lit(prior))
        else:
            found = small(rates.select(F.col("k").alias("_k"), F.col("rate").alias(name)))
            urls = urls.withColumn("_k", key).join(found, "_k", "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(prior)))
    return urls


def rate_features() -> dict[str, Column]:
    return {"suffix_rate": F.col("_suffix_rate"), "part_rate": F.col("_part_rate")}


@dataclass
class Node:
    """A leaf has a value, an inner node a feature, a threshold and two children."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))

    def column(self, x: list[Column]) -> Column:
        if self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.threshold, self.left.column(x)).otherwise(self.right.column(x))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Node:
    total_g, total_h = grad.sum(), hess.sum()
    node = Node(value=float(-RATE * total_g / (total_h + 1)))
    if depth == 0 or len(x) < 2 * LEAST_LEAF:
        return node
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")):
            left = x[:, f] <= cut
            n = left.sum()
            if n < LEAST_LEAF or len(x) - n < LEAST_LEAF:
                continue
            g, h = grad[left].sum(), hess[left].sum()
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            best = max(best, (float(gain), f, float(cut)), key=lambda b: b[0])
    if best[1] >= 0:
        left = x[:, best[1]] <= best[2]
        node.feature, node.threshold = best[1], best[2]
        node.left, node.right = _grow(x[left], grad[left], hess[left], depth - 1), _grow(x[~left], grad[~left], hess[~left], depth - 1)
    return node


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Node]]:
    """(base score, trees) of log-odds that y is 1, by second-order gradient boosting."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    for _ in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), DEPTH)
        trees.append(tree)
        score = score + tree.predict(x)
    return base, trees


@dataclass
class UrlModel:
    """Trees and the rates they were trained with: a table (k, rate) of all host suffixes and first path parts, None without training rows."""

    rates: DataFrame | None
    prior: float
    base: float
    trees: list[Node]

    def score(self, names: dict[str, Column]) -> Column:
        """Chance that the URL is to be blocked."""
        x = list(names.values())
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(x)
        return 1 / (1 + F.exp(-total))


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit to ``labelled`` URLs (label 1: block). Suffix rates count all rows; the trees see about ``rows`` of them, chosen by a hash of the URL."""
    urls = labelled.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("y"))
    urls = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    count, prior = urls.agg(F.count("*"), F.avg("y")).first()
    if not count:
        return UrlModel(None, 0.5, 0.0, [])
    stats = urls.select(F.explode(F.array(*suffix_part(F.col("host"), F.col("path")))).alias("k"), "y").groupBy("k").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    rates = materialize(stats.select("k", ((F.col("s") + F.lit(5 * prior)) / (F.col("n") + 5)).alias("rate")))
    chosen = urls.where(F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / count)))
    columns = features(F.col("url"), F.col("host"), F.col("path")) | rate_features()
    data = with_rates(chosen, "host", "path", rates, prior).select("y", "url", *[c.alias(k) for k, c in columns.items()]).toPandas().sort_values(["url", "y"])
    base, trees = boost(data[list(columns)].to_numpy(float), data["y"].to_numpy(float))
    return UrlModel(rates, float(prior), base, trees)


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with _host, _path, _rule, _verdict and _score. The longest fitting rule decides; where none fits, the trees: block at 0.5 or more.

    Null URLs and those without ``://`` have empty host and path, fit no rule, and are judged by the trees as the empty URL. Rows are judged by
    themselves, repeated ones alike. Columns of other names pass unread; input columns of the five names are replaced.
    """
    made = ["_host", "_path", "_rule", "_verdict", "_score"]
    out = pages.select(F.struct(*pages.columns).alias("page"), F.col(url).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    out = with_rates(out, "host", "path", model.rates, model.prior)
    x = features(F.col("url"), F.col("host"), F.col("path")) | rate_features()
    out = out.withColumn("x", F.explode(F.array(F.struct(*[c.alias(k) for k, c in x.items()]))))  # the features are computed once
    out = out.withColumn("score", model.score({k: F.col(f"x.{k}") for k in x})).withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    kept = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in made]
    return out.select(*kept, F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("hit.rule").alias("_rule"), verdict.alias("_verdict"), F.col("score").alias("_score"))


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, blocked): the URLs on which a rule speaks, labelled by it."""
    hit = matching_rule(host(F.col(url)), path(F.col(url)), rules)
    return pages.select(F.col(url).alias("url"), hit.alias("hit")).where("hit is not null").select("url", (F.col("hit.verdict") == "block").cast("int").alias("blocked"))
