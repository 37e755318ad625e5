"""Clusters of sets by Jaccard similarity, from postings of candidate keys.

The components of the graph of links are found without all pairs of a group:
 1. star rounds: each key's posting list is compared with one hub, as many pairs as the list is long, and links are verified; the first hub is
    the node whose keys are shared most, later ones are drawn by hash;
 2. once few pairs of different components are left in the lists, or rounds stop helping, those pairs are compared one by one.
A link inside a component that is already known changes nothing, so the result is that of all candidate pairs.

``links`` is for callers that want the links themselves: it compares all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, owned, semi_by_id, small
from .graph import components
from .rarity import Rarity, with_prefixes

#: Star rounds at most; they end before when the pairs left are at most PAIRS_PER_POSTING times the postings, or fell by less than a fifth.
ROUNDS, PAIRS_PER_POSTING = 12, 0.25
#: Posting lists longer than this are split by prefix tokens, where the caller gives them.
LONG = 32


def near(n1: str, n2: str, percent: int) -> str:
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, from ``sets_of(nodes)`` as (node, items), have the asked for similarity; materialised."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    items = materialize(sets_of(nodes))
    both = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    out = both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    out = materialize(out.where(f"100 * i >= {percent} * (s - i)").select("a", "b"))
    discard(items)
    return out


def need(n1: str, n2: str, percent: int) -> str:
    """Items that sets of these sizes share at least if they link."""
    return f"({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent}"


def placed(x: str, y: str, percent: int) -> str:
    """Whether a key that stands at places x.pos and y.pos of two sets' items, in one common order, can be among the first ell that a link shares."""
    ell = f"least({x}.ell, {y}.ell)"
    return " AND ".join(f"{s}.pos < {s}.n - {need(f'{x}.n', f'{y}.n', percent)} + {ell}" for s in (x, y))


def _refined(listed: DataFrame, tokens: DataFrame) -> DataFrame:
    """``listed`` with lists longer than LONG split by the nodes' prefix tokens, of which a link shares one; both materialised."""
    long = listed.where(F.col("df") > LONG)
    split = materialize(long.join(tokens, "node").select("key", "node", "n", "ell", F.posexplode("tokens").alias("pos", "token")).select(F.xxhash64("key", "token").alias("key"), "node", "n", "ell", "pos"))
    often = split.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    out = materialize(listed.where(F.col("df") <= LONG).unionByName(split.join(often, "key").select(*listed.columns)))
    discard(split, listed)
    return out


@owned
def links(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, sieve: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(a, b), a < b: every link, from postings as ``cluster`` takes them; materialised. Work grows with the pairs that share keys, links or not."""
    often = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    shared = materialize(postings.join(often, "key").select("key", "node", "n", "ell", "pos"))
    x, y = shared.alias("x"), shared.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & F.expr(near("x.n", "y.n", percent)) & F.expr(placed("x", "y", percent)))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("x.ell", "y.ell")).alias("ell")).where("k >= ell")
    pairs = materialize(pairs.select("a", "b"))
    discard(shared)
    return verified(sieve(pairs), sets_of, percent)


@owned
def cluster(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, sieve: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, rarity: Rarity | None = None) -> DataFrame:
    """``postings``: (key, node, n, ell, pos), one row for each key of a node; n is the set's size, ell how many keys a link must share.

    Where the keys are the items in one common order, ``pos`` is the key's place; else it is 0. ``sieve`` takes materialised pairs (a, b) and may drop
    those that can't link, at less cost than comparing them. ``rarity`` is for keys that aren't items: the sets of the nodes that share a key
    are made once and kept as a table, and long lists are split by their prefixes, rarest items first. Returns (node, component) for the nodes that have a link.
    """
    often = materialize(postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    # bands shared by different sets are few; items are as many as texts have in common, and are shuffled at every size
    listed = materialize(postings.join(often if rarity is None else small(often), "key").select("key", "node", "n", "ell", "pos", "df"))
    items = None
    if rarity is not None:
        items = materialize(sets_of(listed.select("node").distinct()))
        listed = _refined(listed, with_prefixes(items, rarity, percent))

        def sets_of(nodes: DataFrame) -> DataFrame:
            return semi_by_id(items, nodes, "node")

    fame = listed.groupBy("node").agg(F.sum("df").alias("fame"))
    shared = materialize(listed.join(fame, "node").select("key", "node", "n", "ell", "pos", "fame"))
    discard(listed)
    size = shared.count()
    links = tested = found = before = None
    left_before = float("inf")
    for r in range(ROUNDS):
        named = shared if found is None else shared.join(found, "node", "left")
        named = named.withColumn("component", F.col("node") if found is None else F.coalesce("component", "node"))
        counts = named.groupBy("key", "component").agg(F.count("*").cast("double").alias("c"))
        open_keys = counts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("parts")).where("parts > 1")
        named = materialize(named.join(open_keys.select("key", ((F.col("m") * F.col("m") - F.col("q")) / 2 / F.col("m")).alias("share")), "key"))  # the key's pairs, by posting
        if before is not None:
            discard(before)
        before = named
        left = named.agg(F.sum("share")).first()[0] or 0.0
        if r and (left <= PAIRS_PER_POSTING * size or left > 0.8 * left_before):
            break
        left_before = left
        order: Column = F.col("fame") if r == 0 else F.xxhash64("node", F.lit(r))
        hubs = named.groupBy("key").agg(F.max(F.struct(order.alias("o"), "node", "n", "ell", "pos", "component")).alias("hub"))
        stars = named.alias("x").join(hubs, "key").where("x.component <> hub.component").where(near("x.n", "hub.n", percent)).where(placed("x", "hub", percent))
        stars = stars.select(F.least("x.node", "hub.node").alias("a"), F.greatest("x.node", "hub.node").alias("b")).distinct()
        stars = materialize(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"))
        new = verified(sieve(stars), sets_of, percent)
        links = new if links is None else links.unionByName(new)
        tested = stars if tested is None else tested.unionByName(stars)
        found = components(links)
    x, y = named.alias("x"), named.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & F.expr(near("x.n", "y.n", percent)) & F.expr(placed("x", "y", percent)))
    cross = cross.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("x.ell", "y.ell")).alias("ell")).where("k >= ell")
    cross = materialize(cross.select("a", "b").join(tested, ["a", "b"], "left_anti"))
    discard(named, shared)
    cross = sieve(cross)
    if cross.isEmpty():
        return found
    more = verified(cross, sets_of, percent)
    return found if more.isEmpty() else components(links.unionByName(more))
