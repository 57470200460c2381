"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star rewrites.

A rewrite is one shuffle: edges are brought together by item and sorted by neighbour, so that the first neighbour is the
least and repeated edges stand side by side. A round, one of each, is one job and one written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import materialize, release

#: An item with more edges than this (and more than a thousandth of all edges) is hot: its join is salted.
HOT_EDGES = 2_000_000
MAX_ROUNDS = 60


def _nearest(edges: DataFrame, least_self: bool, total: int, hot_edges: int) -> DataFrame:
    """(u, v, m): each distinct edge with the least neighbour m of u, with u itself counted when least_self.

    An item that owns over a thousandth of the edges (and more than hot_edges) is kept out of the sort: fewer than 2,000
    items can, so that list is safe to broadcast whatever the size of the data.
    """
    own: list[Column] = [F.col("u")] if least_self else []
    by = W.partitionBy("u").orderBy("v")
    last = F.lag("v").over(by)

    def sorted_(e: DataFrame) -> DataFrame:
        first = F.first("v").over(by)
        return e.select("u", "v", (F.least(*own, first) if own else first).alias("m"), last.alias("last")).where("last is null or last <> v").drop("last")

    bar = max(hot_edges, total // 1000)
    if total <= bar:
        return sorted_(edges)
    mins = edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("deg")).where(F.col("deg") > bar)
    hot = F.broadcast(materialize(mins.select("u", (F.least(*own, "least") if own else F.col("least")).alias("m"))))
    # a hot item's least neighbour goes along with the broadcast list; its repeated edges are dropped by item and neighbour
    return sorted_(edges.join(hot, "u", "left_anti")).union(edges.join(hot, "u").select("u", "v", "m").distinct())


def _either(a: tuple, b: tuple):
    """Two (u, v) rows for each row, in one pass over the data."""
    row = lambda x: F.struct(F.col(x[0]).alias("u"), F.col(x[1]).alias("v"))
    return F.inline(F.array(row(a), row(b)))


def large_star(edges: DataFrame, total: int, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(u, v, moved): every larger neighbour of an item linked to the least of the item and its neighbours; moved tells new links."""
    both = edges.select(_either(("u", "v"), ("v", "u")))
    return _nearest(both, True, 2 * total, hot_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))


def small_star(edges: DataFrame, total: int, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(u, v, moved): an item and its smaller neighbours linked to the least of them; edges have u > v."""
    near = _nearest(edges, False, total, hot_edges).withColumn("moved", F.col("v") != F.col("m"))
    row = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"), "moved")
    # the item's own link once, from its first edge, and one for each other neighbour
    return near.select(F.inline(F.array(F.when(F.col("moved"), row("v")).otherwise(row("u")))))


def star_labels(edges: DataFrame, hot_edges: int = HOT_EDGES, total: int | None = None) -> DataFrame:
    """(u, v): each item that is not its component's least, with that least item. edges: (u, v) with u > v; repeats are allowed.

    Every round is written to the shared folder: lineage stays short and a lost executor costs one round at most. total:
    an upper bound of the number of edges, if known.
    """
    n = edges.count() if total is None else total
    now = edges
    for k in range(MAX_ROUNDS):
        if not n:
            return materialize(now) if not k else now
        large, small = Observation(), Observation()
        wide = large_star(now, n, hot_edges).observe(large, F.sum(F.col("moved").cast("long")).alias("moved"))
        if n > max(hot_edges, n // 1000):  # hot items are listed first, so what is rewritten is read twice
            wide = materialize(wide)
        after = materialize(small_star(wide.select("u", "v"), n, hot_edges).observe(small, F.sum(F.col("moved").cast("long")).alias("moved")).select("u", "v"))
        release(now, wide)
        now, n = after, after.__dict__["_skein_rows"]
        if not (large.get["moved"] or 0) and not (small.get["moved"] or 0):
            return now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def group_items(pairs: DataFrame, a: str = "ind1", b: str = "ind2", hot_edges: int = HOT_EDGES) -> DataFrame:
    """(item, group_item): one row per value in a or b, with the least item it is linked to directly or indirectly.

    A pair with a null or the same item twice links nothing, but its items are still listed, each with itself as its
    group unless other pairs link it. Repeated pairs and both directions count once. An empty table gives no rows;
    other columns are not read.
    """
    p = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    items = p.select(F.explode(F.array("a", "b")).alias("item")).where("item is not null").distinct()
    edges = p.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    labels = star_labels(edges, hot_edges)
    return items.join(labels.select(F.col("u").alias("item"), F.col("v").alias("root")), "item", "left").select("item", F.coalesce("root", "item").alias("group_item"))
