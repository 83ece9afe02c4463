"""Groups of records linked directly or through others: alternating large-star and small-star rewrites.

Ids are numbered once, in their order, so that the rounds carry numbers only. Edges are kept as (hi, lo), hi > lo. Large-star
hangs every larger neighbour of a node on the smallest node it knows; small-star hangs a node's smaller neighbours, and the
node, on the smallest of them. Both are an aggregation (which combines on the map side) and a join with its result,
repeated until the edges no longer change; then every edge leads from a member to the smallest member of its component.
Each round's edges are written to shared storage, and counted and summed up while they are written.

A node that holds more than ``hot_share`` of the edges, and no fewer than ``hot_least``, would make one task of its join. There are
at most 1 / hot_share such nodes, so their minima are broadcast and only the rest is joined by shuffle.

Defined cases: a null on one side leaves the other as its own group; nulls on both sides, nothing; a pair of
equal ids links nothing but makes the id known; repeated and reversed pairs count once; '' is an id like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ledgerlark.runtime import Kept


def _hot(edges: DataFrame, on: str, least: int) -> list[int]:
    """Nodes that hold ``least`` edges or more."""
    return [r[0] for r in edges.groupBy(on).agg(F.count("*").alias("c")).where(F.col("c") >= least).select(on).collect()]


def _with_minimum(edges: DataFrame, minima: DataFrame, on: str, n: int, hot_share: float, hot_least: int) -> DataFrame:
    """``edges`` with the minimum ``m`` known of the node in column ``on``, null where none is."""
    least = max(hot_least, int(n * hot_share))
    minima = minima.withColumnRenamed("node", "_n")
    hot = _hot(edges, on, least) if n >= least else []  # at most n / least
    if not hot:
        return edges.join(minima, F.col(on) == F.col("_n"), "left").drop("_n")
    is_hot, few = F.col(on).isin(hot), F.broadcast(minima.where(F.col("_n").isin(hot)))
    cold = edges.where(~is_hot).join(minima, F.col(on) == F.col("_n"), "left")
    return cold.unionByName(edges.where(is_hot).join(few, F.col(on) == F.col("_n"), "left")).drop("_n")


def _large_star(edges: DataFrame, n: int, hot_share: float, hot_least: int) -> DataFrame:
    minima = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
    out = _with_minimum(edges, minima, "lo", n, hot_share, hot_least)
    return out.select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, n: int, hot_share: float, hot_least: int) -> DataFrame:
    minima = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
    hung = _with_minimum(edges, minima, "hi", n, hot_share, hot_least).where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hung.unionByName(minima.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct()


def _written(edges: DataFrame) -> tuple[Kept, tuple]:
    """The edges, written, with their number and the sum of their codes."""
    seen = Observation()
    kept = Kept(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")))
    return kept, (seen.get.get("n") or 0, seen.get.get("s"))


def components(pairs: DataFrame, left: str, right: str, node: str = "node", group: str = "group_id", hot_share: float = 1e-3, hot_least: int = 1_000_000) -> DataFrame:
    """One row (node, group) per distinct id in ``left`` or ``right``; group is the component's smallest id."""
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    nodes = pairs.select(F.explode(F.array(a, b)).alias("n")).where(F.col("n").isNotNull()).distinct()
    nodes = Kept(nodes.sort("n").withColumn("i", F.monotonically_increasing_id())).df  # in order: a smaller id has a smaller number
    edges = pairs.where(a != b).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    for end, name in (("x", "hi"), ("y", "lo")):
        edges = edges.join(nodes.select(F.col("n").alias(end), F.col("i").alias(name)), end)
    now, mark = _written(edges.select("hi", "lo"))
    while True:
        half = Kept(_large_star(now.df, mark[0], hot_share, hot_least))
        after, print_ = _written(_small_star(half.df, mark[0], hot_share, hot_least))
        half.drop()
        now.drop()
        now, last, mark = after, mark, print_
        if mark == last:
            break
    # Only the roots' numbers become ids again.
    roots = now.df.select("lo").distinct().join(nodes.select(F.col("n").alias("g"), F.col("i").alias("lo")), "lo")
    labels = now.df.join(roots, "lo").select(F.col("hi").alias("i"), "g")
    return nodes.join(labels, "i", "left").select(F.col("n").alias(node), F.coalesce("g", "n").alias(group))
