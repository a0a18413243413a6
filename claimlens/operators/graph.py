"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import materialize, release


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node of the neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("low"))
    hung = e.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge, component being the least node reachable.

    Edges may come in either direction, repeated, and as loops. Rounds go on until
    the edge set no longer changes; each round's edges are written to the shared
    folder, so the plan stays short and a lost executor costs one round at most.
    """
    given = materialize(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "edges")
    loops, e = given.where("a = b"), given.where("a <> b")
    before = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        last, e = e, materialize(_small(_large(e)), "edges")
        release(last)  # not the edges given, whose loops are read at the end
    found = e.unionByName(e.select(F.col("b").alias("a"), "b")).unionByName(loops.join(e.select("a"), "a", "left_anti"))
    return found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def recomputed(labels: DataFrame, links: DataFrame, touched: DataFrame) -> DataFrame:
    """(node, component) of the nodes whose component may have changed, when links have come or gone.

    labels: (node, component) of all nodes before; links: (a, b) of all links now; touched: (node) with both ends of
    every link that has come or gone, and every new node. Only the components these nodes had are put together again
    from their links, whether that joins or splits them; nothing else is read of links, and all other labels stand.
    """
    mine = touched.select("node").distinct()
    hit = labels.join(mine, "node", "left_semi").select("component").distinct()
    members = materialize(labels.join(hit, "component", "left_semi").select("node").unionByName(mine).distinct(), "members")
    found = connected_components(links.join(members, F.col("a") == F.col("node"), "left_semi"), "a", "b")
    return members.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
