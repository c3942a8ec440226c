"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, release


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link names; the component is its smallest node.

    Links are (a, b) of longs in any direction, repeats and loops allowed; null ends are ignored. Each
    round is written to the shared folder. Minima are combined before they move, and written, so that the joins
    that give them back are dealt anew and split a node with many links: a hub does not meet in one task. Ends when a round changes
    nothing: then every node hangs on the smallest of its component.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    loops = links.where("u = v").select(F.col("u").alias("node")).distinct()
    edges = materialise(_downward(links).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        made: list[DataFrame] = []
        after = materialise(_small_star(_large_star(edges, made), made).distinct(), "links")
        release(edges, *made)
        edges = after
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    alone = loops.join(hung.select("node").union(roots), "node", "left_anti")
    return hung.union(roots.union(alone).select("node", F.col("node").alias("component")))


def _downward(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, without loops."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    made.append(least := materialise(least, "least"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these neighbours."""
    made.append(edges := materialise(_downward(edges).distinct(), "star"))
    made.append(least := materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "least"))
    moved = edges.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
