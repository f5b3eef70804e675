"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, join_classes, staged


def _least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each directed link with the least of u and its neighbours, of at most ``total`` links.

    Groups are summed before the shuffle; a node with a large share of the links
    is told its least by broadcast, so its links don't meet in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).withColumn("m", F.least("u", "m"))
    return join_classes(pairs, least, "u", "links", total, how="inner").select("u", "v", "m")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node that points at another points at one alone, which points at none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node in ``links``; self-links and repeats are fine, null ends are left out."""
    first = staged(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    edges, before = first.filter("u <> v"), None
    while not _is_stars(edges):
        count = edges.count()
        both = edges.union(edges.select("v", "u"))
        large = staged(_least(both, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        small = _least(large, 2 * count)
        edges = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(large)
        if before is not None:
            discard(before)
        before = edges
    # Links go from the greater to the lesser node, so the middle of a star is its least.
    return nodes.join(edges.select(F.col("u").alias("of"), F.col("v").alias("to")), F.col("node") == F.col("of"), "left").select("node", F.coalesce("to", "node").alias("component"))
