"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import dropped, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over ``(u, v)`` with u > v: every node sends its neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    sent = both.join(least, "u")
    if large:
        sent = sent.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        sent = sent.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return sent.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; root is the smallest node of its component.

    ``links`` has two columns of node numbers.  Rounds grow with the logarithm of the longest chain; each one is
    cut at a written table, and a node of many links is never gathered in one task (its rows are only joined).
    """
    a, b = links.columns
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        old, half = edges, _star(edges, True)
        edges = saved(_star(half, False), "edges")
        dropped(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
