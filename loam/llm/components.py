"""Connected components of a link table by alternating large-star and small-star steps, all as shuffled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import discard, materialise, small


# The least neighbours are written before they are joined back: then the join is a broadcast while they are few, and
# else one of two plain exchanges, whose large partitions (a node with very many links) Spark can split.
def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.join(small(least), "u").withColumn("m", F.least("m", "u"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = edges.join(small(least), "u")
    down = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the smallest node of its component.

    Each round rewrites the edges towards smaller neighbours and is written to the shared folder; rounds
    grow with the logarithm of the longest path. The driver sees only a count and a checksum a round.
    """
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        large, old = materialise(_large_star(edges), "large"), edges
        edges = materialise(_small_star(large), "edges")
        discard(large, old)
        mark, before = _mark(edges), mark
        if tuple(mark) == tuple(before):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
