"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): every node but the smallest of its component, and that
    smallest node.

    Alternating star operations: neighbours are handed to the smallest node
    seen, with partial aggregates for the minima, until every node hangs on
    one smallest node only (a few rounds; each round is a written table, and
    edges that are stars from the start need none).  Only the count of nodes
    that are not settled reaches the driver."""
    high, low = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct(), "edges")
    return now


def _stars(edges: DataFrame) -> bool:
    """Whether each larger node of distinct edges has one edge and is the
    smaller node of none; then the smaller ones are the roots."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1 and up > 0").isEmpty()
