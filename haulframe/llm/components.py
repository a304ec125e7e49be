"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.storage import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (all the larger, or the smaller ones and itself) on the least of them."""
    near = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = near.join(least, "a")
    if large:
        hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (columns a, b, of one orderable numeric type).

    component is the least node of the component. No edges give no rows; loops and repeated edges change nothing.
    Every round is kept in the checkpoint folder; rounds grow with the logarithm of the largest component.
    """
    now = materialise(edges.select("a", "b").where("a != b").distinct())
    before = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if size == before or not size[0]:
            break
        before = size
        now = materialise(_stars(_stars(now, True), False))
    leaves = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.union(roots)
