"""Connected components by alternating star contraction, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and itself.

    `larger_only` links the larger neighbours (large star); else the node and its smaller ones.
    """
    arcs = _both_ways(edges) if larger_only else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c"))
    linked = arcs.join(least, "a")
    if larger_only:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("c").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("c").alias("b")).unionAll(least.select("a", F.col("c").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, comp): comp is the least node reachable; lone nodes have no row.

    Every pass writes its edges; it ends when both stars leave them as they are, which takes about
    the logarithm of the longest path. No node's neighbours meet in one task: they are reduced to
    their minimum before the shuffle, and the join back can be split by skew handling.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        edges = written(_to_least(_to_least(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
