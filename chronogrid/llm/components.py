"""Connected components by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of its neighbourhood."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # not made distinct: these rows are no more than the edges, and the small star behind drops the equal ones
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = [F.struct(F.col(v).alias("a"), F.col("m").alias("b")) for v in ("a", "b")]
    return down.join(least, "a").select(F.inline(F.array(*tied))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex that has an edge; root is the smallest vertex reachable.

    A vertex with a million neighbours is a join key with one row on the other
    side, which adaptive execution splits; no neighbourhood is ever collected.
    The rounds grow with the logarithm of the longest path. Every round is
    checkpointed, so a lost executor repeats one round at most.
    """
    current = cut_lineage(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    while not _all_stars(current):
        current = cut_lineage(_small_star(_large_star(current)))
    leaves = current.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return leaves.union(current.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """No vertex has two smaller neighbours, and none has both a smaller and a larger one."""
    ends = [F.struct(F.col(v).alias("v"), F.lit(below).alias("below"), F.lit(1 - below).alias("above")) for v, below in (("a", 1), ("b", 0))]
    ends = edges.select(F.inline(F.array(*ends)))
    tied = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return tied.where("below > 1 or (below = 1 and above = 1)").isEmpty()


def tied_groups(roots: DataFrame, ties: DataFrame) -> DataFrame:
    """(vertex, root) after the groups of ``roots`` are tied by ``ties`` (ra, rb).

    ``ties`` names roots, or vertices that were in no group. Only they are
    searched again, not the edges that made the groups.
    """
    above = components(ties, "ra", "rb").withColumnRenamed("root", "top")
    grouped = roots.join(above.withColumnRenamed("vertex", "root"), "root", "left")
    lone = above.join(roots, "vertex", "left_anti").select("vertex", F.col("top").alias("root"))
    return grouped.select("vertex", F.coalesce("top", "root").alias("root")).unionByName(lone)
