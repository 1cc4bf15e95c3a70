"""Reachability over lineage edges without a round per level.

A node with one parent and one child adds nothing to a graph but length. Such
runs are shortened by pointer doubling: after r rounds every node of a run
knows the node 2^r above and below it, and rows that have arrived at an end are
not touched again. What is left has branches at every node; it is walked, or
peeled, round by round, and runs that a peeling leaves are shortened again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.session import cut_lineage

MERGE_LEVELS = 16


class Runs(NamedTuple):
    """``inner``: (node, up, up_n, down, down_n), the ends of its run and the steps to them; ``loops``: (node) of runs without ends."""

    inner: DataFrame
    loops: DataFrame
    rounds: int


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def runs(edges: DataFrame, kept: DataFrame | None = None) -> Runs:
    """Runs of the distinct ``edges`` (child_id, parent_id); nodes of ``kept`` (node) are always ends."""
    none = F.lit(None)
    ends = edges.select(F.col("child_id").alias("node"), F.col("parent_id").alias("up"), none.cast("string").alias("down")).unionByName(
        edges.select(F.col("parent_id").alias("node"), none.cast("string").alias("up"), F.col("child_id").alias("down"))
    )
    degrees = ends.groupBy("node").agg(
        F.max("up").alias("up"), F.count("up").alias("up_n"), F.max("down").alias("down"), F.count("down").alias("down_n")
    )
    single = degrees.where("up_n = 1 and down_n = 1")
    if kept is not None:
        single = single.join(kept, "node", "left_anti")
    active, done, rounds = cut_lineage(single), [], 0
    n = active.count()
    while n and rounds <= n.bit_length():
        here = _union([active, *done])
        above = here.select(F.col("node").alias("up"), F.col("up").alias("next_up"), F.col("up_n").alias("more_up"))
        below = here.select(F.col("node").alias("down"), F.col("down").alias("next_down"), F.col("down_n").alias("more_down"))
        moved = active.join(above, "up", "left").join(below, "down", "left")
        zero = F.lit(0).cast("bigint")
        moved = cut_lineage(
            moved.select(
                "node",
                F.coalesce("next_up", "up").alias("up"),
                (F.col("up_n") + F.coalesce("more_up", zero)).alias("up_n"),
                F.coalesce("next_down", "down").alias("down"),
                (F.col("down_n") + F.coalesce("more_down", zero)).alias("down_n"),
                (F.col("next_up").isNotNull() | F.col("next_down").isNotNull()).alias("moved"),
            )
        )
        done.append(cut_lineage(moved.where("not moved").drop("moved")))  # apart, so that later rounds read these rows alone
        active = moved.where("moved").drop("moved")
        rounds += 1
        if not active.head(1):
            break
    return Runs(_union([active.where("false"), *done]), active.select("node"), rounds)


def _contracted(edges: DataFrame, found: Runs) -> DataFrame:
    """(child_id, parent_id, steps): edges between the ends of runs, with the shortest way where there are several."""
    skipped = found.inner.select("node").unionByName(found.loops)
    outer = edges.join(skipped.withColumnRenamed("node", "child_id"), "child_id", "left_anti")
    heads = found.inner.select(F.col("node").alias("parent_id"), F.col("up").alias("head"), "up_n")
    joined = outer.join(heads, "parent_id", "left").select(
        "child_id",
        F.coalesce("head", "parent_id").alias("parent_id"),
        (F.col("steps") + F.coalesce("up_n", F.lit(0).cast("bigint"))).alias("steps"),
    )
    return cut_lineage(joined.groupBy("child_id", "parent_id").agg(F.min("steps").alias("steps")))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, depth) of everything below the ``sources`` (node), themselves at depth 0: the fewest steps from any of them.

    Every round writes only what came nearer in it. A run of any length takes a
    logarithmic number of rounds, the rest as many as its branches follow each other.
    """
    pairs = cut_lineage(edges.select("child_id", "parent_id").distinct().withColumn("steps", F.lit(1).cast("bigint")))
    start = cut_lineage(sources.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    found = runs(pairs, start.select("node"))
    short = _contracted(pairs, found)
    levels, frontier = [start], start

    def nearest() -> DataFrame:
        return _union(levels).groupBy("node").agg(F.min("depth").alias("depth"))

    while frontier.head(1):
        step = short.join(frontier.withColumnRenamed("node", "parent_id"), "parent_id")
        step = step.groupBy(F.col("child_id").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        known = nearest().withColumnRenamed("depth", "known")
        frontier = cut_lineage(step.join(known, "node", "left").where("known is null or depth < known").drop("known"))
        levels.append(frontier)
        if len(levels) > MERGE_LEVELS:  # a long plan is cut now and then, not at every level
            levels[:] = [cut_lineage(nearest())]
    ends = cut_lineage(nearest())
    inside = found.inner.join(ends.withColumnRenamed("node", "up"), "up").select("node", (F.col("depth") + F.col("up_n")).alias("depth"))
    return ends.unionByName(inside)


def between_cycles(edges: DataFrame) -> DataFrame:
    """(node) of those that lie on a cycle or on a way from one cycle to another: runs are shortened, ends raked off, in turns."""
    left = cut_lineage(edges.select("child_id", "parent_id").distinct().withColumn("steps", F.lit(1).cast("bigint")))
    n, shortened, sure = left.count(), [], []
    while n:
        found = runs(left)
        short = _contracted(left, found)
        children = short.select(F.col("child_id").alias("parent_id")).distinct()
        parents = short.select(F.col("parent_id").alias("child_id")).distinct()
        raked = short.join(children, "parent_id", "left_semi").join(parents, "child_id", "left_semi")
        left = cut_lineage(raked.select("child_id", "parent_id", "steps"))
        shortened.append(found.inner)
        sure.append(found.loops)
        before, n = n, left.count()
        if n == before:  # nothing was shortened or raked off
            break
    nodes = left.select(F.col("child_id").alias("node")).unionByName(left.select(F.col("parent_id").alias("node")))
    nodes = cut_lineage(_union([nodes, *sure]).distinct())
    for inner in reversed(shortened):  # a node of a run stays where both its ends do
        both = inner.join(nodes.withColumnRenamed("node", "up"), "up", "left_semi").join(
            nodes.withColumnRenamed("node", "down"), "down", "left_semi"
        )
        nodes = cut_lineage(nodes.unionByName(both.select("node")))
    return nodes
