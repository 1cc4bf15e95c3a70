"""Lineage integrity, lifecycle, deletion views, hashes and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.functions.jsontext import canonical_json
from chronogrid.operators.ordered import with_previous
from chronogrid.operators.reach import between_cycles, distances

# Lifecycle moves that are allowed.
ALLOWED_TRANSITIONS = (
    ("proposed", "ingested"),
    ("ingested", "validated"),
    ("validated", "finalized"),
    ("validated", "failed"),
    ("finalized", "superseded"),
    ("finalized", "archived"),
    ("failed", "deleted_physical"),
    ("superseded", "archived"),
)

# Sensitivity tiers from harmless to sensitive.
TIERS = ("low", "medium", "high")


def orphans(edges: DataFrame, artifacts: DataFrame, artifact_id: str = "artifact_id") -> DataFrame:
    """Edges whose parent is not stored."""
    known = artifacts.select(F.col(artifact_id).alias("parent_id")).distinct()
    return edges.join(known, "parent_id", "left_anti")


def invalidated(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Everything that depends, directly or not, on deleted artifacts: artifact_id, depth.

    Long single-file stretches take a logarithmic number of rounds (``reach``).
    """
    found = distances(edges, deleted.select(F.col("artifact_id").alias("node")))
    return found.where("depth > 0").select(F.col("node").alias("artifact_id"), F.col("depth").cast("int").alias("depth"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges left after all artifacts without parents or without children are peeled off; empty for a proper lineage."""
    nodes = between_cycles(edges)
    pairs = edges.select("child_id", "parent_id").distinct()
    below = pairs.join(nodes.withColumnRenamed("node", "child_id"), "child_id", "left_semi")
    return below.join(nodes.withColumnRenamed("node", "parent_id"), "parent_id", "left_semi").select("child_id", "parent_id")


def active_view(artifacts: DataFrame, tombstones: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Artifacts neither deleted nor superseded."""
    hidden = tombstones.select("artifact_id").union(supersessions.select("artifact_id")).distinct()
    return artifacts.join(hidden, "artifact_id", "left_anti")


def newest_successor(supersessions: DataFrame) -> DataFrame:
    """Latest named successor per artifact. ``supersessions``: artifact_id, successor_id, at_ms."""
    return supersessions.groupBy("artifact_id").agg(
        F.max_by("successor_id", F.struct("at_ms", "successor_id")).alias("successor_id"), F.max("at_ms").alias("at_ms")
    )


def transitions(states: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive states per artifact with an ``allowed`` flag. ``states``: artifact_id, state and the order columns."""
    linked = with_previous(states, ["artifact_id"], order, ["state"]).where("prev is not null")
    moved = linked.withColumn("from_state", F.col("prev.state")).where("from_state <> state").drop("prev")
    pair = F.concat("from_state", F.lit(">"), F.col("state"))
    return moved.withColumn("allowed", pair.isin(*[f"{a}>{b}" for a, b in ALLOWED_TRANSITIONS]))


def content_hash(content: Column) -> Column:
    """SHA-256 of the key-sorted compact JSON of the given fields."""
    return F.sha2(canonical_json(content), 256)


def gate_by_sensitivity(rows: DataFrame, tier: str, threshold: str, opted_in: Column) -> DataFrame:
    """Rows at or below the policy tier, or explicitly opted in."""
    levels = F.create_map(*[F.lit(v) for pair in ((t, i) for i, t in enumerate(TIERS)) for v in pair])
    return rows.where((levels[F.col(tier)] <= TIERS.index(threshold)) | F.coalesce(opted_in, F.lit(False)))


def migrate(old: DataFrame, new: DataFrame, renamed: dict[str, str], added: dict[str, Column]) -> DataFrame:
    """Rows of the earlier schema read as the later one: renames, then defaults for added columns."""
    lifted = old.withColumnsRenamed(renamed)
    for name, default in added.items():
        if name not in lifted.columns:
            lifted = lifted.withColumn(name, default)
    return new.unionByName(lifted, allowMissingColumns=True)


def visit_rule_errors(start: Column, end: Column, dwell: Column, host: Column, blocked: Column, tolerance_ms: int = 1000) -> Column:
    """Names of the visit rules a record breaks."""
    return F.array_compact(
        F.array(
            F.when(end < start, F.lit("end_before_start")),
            F.when(F.abs(dwell - (end - start)) > tolerance_ms, F.lit("dwell_mismatch")),
            F.when(~F.coalesce(host.rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}\z"), F.lit(False)), F.lit("host_not_registrable")),
            F.when(~F.coalesce(blocked, F.lit(False)), F.lit("content_not_blocked")),
        )
    )

