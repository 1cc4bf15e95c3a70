"""Lineage edges between artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(
    derived: DataFrame,
    module: str,
    created: str,
    edge_type: str = "derived",
    child: str = "artifact_id",
    parents: str = "parents",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per child and parent."""
    return derived.select(
        *(keep or []),
        F.col(child).alias("child_id"),
        F.explode(parents).alias("parent_id"),
        F.lit(edge_type).alias("edge_type"),
        F.lit(module).alias("module"),
        F.col(created).alias("created_ms"),
    )
