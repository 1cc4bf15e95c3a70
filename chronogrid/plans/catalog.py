"""All registered queries."""

from __future__ import annotations

from chronogrid.plans import embedding_catalog, insight_catalog, scalar_catalog, source_catalog, state_catalog, streaming_catalog, windows_catalog  # noqa: F401
from chronogrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
