"""Registry of modality adapters: fetch rows, normalise them, flag the healthy ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    name: str
    fetch: Callable[[SparkSession], DataFrame]
    normalize: Callable[[DataFrame], DataFrame]
    healthy: Callable[[DataFrame], Column] = field(default=lambda rows: F.lit(True))


class Registry:
    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def add(self, adapter: Adapter) -> None:
        if adapter.name in self._adapters:
            raise ValueError(f"adapter {adapter.name} is registered twice")
        self._adapters[adapter.name] = adapter

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        adapter = self._adapters[name]
        rows = adapter.normalize(adapter.fetch(spark))
        return rows.withColumn("healthy", adapter.healthy(rows)).withColumn("adapter", F.lit(name))

    def collect(self, spark: SparkSession) -> DataFrame:
        """Rows of every adapter in one table; columns an adapter lacks are NULL."""
        out = None
        for name in sorted(self._adapters):
            rows = self.read(spark, name)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("no adapter is registered")
        return out
