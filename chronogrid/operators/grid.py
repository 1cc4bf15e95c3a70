"""Intervals and points on the shared 60-second grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.constants import RESOLUTION_MS
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index


def last_index(start: Column, end: Column, step_ms: int = RESOLUTION_MS) -> Column:
    """Index of the last cell touched by ``[start, end)``; an empty interval touches one."""
    return floor_index(F.greatest(end - F.lit(1), start), step_ms)


#: longest interval that is taken for a measurement: a leap year of cells
MAX_CELLS = 366 * 24 * 60
BLOCK_CELLS = 24 * 60


def split_intervals(
    df: DataFrame, start: str = "start_ms", end: str = "end_ms", step_ms: int = RESOLUTION_MS, max_cells: int = MAX_CELLS
) -> tuple[DataFrame, DataFrame]:
    """(rows fit for the grid, the others with a ``reason``); an end in another unit must not become billions of cells."""
    cells = last_index(F.col(start), F.col(end), step_ms) - floor_index(F.col(start), step_ms) + F.lit(1)
    reason = F.when(
        F.coalesce(cells > max_cells, F.lit(True)), F.concat(F.lit("interval of "), F.coalesce(cells.cast("string"), F.lit("unknown")), F.lit(" cells"))
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def expand_to_grid(
    df: DataFrame, start: str = "start_ms", end: str = "end_ms", step_ms: int = RESOLUTION_MS, name: str = "canonical_index"
) -> DataFrame:
    """One row per touched cell: a range join becomes an equi join on the index.

    The interval is cut into blocks first, so no array holds more than a day of
    cells or a block for every day. Part off absurd intervals with ``split_intervals``.
    """
    first, last = floor_index(F.col(start), step_ms), last_index(F.col(start), F.col(end), step_ms)
    low, high = F.col("_cells.low"), F.col("_cells.high")
    bounds = df.withColumn("_cells", F.struct(first.alias("low"), last.alias("high")))
    block_of = [F.floor(c / F.lit(BLOCK_CELLS)).cast("bigint") for c in (low, high)]
    blocks = bounds.withColumn("_block", F.explode(F.sequence(*block_of)))
    begin = F.col("_block") * F.lit(BLOCK_CELLS)
    inside = F.sequence(F.greatest(low, begin), F.least(high, begin + F.lit(BLOCK_CELLS - 1)))
    return blocks.withColumn(name, F.explode(inside)).drop("_cells", "_block")


def point_to_grid(df: DataFrame, start: str = "start_ms", name: str = "canonical_index") -> DataFrame:
    return df.withColumn(name, floor_index(F.col(start)))


def overlap_share(start: Column, end: Column, index: Column, step_ms: int = RESOLUTION_MS) -> Column:
    """Share of one cell covered by ``[start, end)``, within [0, 1]."""
    low = index * F.lit(step_ms)
    shared = F.least(end, low + F.lit(step_ms)) - F.greatest(start, low)
    share = shared.cast("double") / F.lit(float(step_ms))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def overlap_coverage(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Per cell: the largest share of any one record (not the sum); present when above zero."""
    cells = expand_to_grid(df, start, end).withColumn(
        "coverage", overlap_share(F.col(start), F.col(end), F.col("canonical_index"))
    )
    grouped = cells.groupBy(*keys, "canonical_index").agg(F.max("coverage").alias("coverage"))
    return grouped.withColumn("present", F.col("coverage") > 0)


def cell_sources(df: DataFrame, keys: list[str], source: str, order: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Distinct sources per cell in long form, with the arrival key of their first record.

    Long form keeps a cell with very many sources off any single task; order by
    the ``first_*`` columns to read the list.
    """
    cells = expand_to_grid(df, start, end)
    grouped = cells.groupBy(*keys, "canonical_index", source).agg(F.min(F.struct(*order)).alias("_first"))
    return grouped.select(
        *keys, "canonical_index", source, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order]
    )


def merge_aligned(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two aligned tables: present if either is, the larger coverage wins."""
    both = base.unionByName(extra)
    return both.groupBy(*keys, "canonical_index").agg(
        F.bool_or("present").alias("present"), F.max("coverage").alias("coverage")
    )


def merge_sources(base: DataFrame, extra: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """Union of two long source tables; the base side keeps its place in front."""
    firsts = [f"first_{c}" for c in order]
    both = base.withColumn("first_side", F.lit(0)).unionByName(extra.withColumn("first_side", F.lit(1)))
    grouped = both.groupBy(*keys, "canonical_index", source).agg(
        F.min(F.struct("first_side", *firsts)).alias("_first")
    )
    return grouped.select(
        *keys, "canonical_index", source, *[F.col(f"_first.{c}").alias(c) for c in ["first_side", *firsts]]
    )


def journal_span(first_ms: Column, last_ms: Column) -> dict[str, Column]:
    """Grid block of one note: indexes, count, UTC bounds and duration."""
    first, last = floor_index(first_ms), floor_index(last_ms)
    return {
        "first_index": first,
        "last_index": last,
        "windows_covered": last - first + F.lit(1),
        "first_window_start_ms": first * F.lit(RESOLUTION_MS),
        "last_window_end_ms": (last + F.lit(1)) * F.lit(RESOLUTION_MS),
        "duration_sec": F.greatest(F.lit(0).cast("bigint"), F.floor((last_ms - first_ms) / F.lit(1000)).cast("bigint")),
    }


def rounded_coverage(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("coverage", round_stable(F.col("coverage"), digits))
