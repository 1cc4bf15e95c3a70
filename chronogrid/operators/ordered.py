"""Order-dependent work without a single-task sort.

Rows are range-partitioned on the full sort key, so a hot device, minute or
group of copies is spread over as many tasks as it needs. The range bounds come
from a sample, hence the result is checkpointed once: every later branch sees
the same chunk numbers, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.session import cut_lineage

CHUNK = "_chunk"


def range_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_chunk``: ascending chunk numbers follow ascending ``order``.

    ``order`` must end in a unique column, else equal keys cannot be split.
    """
    spread = df.repartitionByRange(*[F.col(c).asc() for c in order])
    return cut_lineage(spread.withColumn(CHUNK, F.spark_partition_id()))


def _edge_rows(chunked: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Last row of every earlier non-empty chunk: one row per partition, so always small."""
    tails = chunked.groupBy(CHUNK).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail")
    )
    by_chunk = Window.orderBy(CHUNK)  # as many rows as there are partitions
    return tails.select(CHUNK, F.lag("_tail").over(by_chunk).alias("_tail")).where("_tail is not null")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add struct ``prev`` with ``columns`` of the preceding row of the same ``keys``."""
    return previous_in_chunks(range_chunks(df, keys + order), keys, order, columns).drop(CHUNK)


def previous_in_chunks(chunked: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``with_previous`` over rows that ``range_chunks`` has already spread by ``keys + order``.

    The rows stay partitioned by chunk and key, so grouping by these first needs no shuffle.
    """
    full_order = keys + order
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*order)
    carried = list(dict.fromkeys(keys + columns))
    edges = _edge_rows(chunked, full_order, carried)
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & (F.col(key) == F.col(f"_tail.{key}"))
    here = chunked.select("*", F.lag(F.struct(*columns)).over(inside).alias("_inner"))
    joined = here.join(F.broadcast(edges), CHUNK, "left")
    across = F.when(same_key, F.struct(*[F.col(f"_tail.{c}").alias(c) for c in columns]))
    return joined.withColumn("prev", F.coalesce("_inner", across)).drop("_inner", "_tail")


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the 0-based global position in ``order``."""
    chunked = range_chunks(df, order)
    sizes = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    numbered = chunked.withColumn("_rank", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(offsets), CHUNK)
        .withColumn(name, F.col("_offset") + F.col("_rank") - F.lit(1).cast("bigint"))
        .drop("_offset", "_rank", CHUNK)
    )


def with_group_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Add the 1-based position inside each key group; hot groups stay split."""
    chunked = range_chunks(df, keys + order)
    inside = Window.partitionBy(CHUNK, *keys).orderBy(*order)
    numbered = chunked.withColumn("_rank", F.row_number().over(inside))
    # Only the last key of a chunk can go on in the next one, so the rest of the
    # bookkeeping is at most two rows per partition.
    ends = chunked.groupBy(CHUNK).agg(
        F.min_by(F.struct(*keys), F.struct(*(keys + order))).alias("_first"),
        F.max_by(F.struct(*keys), F.struct(*(keys + order))).alias("_last"),
    )
    filled = (
        chunked.join(F.broadcast(ends), CHUNK)
        .where(F.struct(*keys) == F.col("_last"))
        .groupBy(CHUNK, F.col("_last").alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_opens", F.lit(False))
    )
    opening = ends.select(CHUNK, F.col("_first").alias("_key"), F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_opens"))
    before = Window.partitionBy("_key").orderBy(CHUNK).rangeBetween(Window.unboundedPreceding, -1)
    offsets = (
        filled.unionByName(opening)
        .withColumn("_offset", F.sum("_n").over(before))
        .where("_opens and _offset is not null")
        .select(CHUNK, F.col("_key").alias("_first"), "_offset")
    )
    joined = numbered.join(F.broadcast(offsets), CHUNK, "left")
    offset = F.when(F.struct(*keys) == F.col("_first"), F.col("_offset"))
    return joined.withColumn(
        name, (F.col("_rank") + F.coalesce(offset, F.lit(0))).cast("bigint")
    ).drop("_rank", "_offset", "_first", CHUNK)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    """First row per key by ``order``; partial aggregation keeps one row per key and task."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in keys])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in keys])


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Top ``n`` per group; the limit is applied in every task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= F.lit(max(n, 0))).withColumn("rank", F.col("rank").cast("bigint"))
