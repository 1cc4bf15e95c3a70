"""Structured Streaming versions of ingest, grid, rollup and proxy.

Every job drains what is there and stops (``availableNow``); started again with
the same checkpoint it takes only new files. Tables written through
``foreachBatch`` are keyed, so a replayed batch leaves them as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronogrid.constants import RESOLUTION_MS
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index, late_status
from chronogrid.operators import signals, state
from chronogrid.sinks import tables

DAY_MS = 86_400_000


def read_inbox(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def drain_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to a file sink, exactly once."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode(mode).start()
    )
    query.awaitTermination()


def drain_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], partitions: list[str], mode: str = "update") -> None:
    """Keyed upsert of every micro-batch; later batches replace earlier rows of a key."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("arrival", F.lit(batch_id).cast("bigint"))
        tables.upsert_table(batch.sparkSession, path, rows, keys, partitions)

    drain_batches(stream, each, checkpoint, mode)


def utc_day(ms: Column) -> Column:
    return floor_index(ms, DAY_MS)


def tumbling(stream: DataFrame, span: str, lateness: str, device: str = "device") -> DataFrame:
    """Aggregates per device and aligned span of ``ts``; works on streams and on tables."""
    timed = stream.withWatermark("ts", lateness) if stream.isStreaming else stream
    grouped = timed.groupBy(F.window("ts", span), device).agg(
        F.count(F.lit(1)).alias("bins"),
        F.avg("bpm").alias("mean"),
        F.min("bpm").alias("low"),
        F.max("bpm").alias("high"),
    )
    start = F.unix_millis("window.start")
    return grouped.select(
        device, start.alias("start_ms"), F.unix_millis("window.end").alias("end_ms"), "bins",
        round_stable(F.col("mean"), 3).alias("bpm"), F.col("low").alias("bpm_min"), F.col("high").alias("bpm_max"),
        utc_day(start).alias("day"),
    )


def drop_repeats(stream: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """One row per key within the lateness bound."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def with_late_status(rows: DataFrame, on_time_ms: int, delayed_ms: int) -> DataFrame:
    delay = F.col("ingest_ms") - F.col("end_ms")
    return rows.withColumn("delay_ms", delay).withColumn("status", late_status(delay, on_time_ms, delayed_ms))


def sessions(rows: DataFrame, key: str, gap: str, lateness: str = "1 day") -> DataFrame:
    """Activity sessions per key, closed by a gap; on a stream they appear once the watermark has passed.

    The end is exclusive: an event exactly ``gap`` after the one before opens a
    session of its own. Spark joins windows that only touch, so they are cut a
    microsecond short and the end is put back.
    """
    timed = rows.withWatermark("ts", lateness) if rows.isStreaming else rows
    grouped = timed.groupBy(F.session_window("ts", f"{gap} -1 microseconds"), key).agg(F.count(F.lit(1)).alias("events"))
    end = F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND")
    return grouped.select(
        key, F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis(end).alias("end_ms"), "events"
    )


def drain_proxy(stream: DataFrame, bins_path: str, proxy_path: str, checkpoint: str, band: int = 10) -> None:
    """Rolling proxy kept up to date: each batch recomputes the windows its bins can touch.

    Bins are kept by day; a batch reads the days around its own bins only. Every
    batch has its own folder, so a replay replaces its bins instead of adding them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("day", utc_day(F.col("start_ms"))).withColumn("batch", F.lit(batch_id).cast("bigint"))
        schema = named.schema
        (
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "day").parquet(bins_path)
        )
        fresh = tables.read_table(spark, bins_path, schema).where(F.col("batch") == batch_id)
        minutes = fresh.select("device", floor_index(F.col("start_ms")).alias("minute")).distinct()
        reach = minutes.select("device", F.explode(F.sequence(F.col("minute") - 1, F.col("minute") + band)).alias("canonical_index")).distinct()
        near = minutes.select("device", F.explode(F.sequence(F.col("minute") - 2 * band, F.col("minute") + band)).alias("minute")).distinct()
        near = near.withColumn("day", utc_day(F.col("minute") * F.lit(RESOLUTION_MS)))
        stored = tables.read_table(spark, bins_path, schema).where(F.col("batch") <= batch_id)
        stored = stored.withColumn("minute", floor_index(F.col("start_ms")))
        around = signals.dedup_bins(stored.join(near, ["device", "day", "minute"], "left_semi"))
        holding = around.select("device", floor_index(F.col("start_ms")).alias("canonical_index")).distinct()
        candidates = holding.join(reach, ["device", "canonical_index"], "left_semi")
        rows = signals.rolling_proxy(around, candidates, band)
        keyed = rows.withColumn("day", utc_day(F.col("canonical_index") * F.lit(RESOLUTION_MS))).withColumn(
            "arrival", F.lit(batch_id).cast("bigint")
        )
        tables.upsert_table(spark, proxy_path, keyed, ["device", "canonical_index"], ["day"])

    drain_batches(stream, each, checkpoint)


def drain_files_with_manifest(
    stream: DataFrame, records_path: str, manifest_path: str, checkpoint: str, now_ms: int
) -> None:
    """Records first, manifest last: a batch that fails in between is taken again as a whole.

    ``stream``: export, rel_path, sha256, bytes, payload.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        rows = held.select("export", "rel_path", "sha256", "payload", F.lit(batch_id).cast("bigint").alias("arrival"))
        tables.upsert_table(spark, records_path, rows, ["export", "rel_path"], ["export"])
        marks = state.manifest_rows(held, F.lit(1), F.lit(None).cast("string"), now_ms)
        keyed = marks.withColumn("arrival", F.lit(batch_id).cast("bigint"))
        tables.upsert_table(spark, manifest_path, keyed, ["export", "rel_path"], ["export"])
        held.unpersist()

    drain_batches(stream, each, checkpoint)


def recompute_touched(stored: DataFrame, late: DataFrame, keys: list[str], rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rebuild the buckets named by late rows from all stored rows of those buckets."""
    touched = late.select(*keys).distinct()
    return rebuild(stored.join(touched, keys, "left_semi"))
