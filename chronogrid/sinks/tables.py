"""Writers: records, flat tables and keyed folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronogrid.operators.state import keyed_upsert
from chronogrid.session import cut_lineage
from chronogrid.sources.files import path_exists


def write_flat(df: DataFrame, path: str, label: str, generated_at: str, producer: str = "chronogrid") -> None:
    """Snappy Parquet; generation time, producer and label travel in the schema of the file footer."""
    notes = {"generated_at": generated_at, "producer": producer, "label": label}
    first = df.columns[0]
    df.withMetadata(first, notes).write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_notes(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(path).schema.fields[0].metadata)


def _record_lines(records: DataFrame) -> Column:
    texts = {n for n, t in records.dtypes if n in ("payload", "provenanceMetadataJson") and t == "string"}
    return F.to_json(F.struct(*[F.try_parse_json(c).alias(c) if c in texts else F.col(c) for c in records.columns]))


def write_records(records: DataFrame, path: str, partition: str, rows_per_file: int = 0) -> None:
    """9-key records as gzipped JSON lines in one folder per ``partition`` value; replaces what is there.

    The keys of a record repeat in every line, so packed lines take a small part of the bytes. Payload and provenance may be structs, which is cheaper, or JSON text, which becomes an object.
    """
    writer = records.select(_record_lines(records).alias("value"), F.col(partition).alias(f"by_{partition}"))
    writer = writer.write.mode("overwrite").option("compression", "gzip")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(f"by_{partition}").text(path)


STORE_PARTITIONS = ["by_source", "by_device", "by_day"]
DAY_MS = 86_400_000


def upsert_records(records: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Add 9-key records to a store by key: a record replaces that of its source, device, id and creation time.

    The store lies by source, device and UTC day, so a run rewrites only the
    days it has records for, and other devices and exports stay as they are.
    New folders are moved in when all rows are written, so the merge may read
    the folders that it replaces. Lines are gzipped, as in ``write_records``.
    """
    spark = records.sparkSession
    lines = records.select(
        _record_lines(records).alias("value"),
        F.col("source").alias("by_source"),
        F.coalesce(F.nullif(F.col("deviceAlias"), F.lit("")), F.lit("unknown")).alias("by_device"),
        F.floor(F.col("createdAtEpochMs") / F.lit(DAY_MS)).cast("bigint").alias("by_day"),
        F.col("artifactId").alias("_id"),
        F.col("createdAtEpochMs").alias("_created"),
    )
    if path_exists(spark, path):
        lines = cut_lineage(lines)  # read twice: for its days, and with what is stored for these
        schema = "value string, by_source string, by_device string, by_day bigint"
        old = only_touched(spark.read.schema(schema).text(path), lines, STORE_PARTITIONS)
        if old.head(1):  # nothing stored for these days: nothing to merge with
            key = F.from_json("value", "artifactId string, createdAtEpochMs bigint")
            old = old.select("value", *STORE_PARTITIONS, key.alias("_key"))
            old = old.select("value", *STORE_PARTITIONS, F.col("_key.artifactId").alias("_id"), F.col("_key.createdAtEpochMs").alias("_created"))
            lines = keyed_upsert(old, lines.withColumn("arrival", F.lit(0)), [*STORE_PARTITIONS, "_id", "_created"])
    # a day of a device holds 1,440 windows: one file, not one a task; only a day too large for a task is split
    by_day = lines.select("value", *STORE_PARTITIONS).hint("rebalance", *STORE_PARTITIONS)
    writer = by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(*STORE_PARTITIONS).text(path)


MAX_NAMED = 2_000


def only_touched(stored: DataFrame, batch: DataFrame, partitions: list[str]) -> DataFrame:
    """Rows of the partitions that occur in ``batch``.

    Up to MAX_NAMED partitions are named in the filter, so that the scan opens
    only their folders; for a wider batch it opens those between the least and
    the greatest value of each column, and a join leaves the touched ones.
    """
    touched = cut_lineage(batch.select(*partitions).distinct())  # one pass over the batch for all that follows
    named = touched.limit(MAX_NAMED + 1).collect()
    if len(named) > MAX_NAMED:
        ends = touched.agg(*[f(p).alias(f"{n}_{i}") for i, p in enumerate(partitions) for n, f in (("min", F.min), ("max", F.max))]).first()
        for i, p in enumerate(partitions):
            stored = stored.where(F.col(p).isNull() | F.col(p).between(F.lit(ends[f"min_{i}"]), F.lit(ends[f"max_{i}"])))
        return stored.join(touched, [stored[p].eqNullSafe(touched[p]) for p in partitions], "left_semi")
    wanted = F.lit(True)
    for place, p in enumerate(partitions):
        values = {r[place] for r in named}
        known = [v for v in values if v is not None]
        hit = F.col(p).isin(known) if known else F.lit(False)
        wanted = wanted & (hit | F.col(p).isNull() if None in values else hit)
    pruned = stored.where(wanted)
    if len(partitions) == 1:
        return pruned
    exact = F.broadcast(touched)  # at most MAX_NAMED rows
    return pruned.join(exact, [pruned[p].eqNullSafe(exact[p]) for p in partitions], "left_semi")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored rows, or none when nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partitions: list[str], arrival: str = "arrival"
) -> None:
    """Last write per key into a partitioned Parquet folder.

    Only the partitions named by the batch are read and rewritten. Batch and
    merged rows are checkpointed: the first because it is read twice, the second
    because it comes from the very folder that is replaced. Repeating a batch
    gives the same table.
    """
    columns = [c for c in incoming.columns if c != arrival]
    batch = cut_lineage(incoming)
    stored = only_touched(read_table(spark, path, batch.select(*columns).schema), batch, partitions).select(*columns)
    merged = cut_lineage(keyed_upsert(stored, batch, keys, arrival))
    (
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )
