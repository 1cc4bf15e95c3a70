"""Keyed state: upserts, change detection, acknowledgements and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.functions.predicates import normalize_source, text_or
from chronogrid.operators.ordered import first_per_key, last_per_key

#: a window id says the minute only, so the device belongs to the key wherever rows have one
UPSERT_KEYS = ["source", "device", "artifact_id", "created_ms"]


def stamp_batch(batch: DataFrame, now_ms: int) -> DataFrame:
    """Incoming rows with the accepted envelope.

    Missing source, id and creation time fall back to other, unknown and now.
    """
    return (
        batch.withColumn("source", normalize_source(text_or(F.col("source"), "other")))
        .withColumn("artifact_id", text_or(F.col("artifact_id"), "unknown"))
        .withColumn("created_ms", F.coalesce("created_ms", F.lit(now_ms).cast("bigint")))
        .withColumn("ingested_ms", F.lit(now_ms).cast("bigint"))
        .withColumn("ingest_status", F.lit("accepted"))
    )


def keyed_upsert(
    target: DataFrame, incoming: DataFrame, keys: list[str] | None = None, arrival: str = "arrival"
) -> DataFrame:
    """Last write per key wins; rows of the target without a newer write stay.

    One shuffle: target and batch are united and the newest row per key is kept
    by partial aggregation, so many copies of one key collapse in their own tasks.
    """
    columns = target.columns
    keys = [k for k in keys or UPSERT_KEYS if k != "device" or k in columns]
    old = target.withColumn("_generation", F.lit(0)).withColumn("_arrival", F.lit(0).cast("bigint"))
    new = incoming.withColumn("_generation", F.lit(1)).withColumn("_arrival", F.col(arrival).cast("bigint"))
    both = old.unionByName(new.select(*columns, "_generation", "_arrival"))
    return last_per_key(both, keys, ["_generation", "_arrival"], columns).select(*columns)


def insert_if_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Existing rows plus the first incoming row of every fingerprint not yet stored."""
    columns = existing.columns
    fresh = first_per_key(incoming, keys, [arrival], columns)
    known = existing.select(*keys).distinct()
    return existing.unionByName(fresh.join(known, keys, "left_anti").select(*columns))


def needs_processing(files: DataFrame, manifest: DataFrame, keys: list[str], sha: str = "sha256", force: bool = False) -> DataFrame:
    """Files without a manifest row of the same, non-empty hash."""
    if force:
        return files
    handled = manifest.where(F.col(sha) != "").select(*keys, sha).distinct()
    return files.join(handled, [*keys, sha], "left_anti")


def needs_transcription(pages: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Pages that are new, changed, or whose last attempt left neither an artifact nor a blank mark."""
    if force:
        return pages
    stored = manifest.select(
        "note_uuid", "page_id",
        F.col("png_sha256").alias("_sha"), F.col("last_artifact_id").alias("_artifact"), F.col("blank").alias("_blank"),
        F.lit(True).alias("_known"),
    )
    joined = pages.join(stored, ["note_uuid", "page_id"], "left")
    changed = (F.coalesce("_sha", F.lit("")) != "") & (F.col("_sha") != F.col("png_sha256"))
    failed = (F.coalesce("_artifact", F.lit("")) == "") & ~F.coalesce("_blank", F.lit(False))
    due = F.col("_known").isNull() | changed | failed
    return joined.where(due).select(*pages.columns)


def not_pushed(files: DataFrame, pushed: DataFrame) -> DataFrame:
    """Files whose path, hash and size were never pushed together."""
    keys = ["path", "sha256", "bytes"]
    return files.join(pushed.select(*keys).distinct(), keys, "left_anti")


def acknowledge(queue: DataFrame, acked: DataFrame) -> DataFrame:
    """Mark rows whose id was returned; repeated ids in the answer change nothing."""
    ids = acked.select("artifact_id").distinct().withColumn("_acked", F.lit(True))
    joined = queue.join(ids, "artifact_id", "left")
    return joined.withColumn("synced", F.col("synced") | F.col("_acked").isNotNull()).drop("_acked").select(*queue.columns)


def drop_older_than(rows: DataFrame, cutoff_ms: int, created: str = "created_ms") -> DataFrame:
    return rows.where(F.col(created) >= cutoff_ms)


def count_older_than(rows: DataFrame, cutoff_ms: int, created: str = "created_ms") -> DataFrame:
    return rows.agg(F.count_if(F.col(created) < cutoff_ms).alias("deleted"))


def run_difference(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = ("ingested_ms",)) -> DataFrame:
    """Rows of either run that the other lacks, with their surplus count; empty means equal runs.

    Counting both runs in one grouped pass replaces two full differences.
    """
    columns = [c for c in left.columns if c not in ignore]
    both = left.select(*columns, F.lit(1).alias("_side")).unionByName(right.select(*columns, F.lit(-1).alias("_side")))
    counted = both.groupBy(*columns).agg(F.sum("_side").alias("surplus"))
    return counted.where("surplus <> 0")


def seed_manifest(records: DataFrame, path: str = "path") -> DataFrame:
    """Manifest rows rebuilt from accepted journal records: the last path of a note wins.

    ``records``: note_uuid, page_order, page_source, source_path, png_sha256, width, height, engine,
    artifact_id, ingested_ms, created_ms, ingest_status and the path column.
    """
    usable = records.where((F.col("ingest_status") == "accepted") & (F.length(F.coalesce("note_uuid", F.lit(""))) > 0))
    kept = [
        "page_order", "page_source", "source_path", "png_sha256", "width", "height", "engine", "artifact_id",
        "ingested_ms", "created_ms",
    ]
    newest = last_per_key(usable, ["note_uuid"], [path], kept)
    return newest.select(
        "note_uuid",
        F.col("note_uuid").alias("page_id"),
        F.coalesce("page_order", F.lit(1)).cast("bigint").alias("page_order"),
        text_or(F.col("page_source"), "cover").alias("page_source"),
        F.coalesce("source_path", F.lit("")).alias("source_path"),
        F.coalesce("png_sha256", F.lit("")).alias("png_sha256"),
        F.coalesce("width", F.lit(0)).cast("bigint").alias("width"),
        F.coalesce("height", F.lit(0)).cast("bigint").alias("height"),
        F.coalesce(F.nullif("ingested_ms", F.lit(0)), F.col("created_ms"), F.lit(0)).cast("bigint").alias("last_ocr_at_ms"),
        "engine",
        F.col("artifact_id").alias("last_artifact_id"),
        F.lit(False).alias("blank"),
    )


def module_runs(runs: DataFrame) -> DataFrame:
    """Last completed run per module. ``runs``: module, completed_ms, run_id and further columns."""
    rest = [c for c in runs.columns if c != "module"]
    return last_per_key(runs, ["module"], ["completed_ms", "run_id"], rest)


def manifest_rows(files: DataFrame, records: Column, error: Column, now_ms: int) -> DataFrame:
    """Processing state per file: error, empty or processed."""
    status = (
        F.when(error.isNotNull(), F.lit("error")).when(records > 0, F.lit("processed")).otherwise(F.lit("empty"))
    )
    return files.select(
        "export", "rel_path", "sha256", "bytes",
        F.coalesce(records, F.lit(0)).cast("bigint").alias("records_emitted"),
        status.alias("status"),
        F.coalesce(error, F.lit("")).alias("error"),
        F.lit(now_ms).cast("bigint").alias("processed_at_ms"),
    )


def check_uploads(
    uploads: DataFrame, require_png: bool = True, safe: Column | None = None
) -> DataFrame:
    """Decode and verify uploads (path, sha256, b64): add ``content`` and ``reason``; NULL reason is accepted."""
    content = F.try_to_binary(F.col("b64"), F.lit("base64"))
    strict = F.col("b64").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    is_png = F.hex(F.substring(F.col("content"), 1, 8)) == "89504E470D0A1A0A"
    path_ok = safe if safe is not None else F.lit(True)
    decoded = uploads.withColumn("content", F.when(strict, content))
    reason = (
        F.when(~path_ok, F.lit("unsafe path"))
        .when(F.col("content").isNull(), F.lit("bad base64"))
        .when(F.length("content") == 0, F.lit("empty"))
        .when(F.lit(require_png) & ~is_png, F.lit("not a png"))
        .when(F.sha2("content", 256) != F.lower("sha256"), F.lit("hash mismatch"))
    )
    return decoded.withColumn("reason", reason)
