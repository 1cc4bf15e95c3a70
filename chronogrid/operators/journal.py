"""Handwritten notes: stroke times, page order and enrichment of journal records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.constants import GRID_SECONDS, STROKE_RANGE_MS
from chronogrid.functions.timefn import iso_ms
from chronogrid.operators.grid import journal_span
from chronogrid.operators.ordered import with_group_position


def strokes(paths: DataFrame, root: str) -> DataFrame:
    """Stroke stamps from file paths (note_uuid, path): one row per valid 13-digit word.

    ``state``: live under ``shape/``, archived under ``stash/``, else other.
    """
    low, high = STROKE_RANGE_MS
    prefix = F.concat(F.lit(root.rstrip("/") + "/"), F.col("note_uuid"))
    state = (
        F.when(F.col("path").startswith(F.concat(prefix, F.lit("/stash/"))), F.lit("archived"))
        .when(F.col("path").startswith(F.concat(prefix, F.lit("/shape/"))), F.lit("live"))
        .otherwise(F.lit("other"))
    )
    stamps = F.regexp_extract_all("path", F.lit(r"\b(\d{13})\b"), 1)
    found = paths.withColumn("state", state).withColumn("stamp", F.explode(stamps))
    return found.select("note_uuid", "state", F.col("stamp").cast("bigint").alias("stamp_ms")).where(
        (F.col("stamp_ms") > low) & (F.col("stamp_ms") < high)
    )


def note_timing(stamps: DataFrame) -> DataFrame:
    """First and last stroke, the modified range of the live strokes, and counts per note."""
    live = F.col("state") == "live"
    grouped = stamps.groupBy("note_uuid").agg(
        F.min("stamp_ms").alias("first_written_ms"),
        F.max("stamp_ms").alias("last_edited_ms"),
        F.min(F.when(live, F.col("stamp_ms"))).alias("_live_first"),
        F.max(F.when(live, F.col("stamp_ms"))).alias("_live_last"),
        F.count(F.lit(1)).alias("total_strokes"),
        F.count_if(live).alias("live_strokes"),
    )
    return grouped.select(
        "note_uuid",
        "first_written_ms",
        "last_edited_ms",
        F.when(F.col("live_strokes") > 1, F.col("_live_first")).otherwise(F.col("first_written_ms")).alias("modified_start_ms"),
        F.coalesce("_live_last", "last_edited_ms").alias("modified_end_ms"),
        "total_strokes",
        "live_strokes",
        (F.col("total_strokes") - F.col("live_strokes")).alias("archived_strokes"),
    )


def page_ordinals(pages: DataFrame, note: str = "note_uuid", name: str = "file_name") -> DataFrame:
    """1-based page number by file name inside each note."""
    return with_group_position(pages, [note], [name], "page_order")


def enrich_records(records: DataFrame, timing: DataFrame, extracted_ms: int, extractor_version: str = "1.0", note: str = "note_uuid") -> DataFrame:
    """Append the temporal and grid blocks; notes without strokes stay untouched (NULL blocks).

    The same inputs give the same blocks, so enriching again changes nothing.
    """
    first, last = F.col("first_written_ms"), F.col("last_edited_ms")
    span = journal_span(first, last)
    temporal = F.struct(
        first.alias("firstWrittenMs"),
        last.alias("lastEditedMs"),
        F.col("modified_start_ms").alias("modifiedStartMs"),
        F.col("modified_end_ms").alias("modifiedEndMs"),
        span["duration_sec"].alias("durationSec"),
        F.col("total_strokes").alias("totalStrokes"),
        F.col("live_strokes").alias("liveStrokes"),
        F.col("archived_strokes").alias("archivedStrokes"),
        F.lit(0).alias("timezoneOffsetMin"),
        iso_ms(first).alias("firstWrittenISO"),
        iso_ms(last).alias("lastEditedISO"),
        iso_ms(F.col("modified_start_ms")).alias("modifiedStartISO"),
        iso_ms(F.col("modified_end_ms")).alias("modifiedEndISO"),
    )
    grid = F.struct(
        F.lit(GRID_SECONDS).alias("gridSeconds"),
        F.lit("epoch").alias("anchor"),
        span["first_index"].alias("firstWindowIndex"),
        span["last_index"].alias("lastWindowIndex"),
        span["windows_covered"].alias("windowsCovered"),
        span["first_window_start_ms"].alias("firstWindowStartMsUtc"),
        span["last_window_end_ms"].alias("lastWindowEndMsUtc"),
    )
    provenance = F.struct(
        F.lit("stroke-filenames").alias("timestampSource"),
        F.lit(extracted_ms).cast("bigint").alias("timestampExtractedAtMs"),
        F.lit(True).alias("temporalEnriched"),
        F.lit(extractor_version).alias("temporalExtractorVersion"),
    )
    blocks = timing.select(
        F.col("note_uuid").alias(note), temporal.alias("noteTemporal"), grid.alias("canonicalWindowGrid"),
        provenance.alias("provenanceAdded"),
    )
    plain = records.drop("noteTemporal", "canonicalWindowGrid", "provenanceAdded")
    return plain.join(blocks, note, "left")


def run_summary(pages: DataFrame) -> DataFrame:
    """Counts of one transcription run by page status (new, blank, failed, unchanged)."""
    status = F.col("status")
    return pages.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(status == "new").alias("pages_new"),
        F.count_if(status == "blank").alias("blank_pages"),
        F.count_if(status == "failed").alias("failed_pages"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
