"""Aligned multi-span rollups of canonical windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.constants import DEFAULT_SPANS, MIN_COVERAGE, MODALITIES, RESOLUTION_MS, SPAN_SECONDS, TIER_LABELS
from chronogrid.functions import ids
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.predicates import quality_tier
from chronogrid.functions.timefn import iso_ms, snap

STATS = {
    "heart_rate": ("bpm", "bpm_min", "bpm_max", "bins"),
    "hrv_proxy": ("bpm",),
    "hrv": ("sdnn_ms", "rmssd_ms"),
    "stress": ("score", "readings"),
    "sleep_stage": ("segments", "dominant_stage"),
}


def resolve_span(span: str) -> tuple[str, int]:
    """Span name or number of seconds (``300``, ``300s``) to (id, seconds)."""
    name = span.lower()
    if name in SPAN_SECONDS:
        return name, SPAN_SECONDS[name]
    digits = name.removesuffix("s")
    if digits.isdigit():
        return f"{digits}s", int(digits)
    raise ValueError(f"unknown span {span!r}: use one of {sorted(SPAN_SECONDS)} or a number of seconds")


def bucket_spans(windows: DataFrame, spans: Iterable[str] = DEFAULT_SPANS) -> DataFrame:
    """Repeat each window once per span with the span's aligned bucket start."""
    options = [
        F.struct(F.lit(i).alias("span_id"), F.lit(s).cast("bigint").alias("span_seconds"))
        for i, s in map(resolve_span, spans)
    ]
    spread = windows.withColumn("_span", F.explode(F.array(*options)))
    span_ms = F.col("_span.span_seconds") * F.lit(1000)
    return (
        spread.withColumn("span_id", F.col("_span.span_id"))
        .withColumn("span_seconds", F.col("_span.span_seconds"))
        .withColumn("span_start_ms", F.col("start_ms") - F.pmod(F.col("start_ms"), span_ms))
        .drop("_span")
    )


def _mean(flag: Column, value: str) -> Column:
    return round_stable(F.avg(F.when(flag, F.col(value))), 3)


def modality_stats() -> dict[str, Column]:
    """Statistics over the windows where a modality is present; NULL when none."""
    on = {m: F.col(f"present_{m}") for m in MODALITIES}

    def total(m: str, f: str) -> Column:
        return F.sum(F.when(on[m], F.col(f"{m}_{f}"))).cast("bigint")

    return {
        "agg_heart_rate_bpm": _mean(on["heart_rate"], "heart_rate_bpm"),
        "agg_heart_rate_bpm_min": round_stable(F.min(F.when(on["heart_rate"], F.col("heart_rate_bpm_min"))), 3),
        "agg_heart_rate_bpm_max": round_stable(F.max(F.when(on["heart_rate"], F.col("heart_rate_bpm_max"))), 3),
        "agg_heart_rate_bins": total("heart_rate", "bins"),
        "agg_hrv_proxy_bpm": _mean(on["hrv_proxy"], "hrv_proxy_bpm"),
        "agg_hrv_sdnn_ms": _mean(on["hrv"], "hrv_sdnn_ms"),
        "agg_hrv_rmssd_ms": _mean(on["hrv"], "hrv_rmssd_ms"),
        "agg_stress_score": _mean(on["stress"], "stress_score"),
        "agg_stress_readings": total("stress", "readings"),
        "agg_sleep_stage_segments": total("sleep_stage", "segments"),
        "agg_sleep_stage_dominant_stage": F.mode(
            F.when(on["sleep_stage"], F.col("sleep_stage_dominant_stage").cast("string")), deterministic=True
        ),
    }


def coverage_columns(min_coverage: float = MIN_COVERAGE) -> tuple[list[Column], list[Column]]:
    expected = F.col("windows_expected").cast("double")
    shares = [round_stable(F.col(f"_n_{m}") / expected, 4).alias(f"coverage_{m}") for m in MODALITIES]
    flags = [
        ((F.col(f"coverage_{m}") > 0) & (F.col(f"coverage_{m}") < min_coverage)).alias(f"partial_{m}")
        for m in MODALITIES
    ]
    return shares, flags


def build_rollups(
    windows: DataFrame,
    spans: Iterable[str] = DEFAULT_SPANS,
    min_coverage: float = MIN_COVERAGE,
    with_members: bool = False,
) -> DataFrame:
    """Rollups of every span in one shuffle; buckets without windows are absent.

    ``with_members`` adds the ordered window ids: a device has one window per
    minute, so a bucket lists at most span/60 ids.
    """
    counts = {f"_n_{m}": F.count_if(F.col(f"present_{m}")) for m in MODALITIES}
    aggregates = {"windows_present": F.count(F.lit(1)), **counts, **modality_stats()}
    if with_members:
        aggregates["members"] = F.sort_array(F.collect_list(F.struct("start_ms", "artifact_id")))
    grouped = bucket_spans(windows, spans).groupBy("device", "span_id", "span_seconds", "span_start_ms")
    rolled = grouped.agg(*[v.alias(k) for k, v in aggregates.items()])
    span_ms = F.col("span_seconds") * F.lit(1000)
    sized = rolled.withColumn("span_end_ms", F.col("span_start_ms") + span_ms).withColumn(
        "windows_expected",
        F.greatest(F.lit(1).cast("bigint"), F.floor(span_ms / F.lit(RESOLUTION_MS)).cast("bigint")),
    )
    shares, flags = coverage_columns(min_coverage)
    shared = sized.select("*", *shares).drop(*counts)
    quality = round_stable(sum((F.col(f"coverage_{m}") for m in MODALITIES[1:]), F.col("coverage_heart_rate")) / 5, 4)
    graded = shared.select("*", *flags, quality.alias("quality"))
    out = graded.withColumn("quality_tier", quality_tier(F.col("quality"))).withColumn(
        "artifact_id", ids.rollup_id(F.col("span_seconds"), F.col("span_start_ms"))
    )
    if with_members:
        out = out.withColumn("members", F.transform("members", lambda m: m["artifact_id"]))
    return out


def missing_modalities(flags: dict[str, Column]) -> Column:
    """Expected modalities that are not present, in reporting order."""
    present = F.array_compact(F.array(*[F.when(flag, F.lit(m)) for m, flag in flags.items()]))
    return F.array_except(F.array(*[F.lit(m) for m in flags]), present)


def missingness(flags: dict[str, Column], coverage: dict[str, Column]) -> Column:
    names = F.array(*[F.lit(m) for m in coverage])
    shares = F.array(*[F.coalesce(c, F.lit(0.0)) for c in coverage.values()])
    empty = F.array().cast("array<string>")
    return F.struct(
        F.map_from_arrays(names, shares).alias("modality_coverage"),
        missing_modalities(flags).alias("missing_modalities"),
        empty.alias("corruption_flags"),
        empty.alias("delayed_modalities"),
    )


def _stats_struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def rollup_records(rollups: DataFrame, device_alias: Column, producer: str, version: str = "0.1", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rollups as 9-key records with nested payload; expects ``members``."""
    coverage = {m: F.col(f"coverage_{m}") for m in MODALITIES}
    flags = {m: F.col(f"coverage_{m}") > 0 for m in MODALITIES}
    modalities = F.struct(
        *[
            F.when(flags[m], _stats_struct({f: F.col(f"agg_{m}_{f}") for f in fields})).alias(m)
            for m, fields in STATS.items()
        ]
    )
    base = missingness(flags, coverage)
    partial = F.struct(*[F.col(f"partial_{m}").alias(m) for m in MODALITIES])
    payload = F.struct(
        F.lit("rollup").alias("kind"),
        F.lit("canonical.rollup").alias("artifact_type"),
        F.struct(
            iso_ms(F.col("span_start_ms")).alias("start_time"),
            iso_ms(F.col("span_end_ms")).alias("end_time"),
            F.col("span_seconds").alias("resolution_seconds"),
            F.col("span_id"),
            F.col("windows_expected").alias("canonical_windows_expected"),
        ).alias("window"),
        F.struct(*[flags[m].alias(m) for m in MODALITIES]).alias("modalities_present"),
        F.struct(
            modalities.alias("modalities"),
            F.struct(F.col("windows_present").alias("count"), F.col("members").alias("artifact_ids")).alias("aggregated_from"),
        ).alias("payload"),
        F.struct(
            base["modality_coverage"].alias("modality_coverage"),
            base["missing_modalities"].alias("missing_modalities"),
            partial.alias("partial"),
            F.lit(min_coverage).alias("min_coverage"),
            base["corruption_flags"].alias("corruption_flags"),
            base["delayed_modalities"].alias("delayed_modalities"),
        ).alias("missingness_metadata"),
        F.struct(F.col("quality").alias("overall_rollup_quality"), F.col("quality_tier")).alias("quality_metadata"),
    )
    provenance = F.struct(
        F.lit(producer).alias("producer"),
        F.lit(version).alias("producer_version"),
        F.lit("wearable_rollup").alias("pipeline_name"),
        F.col("span_id"),
        F.lit(min_coverage).alias("min_coverage"),
        device_alias.alias("device_alias"),
        F.struct(
            F.lit("wearable_canonical_window").alias("derived_from"),
            F.lit("rollup").alias("derivation"),
            F.col("windows_present").alias("window_count"),
        ).alias("lineage"),
    )
    return rollups.select(
        F.col("artifact_id").alias("artifactId"),
        F.lit("mobile").alias("source"),
        payload.alias("payload"),
        F.col("span_start_ms").alias("createdAtEpochMs"),
        F.lit("1.1").alias("schemaVersion"),
        device_alias.alias("deviceAlias"),
        provenance.alias("provenanceMetadataJson"),
        F.lit(0).cast("bigint").alias("ingestedAtEpochMs"),
        F.lit("accepted").alias("ingestStatus"),
    )


def window_records(windows: DataFrame, producer: str, export: str = "", transport: str = "inbox", version: str = "0.1", timezone: str = "UTC") -> DataFrame:
    """Windows as 9-key records; absent modalities are left out of the payload."""
    flags = {m: F.col(f"present_{m}") for m in MODALITIES}
    coverage = {m: F.col(f"cov_{m}") for m in MODALITIES}
    parts = {
        "heart_rate": {f: F.col(f"heart_rate_{f}") for f in ("bpm", "bpm_min", "bpm_max", "bins")},
        "hrv_proxy": {
            "bpm": F.col("hrv_proxy_bpm"), "windows": F.col("hrv_proxy_windows"), "method": F.lit("rolling_rmssd_60s"),
        },
        "hrv": {"sdnn_ms": F.col("hrv_sdnn_ms"), "rmssd_ms": F.col("hrv_rmssd_ms"), "derived_by_watch": F.lit(True)},
        "stress": {f: F.col(f"stress_{f}") for f in ("readings", "score", "score_min", "score_max")},
        "sleep_stage": {f: F.col(f"sleep_stage_{f}") for f in ("segments", "stage_codes", "dominant_stage")},
    }
    quality = round_stable(sum((coverage[m] for m in MODALITIES[1:]), coverage["heart_rate"]) / 5, 4)
    payload = F.struct(
        F.lit("canonical_window").alias("kind"),
        F.lit("canonical.window").alias("artifact_type"),
        F.struct(
            iso_ms(F.col("start_ms")).alias("start_time"),
            iso_ms(F.col("end_ms")).alias("end_time"),
            F.lit(60).alias("resolution_seconds"),
            F.col("canonical_index"),
            F.lit(timezone).alias("timezone"),
        ).alias("window"),
        F.struct(*[flags[m].alias(m) for m in MODALITIES]).alias("modalities_present"),
        F.struct(
            F.struct(*[F.when(flags[m], _stats_struct(parts[m])).alias(m) for m in MODALITIES]).alias("modalities"),
            F.array().cast("array<string>").alias("aligned_artifact_refs"),
        ).alias("payload"),
        missingness(flags, coverage).alias("missingness_metadata"),
        F.struct(quality.alias("overall_window_quality"), quality_tier(quality).alias("quality_tier")).alias("quality_metadata"),
    )
    provenance = F.struct(
        F.lit(producer).alias("producer"),
        F.lit(version).alias("producer_version"),
        F.lit("wearable_canonical_window").alias("pipeline_name"),
        F.lit(transport).alias("transport"),
        F.lit(export).alias("export"),
        F.col("device").alias("device_alias"),
        F.struct(*[F.lit(t).alias(m) for m, t in TIER_LABELS.items()]).alias("tier_labels"),
        F.when(flags["hrv_proxy"], F.lit("rolling_rmssd_60s")).otherwise(F.lit("")).alias("hrv_proxy_method"),
        F.struct(
            F.lit("health_export").alias("derived_from"), F.lit("parse_align_project").alias("derivation")
        ).alias("lineage"),
    )
    return windows.select(
        ids.window_id(F.col("canonical_index")).alias("artifactId"),
        F.lit("mobile").alias("source"),
        payload.alias("payload"),
        F.col("start_ms").alias("createdAtEpochMs"),
        F.lit("1.0").alias("schemaVersion"),
        F.col("device").alias("deviceAlias"),
        provenance.alias("provenanceMetadataJson"),
        F.lit(0).cast("bigint").alias("ingestedAtEpochMs"),
        F.lit("pending").alias("ingestStatus"),
    )


def flat_windows(windows: DataFrame) -> DataFrame:
    """Flat window columns: identity, presence, coverage and the fixed value fields."""
    fields = {
        "heart_rate": ("bpm", "bpm_min", "bpm_max", "bins"),
        "hrv_proxy": ("bpm", "windows"),
        "hrv": ("sdnn_ms", "rmssd_ms"),
        "stress": ("score", "readings"),
        "sleep_stage": ("segments",),
    }
    values = [
        F.when(F.col(f"present_{m}"), F.col(f"{m}_{f}")).alias(f"{m}_{f}") for m, names in fields.items() for f in names
    ]
    return windows.select(
        "canonical_index",
        "start_ms",
        "end_ms",
        iso_ms(F.col("start_ms")).alias("start_iso"),
        iso_ms(F.col("end_ms")).alias("end_iso"),
        ids.window_id(F.col("canonical_index")).alias("artifact_id"),
        F.col("device").alias("device_alias"),
        *[F.col(f"present_{m}") for m in MODALITIES],
        *[F.when(F.col(f"present_{m}"), F.col(f"cov_{m}")).otherwise(F.lit(0.0)).alias(f"cov_{m}") for m in MODALITIES],
        *values,
        F.col("sleep_stage_dominant_stage").cast("string").alias("sleep_stage_dominant_stage"),
    )


def flat_rollups(rollups: DataFrame) -> DataFrame:
    stats = [f"agg_{m}_{f}" for m, fields in STATS.items() for f in fields]
    return rollups.select(
        "span_id",
        "span_seconds",
        "span_start_ms",
        "span_end_ms",
        iso_ms(F.col("span_start_ms")).alias("span_start_iso"),
        iso_ms(F.col("span_end_ms")).alias("span_end_iso"),
        "windows_expected",
        "windows_present",
        "artifact_id",
        *[F.col(f"coverage_{m}") for m in MODALITIES],
        *[F.col(f"partial_{m}") for m in MODALITIES],
        *stats,
    )


def first_windows(windows: DataFrame, limit: int) -> DataFrame:
    """Lowest indexes first; 0 keeps every window."""
    ordered = windows.orderBy("canonical_index", "device")
    return ordered.limit(limit) if limit > 0 else ordered


def aligned_start(ms: Column, span: str) -> Column:
    return snap(ms, resolve_span(span)[1] * 1000)
