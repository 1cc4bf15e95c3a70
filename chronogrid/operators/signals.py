"""Per-window measurements: de-duplication, payloads and the rolling proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.constants import PROXY_BAND_BINS, PROXY_METHOD, RESOLUTION_MS
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index
from chronogrid.operators.grid import expand_to_grid

BIN_COLUMNS = ["start_ms", "end_ms", "bpm", "bpm_min", "bpm_max", "seq"]


def dedup_bins(bins: DataFrame) -> DataFrame:
    """Keep the earliest bin per window and rounded (bpm, min, max).

    ``bins``: device, start_ms, end_ms, bpm, bpm_min, bpm_max, seq (arrival order).
    Copies collapse in every task before the shuffle.
    """
    key = [
        F.col("device"),
        floor_index(F.col("start_ms")).alias("canonical_index"),
        *[F.round(c, 3).alias(f"_{c}") for c in ("bpm", "bpm_min", "bpm_max")],
    ]
    first = F.min_by(F.struct(*BIN_COLUMNS), F.struct("start_ms", "end_ms", "seq")).alias("_bin")
    kept = bins.groupBy(*key).agg(first, F.count(F.lit(1)).alias("copies"))
    return kept.select("device", "canonical_index", *[F.col(f"_bin.{c}").alias(c) for c in BIN_COLUMNS], "copies")


SERIES_ORDER = ["start_ms", "end_ms", "seq"]
BLOCK_MINUTES = 60


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of ``keys`` over all ``spark.sql.shuffle.partitions``.

    A number that is named is not merged down to a few large tasks, whose maps
    would hold far more than the packed shuffle blocks let expect: one row of a
    block becomes a band of windows, and nulls pack to nothing.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def previous_in_band(bins: DataFrame, band: int) -> DataFrame:
    """device, _block, start_ms, bpm and ``prev`` (start_ms, bpm): the bin before, if it is at most ``band`` minutes older.

    Time is cut into blocks; the last ``band`` minutes of a block also lead into
    the next one, where they are looked back at and then dropped. A lag inside
    (device, block) is all that is needed: one shuffle, no device on one task.
    """
    size = max(BLOCK_MINUTES, band)
    minute = floor_index(F.col("start_ms"))
    block = floor_index(F.col("start_ms"), size * RESOLUTION_MS)
    own = F.struct(block.alias("_block"), F.lit(False).alias("_lead"))
    ahead = F.struct((block + F.lit(1)).alias("_block"), F.lit(True).alias("_lead"))
    leads = minute + F.lit(band) >= (block + F.lit(1)) * F.lit(size)
    placed = bins.select(
        "device", *SERIES_ORDER, "bpm", F.inline(F.when(leads, F.array(own, ahead)).otherwise(F.array(own)))
    )
    inside = Window.partitionBy("device", "_block").orderBy(*SERIES_ORDER)
    linked = spread_by(placed, "device", "_block").select(
        "device", "_block", "_lead", "start_ms", "bpm", F.lag(F.struct("start_ms", "bpm")).over(inside).alias("prev")
    )
    near = floor_index(F.col("prev.start_ms")) + F.lit(band) >= minute
    return linked.where(~F.col("_lead")).withColumn("prev", F.when(near, F.col("prev"))).drop("_lead")


def proxy_parts(bins: DataFrame, band: int = PROXY_BAND_BINS) -> DataFrame:
    """Sums behind the rolling proxy: device, canonical_index, band_bins, pairs, square_sum; a row for each block a window's band lies in.

    The band of window i holds bins with start in [60s*(i-band+1), 60s*(i+1)],
    both ends inclusive. Adjacent differences inside a band are exactly the
    differences of consecutive bins of the device whose two members are both in
    the band, so one lag over the device series replaces a sort per band. The
    sums are collapsed per minute before they are spread over the band, which
    keeps a crowded minute as small as a quiet one.
    """
    series = previous_in_band(bins, band)
    minute = floor_index(F.col("start_ms"))
    on_edge = (F.pmod(F.col("start_ms"), F.lit(RESOLUTION_MS)) == 0).cast("bigint")
    step = F.col("bpm") - F.col("prev.bpm")
    marked = series.select(
        "device",
        "_block",
        (minute - on_edge).alias("lo"),
        (minute + F.lit(band - 1)).alias("hi"),
        (floor_index(F.col("prev.start_ms")) + F.lit(band - 1)).alias("pair_hi"),
        (step * step).alias("square"),
    )
    # Device and block are how the rows lie already: this grouping moves nothing.
    per_minute = marked.groupBy("device", "_block", "lo", "hi", "pair_hi").agg(
        F.count(F.lit(1)).alias("n"), F.sum("square").alias("square_sum")
    )
    spread = per_minute.withColumn("canonical_index", F.explode(F.sequence("lo", "hi")))
    paired = F.coalesce(F.col("canonical_index") <= F.col("pair_hi"), F.lit(False))
    return spread.groupBy("device", "_block", "canonical_index").agg(
        F.sum("n").alias("band_bins"),
        F.sum(F.when(paired, F.col("n")).otherwise(F.lit(0))).alias("pairs"),
        F.sum(F.when(paired, F.col("square_sum")).otherwise(F.lit(0.0))).alias("square_sum"),
    ).drop("_block")


def rolling_proxy(bins: DataFrame, candidates: DataFrame | None = None, band: int = PROXY_BAND_BINS) -> DataFrame:
    """Root mean square of adjacent differences per window with at least two bins in band.

    Without ``candidates`` (device, canonical_index) the windows holding a bin are used.
    """
    if candidates is None:
        candidates = bins.select("device", floor_index(F.col("start_ms")).alias("canonical_index"))
    marks = candidates.select(
        "device", "canonical_index", F.lit(0).cast("bigint").alias("band_bins"),
        F.lit(0).cast("bigint").alias("pairs"), F.lit(0.0).alias("square_sum"), F.lit(1).alias("wanted"),
    )
    parts = proxy_parts(bins, band).withColumn("wanted", F.lit(0)).unionByName(marks)
    sums = parts.groupBy("device", "canonical_index").agg(
        F.sum("band_bins").alias("bins_used"),
        F.sum("pairs").alias("pairs"),
        F.sum("square_sum").alias("square_sum"),
        F.max("wanted").alias("wanted"),
    )
    return sums.where("wanted = 1 and bins_used >= 2").select(
        "device",
        "canonical_index",
        round_stable(F.sqrt(F.col("square_sum") / F.col("pairs")), 3).alias("bpm"),
        "bins_used",
        F.lit(PROXY_METHOD).alias("method"),
    )


# --- aggregates of one window, each usable in a single groupBy ---------------


def hr_payload(bpm: Column, low: Column, high: Column) -> dict[str, Column]:
    return {
        "bpm": round_stable(F.avg(bpm), 3),
        "bpm_min": round_stable(F.min(low), 3),
        "bpm_max": round_stable(F.max(high), 3),
        "bins": F.count(bpm),
    }


def stress_payload(score: Column, is_reading: Column) -> dict[str, Column]:
    return {
        "readings": F.count_if(is_reading),
        "score": round_stable(F.avg(score), 2),
        "score_min": round_stable(F.min(score), 2),
        "score_max": round_stable(F.max(score), 2),
    }


def sleep_payload(code: Column) -> dict[str, Column]:
    """Stage codes are a short enumeration, so the set and the vote stay small."""
    return {
        "segments": F.count(code),
        "stage_codes": F.sort_array(F.collect_set(code)),
        "dominant_stage": F.mode(code, deterministic=True),
    }


LONG = {
    "bpm": "double", "bpm_min": "double", "bpm_max": "double",
    "band_bins": "bigint", "pairs": "bigint", "square_sum": "double",
    "sdnn_ms": "double", "rmssd_ms": "double",
    "score": "double", "segments": "bigint", "dominant_stage": "bigint",
}


def _long(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    filled = [
        (F.col(c) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in LONG.items()
    ]
    return df.select("device", "canonical_index", F.lit(kind).alias("kind"), *filled)


def candidate_windows(bins: DataFrame, hrv: DataFrame, stress: DataFrame, sleep: DataFrame) -> DataFrame:
    """Distinct windows touched by any modality."""
    parts = [
        bins.select("device", floor_index(F.col("start_ms")).alias("canonical_index")),
        expand_to_grid(hrv).select("device", "canonical_index"),
        stress.select("device", floor_index(F.col("start_ms")).alias("canonical_index")),
        expand_to_grid(sleep).select("device", "canonical_index"),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    return both.distinct()


def align_windows(bins: DataFrame, hrv: DataFrame, stress: DataFrame, sleep: DataFrame) -> DataFrame:
    """All modalities side by side, one row per device and window with data.

    One union and one groupBy over plain numbers take the place of a five-way
    full outer join, so the grouping stays a hash aggregate. HRV and sleep are
    reduced to one row per window first; only the stage lists, which are no
    numbers, are joined on, and both sides of that join already lie by window.
    The proxy counts only where a measured modality makes the window a
    candidate; its sums come by block and are added up in the same groupBy.
    ``bins`` must be de-duplicated.
    """
    window = ["device", "canonical_index"]
    first = F.min_by(F.struct("sdnn_ms", "rmssd_ms"), F.struct("source_file", "seq")).alias("first")
    hrv_windows = expand_to_grid(hrv).groupBy(*window).agg(first).select(*window, "first.sdnn_ms", "first.rmssd_ms")
    stages = sleep_payload(F.col("stage_code"))
    sleep_windows = expand_to_grid(sleep).groupBy(*window).agg(*[v.alias(k) for k, v in stages.items()])
    at_start = floor_index(F.col("start_ms"))
    rows = (
        _long(bins.withColumn("canonical_index", at_start), "heart_rate", ["bpm", "bpm_min", "bpm_max"])
        .unionByName(_long(proxy_parts(bins), "hrv_proxy", ["band_bins", "pairs", "square_sum"]))
        .unionByName(_long(hrv_windows, "hrv", ["sdnn_ms", "rmssd_ms"]))
        .unionByName(_long(stress.withColumn("canonical_index", at_start), "stress", ["score"]))
        .unionByName(_long(sleep_windows, "sleep_stage", ["segments", "dominant_stage"]))
    )
    is_kind = {k: F.col("kind") == k for k in ("heart_rate", "hrv", "stress", "sleep_stage")}
    heart = hr_payload(F.col("bpm"), F.col("bpm_min"), F.col("bpm_max"))
    readings = stress_payload(F.col("score"), is_kind["stress"])
    aggregates = {
        **{f"heart_rate_{k}": v for k, v in heart.items()},
        "_band_bins": F.sum("band_bins"),
        "_pairs": F.sum("pairs"),
        "_squares": F.sum("square_sum"),
        "_sdnn": F.max("sdnn_ms"),
        "_rmssd": F.max("rmssd_ms"),
        "_n_hrv": F.count_if(is_kind["hrv"]),
        **{f"stress_{k}": v for k, v in readings.items()},
        "sleep_stage_segments": F.max("segments"),
        "sleep_stage_dominant_stage": F.max("dominant_stage"),
        "_n_sleep": F.count_if(is_kind["sleep_stage"]),
        "_n_hr": F.count_if(is_kind["heart_rate"]),
    }
    wide = spread_by(rows, *window).groupBy(*window).agg(*[v.alias(k) for k, v in aggregates.items()])
    measured = wide.where((F.col("_n_hr") + F.col("_n_hrv") + F.col("stress_readings") + F.col("_n_sleep")) > 0)
    codes = sleep_windows.select(*window, F.col("stage_codes").alias("sleep_stage_stage_codes"))
    measured = measured.join(codes, window, "left")
    has_proxy = F.coalesce(F.col("_band_bins") >= 2, F.lit(False))

    def only(flag: Column, value: Column) -> Column:
        return F.when(flag, value)

    has = {
        "heart_rate": F.col("_n_hr") > 0,
        "hrv_proxy": has_proxy,
        "hrv": F.col("_n_hrv") > 0,
        "stress": F.col("stress_readings") > 0,
        "sleep_stage": F.col("_n_sleep") > 0,
    }
    start = F.col("canonical_index") * F.lit(RESOLUTION_MS)
    return measured.select(
        "device",
        "canonical_index",
        start.alias("start_ms"),
        (start + F.lit(RESOLUTION_MS)).alias("end_ms"),
        *[flag.alias(f"present_{m}") for m, flag in has.items()],
        *[F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"cov_{m}") for m, flag in has.items()],
        "heart_rate_bpm",
        "heart_rate_bpm_min",
        "heart_rate_bpm_max",
        only(has["heart_rate"], F.col("heart_rate_bins")).alias("heart_rate_bins"),
        only(has_proxy, round_stable(F.sqrt(F.col("_squares") / F.col("_pairs")), 3)).alias("hrv_proxy_bpm"),
        only(has_proxy, F.col("_band_bins")).alias("hrv_proxy_windows"),
        round_stable(F.col("_sdnn"), 2).alias("hrv_sdnn_ms"),
        round_stable(F.col("_rmssd"), 2).alias("hrv_rmssd_ms"),
        only(has["stress"], F.col("stress_readings")).alias("stress_readings"),
        "stress_score",
        "stress_score_min",
        "stress_score_max",
        "sleep_stage_segments",
        "sleep_stage_stage_codes",
        "sleep_stage_dominant_stage",
    )


def produce_windows(bins: DataFrame, hrv: DataFrame, stress: DataFrame, sleep: DataFrame) -> DataFrame:
    return align_windows(dedup_bins(bins), hrv, stress, sleep)
