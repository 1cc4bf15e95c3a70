"""Grid, signal and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.constants import MODALITIES
from chronogrid.functions.numbers import round_stable
from chronogrid.operators import grid, rollup, signals
from chronogrid.plans import bindings as b
from chronogrid.plans.registry import register

ROLL_COLUMNS = [
    "device", "span_id", "span_seconds", "span_start_ms", "span_end_ms", "windows_expected", "windows_present",
]
STAT_COLUMNS = [f"agg_{m}_{f}" for m, fields in rollup.STATS.items() for f in fields]
COVERAGE_COLUMNS = [f"{p}_{m}" for p in ("coverage", "partial") for m in MODALITIES]


def _cols(names: list[str]) -> str:
    return ", ".join(names)


@register("d07_rollup_multi_span", b.rollup_sql() + f"SELECT {_cols(ROLL_COLUMNS + ['artifact_id'])} FROM roll")
def d07(spark, sf_dir):
    return rollup.build_rollups(b.windows(spark, sf_dir)).select(*ROLL_COLUMNS, "artifact_id")


@register("d05_rollup_modality_stats", b.rollup_sql() + f"SELECT device, span_id, span_start_ms, {_cols(STAT_COLUMNS)} FROM roll")
def d05(spark, sf_dir):
    return rollup.build_rollups(b.windows(spark, sf_dir)).select("device", "span_id", "span_start_ms", *STAT_COLUMNS)


@register(
    "d06_dominant_stage_vote",
    b.rollup_sql(signals=b.SIGNALS_SHARED)
    + "SELECT span_id, span_start_ms, agg_sleep_stage_dominant_stage FROM roll WHERE agg_sleep_stage_dominant_stage IS NOT NULL",
)
def d06(spark, sf_dir):
    rolled = rollup.build_rollups(b.windows(spark, sf_dir, shared=True))
    return rolled.select("span_id", "span_start_ms", "agg_sleep_stage_dominant_stage").where(
        "agg_sleep_stage_dominant_stage is not null"
    )


@register("d08_coverage_partial", b.rollup_sql() + f"SELECT device, span_id, span_start_ms, {_cols(COVERAGE_COLUMNS)} FROM roll")
def d08(spark, sf_dir):
    return rollup.build_rollups(b.windows(spark, sf_dir)).select("device", "span_id", "span_start_ms", *COVERAGE_COLUMNS)


@register("d09_quality_tier", b.rollup_sql() + "SELECT device, span_id, span_start_ms, quality, quality_tier FROM roll")
def d09(spark, sf_dir):
    return rollup.build_rollups(b.windows(spark, sf_dir)).select(
        "device", "span_id", "span_start_ms", "quality", "quality_tier"
    )




@register(
    "d10_missingness_block",
    b.rollup_sql()
    + "SELECT device, span_id, span_start_ms, array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN coverage_{m} > 0 THEN NULL ELSE '{m}' END" for m in MODALITIES
    ) + "], lambda x: x IS NOT NULL), ',') AS missing, " + ", ".join(f"coverage_{m} AS map_{m}" for m in MODALITIES) + " FROM roll",
)
def d10(spark, sf_dir):
    rolled = rollup.build_rollups(b.windows(spark, sf_dir))
    block = rollup.missingness(
        {m: F.col(f"coverage_{m}") > 0 for m in MODALITIES}, {m: F.col(f"coverage_{m}") for m in MODALITIES}
    )
    with_block = rolled.select("device", "span_id", "span_start_ms", block.alias("m"))
    return with_block.select(
        "device", "span_id", "span_start_ms",
        F.array_join("m.missing_modalities", ",").alias("missing"),
        *[F.col(f"m.modality_coverage")[m].alias(f"map_{m}") for m in MODALITIES],
    )


@register(
    "d11_lineage_collect",
    b.rollup_sql()
    + """SELECT device, span_id, span_start_ms, count(*) AS n_members,
     string_agg('wearable.win.' || canonical_index, ',' ORDER BY start_ms) AS member_ids
     FROM x GROUP BY device, span_id, span_start_ms""",
)
def d11(spark, sf_dir):
    windows = b.windows(spark, sf_dir).withColumn(
        "artifact_id", F.concat(F.lit("wearable.win."), F.col("canonical_index").cast("string"))
    )
    rolled = rollup.build_rollups(windows, with_members=True)
    return rolled.select(
        "device", "span_id", "span_start_ms",
        F.size("members").cast("bigint").alias("n_members"),
        F.array_join("members", ",").alias("member_ids"),
    )


@register(
    "c02_interval_to_grid",
    f"""WITH obs AS ({b.OBS}) SELECT event_id, device, modality,
     unnest(range(start_ms // 60000, greatest(end_ms - 1, start_ms) // 60000 + 1)) AS canonical_index FROM obs""",
)
def c02(spark, sf_dir):
    return grid.expand_to_grid(b.obs(spark, sf_dir)).select("event_id", "device", "modality", "canonical_index")


@register(
    "c03_point_to_grid",
    f"WITH obs AS ({b.OBS}) SELECT event_id, device, modality, start_ms // 60000 AS canonical_index FROM obs",
)
def c03(spark, sf_dir):
    return grid.point_to_grid(b.obs(spark, sf_dir)).select("event_id", "device", "modality", "canonical_index")


_CELLS = f"""obs AS ({b.OBS}), cells AS (SELECT *,
  unnest(range(start_ms // 60000, greatest(end_ms - 1, start_ms) // 60000 + 1)) AS i FROM obs),
shares AS (SELECT *, greatest(0.0, least(1.0,
  (least(end_ms, i * 60000 + 60000) - greatest(start_ms, i * 60000))::DOUBLE / 60000.0::DOUBLE)) AS share FROM cells)"""


@register(
    "c04_overlap_coverage",
    f"""WITH {_CELLS} SELECT device, modality, i AS canonical_index, {b.rnd('max(share)', 6)} AS coverage,
     max(share) > 0 AS present FROM shares GROUP BY ALL""",
)
def c04(spark, sf_dir):
    return grid.rounded_coverage(grid.overlap_coverage(b.obs(spark, sf_dir), ["device", "modality"]))


@register(
    "c04_cell_sources",
    f"""WITH {_CELLS} SELECT device, modality, i AS canonical_index, k AS source_id, min(start_ms) AS first_start_ms,
     arg_min(event_id, (start_ms, event_id)) AS first_event_id FROM shares GROUP BY device, modality, i, k""",
)
def c04_sources(spark, sf_dir):
    rows = b.obs(spark, sf_dir).withColumnRenamed("k", "source_id")
    return grid.cell_sources(rows, ["device", "modality"], "source_id", ["start_ms", "event_id"])


@register(
    "c05_merge_aligned",
    f"""WITH {_CELLS}, parts AS (SELECT device, i, modality, max(share) AS c FROM shares
       WHERE modality IN ('heart_rate', 'sleep_stage') GROUP BY ALL)
     SELECT device, i AS canonical_index, bool_or(c > 0) AS present, {b.rnd('max(c)', 6)} AS coverage FROM parts GROUP BY ALL""",
)
def c05(spark, sf_dir):
    base = grid.overlap_coverage(b.obs(spark, sf_dir, modality="heart_rate"), ["device"])
    extra = grid.overlap_coverage(b.obs(spark, sf_dir, modality="sleep_stage"), ["device"])
    return grid.rounded_coverage(grid.merge_aligned(base, extra, ["device"]))


@register(
    "g05_source_union",
    f"""WITH {_CELLS}, parts AS (SELECT device, i, k, CASE modality WHEN 'heart_rate' THEN 0 ELSE 1 END AS side,
       min(start_ms) AS s FROM shares WHERE modality IN ('heart_rate', 'sleep_stage') GROUP BY ALL)
     SELECT device, i AS canonical_index, k AS source_id, min(side) AS first_side,
       arg_min(s, (side, s)) AS first_start_ms FROM parts GROUP BY device, i, k""",
)
def g05(spark, sf_dir):
    heart = b.obs(spark, sf_dir, modality="heart_rate").withColumnRenamed("k", "source_id")
    sleep = b.obs(spark, sf_dir, modality="sleep_stage").withColumnRenamed("k", "source_id")
    base = grid.cell_sources(heart, ["device"], "source_id", ["start_ms"])
    extra = grid.cell_sources(sleep, ["device"], "source_id", ["start_ms"])
    return grid.merge_sources(base, extra, ["device"], "source_id", ["start_ms"])


@register(
    "h11_span_coverage",
    f"WITH {_CELLS} SELECT event_id, i AS canonical_index, {b.rnd('share', 6)} AS coverage FROM shares",
)
def h11(spark, sf_dir):
    cells = grid.expand_to_grid(b.obs(spark, sf_dir))
    share = grid.overlap_share(F.col("start_ms"), F.col("end_ms"), F.col("canonical_index"))
    return cells.select("event_id", "canonical_index", round_stable(share, 6).alias("coverage"))


@register("g01_candidate_windows", b.windows_sql() + "SELECT device, i AS canonical_index FROM cand")
def g01(spark, sf_dir):
    return signals.candidate_windows(
        b.bins(spark, sf_dir), b.hrv(spark, sf_dir), b.stress(spark, sf_dir), b.sleep(spark, sf_dir)
    )


@register(
    "d01_hr_window_payload",
    f"""WITH {b.SIGNALS} SELECT device, start_ms // 60000 AS canonical_index, {b.rnd('avg(bpm)', 3)} AS bpm,
      {b.rnd('min(bpm_min)', 3)} AS bpm_min, {b.rnd('max(bpm_max)', 3)} AS bpm_max, count(*) AS bins FROM bins GROUP BY ALL""",
)
def d01(spark, sf_dir):
    rows = grid.point_to_grid(b.bins(spark, sf_dir))
    payload = signals.hr_payload(F.col("bpm"), F.col("bpm_min"), F.col("bpm_max"))
    return rows.groupBy("device", "canonical_index").agg(*[v.alias(k) for k, v in payload.items()])


@register(
    "d02_hrv_window_payload",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT device, i AS canonical_index, sdnn_ms, rmssd_ms, true AS derived_by_watch FROM hrv_w",
)
def d02(spark, sf_dir):
    rows = grid.expand_to_grid(b.hrv(spark, sf_dir, shared=True))
    first = F.min_by(F.struct("sdnn_ms", "rmssd_ms"), F.struct("source_file", "seq")).alias("h")
    return rows.groupBy("device", "canonical_index").agg(first).select(
        "device", "canonical_index",
        round_stable(F.col("h.sdnn_ms"), 2).alias("sdnn_ms"),
        round_stable(F.col("h.rmssd_ms"), 2).alias("rmssd_ms"),
        F.lit(True).alias("derived_by_watch"),
    )


@register(
    "d03_stress_window_payload",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT device, i AS canonical_index, readings, score, score_min, score_max FROM stress_w",
)
def d03(spark, sf_dir):
    rows = grid.point_to_grid(b.stress(spark, sf_dir, shared=True))
    payload = signals.stress_payload(F.col("score"), F.lit(True))
    return rows.groupBy("device", "canonical_index").agg(*[v.alias(k) for k, v in payload.items()])


@register(
    "d04_sleep_window_payload",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT device, i AS canonical_index, segments, codes AS stage_codes, dominant AS dominant_stage FROM sleep_w",
)
def d04(spark, sf_dir):
    rows = grid.expand_to_grid(b.sleep(spark, sf_dir, shared=True))
    payload = signals.sleep_payload(F.col("stage_code"))
    grouped = rows.groupBy("device", "canonical_index").agg(*[v.alias(k) for k, v in payload.items()])
    return grouped.withColumn("stage_codes", F.array_join(F.col("stage_codes").cast("array<string>"), ","))


@register(
    "e01_dedup_bins",
    b.windows_sql(b.SIGNALS_SHARED) + "SELECT device, start_ms, end_ms, bpm, seq FROM dedup",
)
def e01(spark, sf_dir):
    return signals.dedup_bins(b.bins(spark, sf_dir, shared=True)).select("device", "start_ms", "end_ms", "bpm", "seq")


@register(
    "e01_removed_count",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT (SELECT count(*) FROM bins) - (SELECT count(*) FROM dedup) AS removed, (SELECT count(*) FROM dedup) AS kept",
)
def e01_removed(spark, sf_dir):
    kept = signals.dedup_bins(b.bins(spark, sf_dir, shared=True))
    return kept.agg(
        (F.sum("copies") - F.count(F.lit(1))).alias("removed"), F.count(F.lit(1)).alias("kept")
    )


@register(
    "c06_trailing_band",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT device, i AS canonical_index, count(*) AS bins_in_band FROM band GROUP BY ALL",
)
def c06(spark, sf_dir):
    bins = signals.dedup_bins(b.bins(spark, sf_dir, shared=True))
    candidates = signals.candidate_windows(
        bins, b.hrv(spark, sf_dir, True), b.stress(spark, sf_dir, True), b.sleep(spark, sf_dir, True)
    )
    band = signals.proxy_parts(bins).groupBy("device", "canonical_index").agg(F.sum("band_bins").alias("bins_in_band"))
    return band.where("bins_in_band > 0").join(candidates, ["device", "canonical_index"], "left_semi")


@register(
    "e02_rolling_proxy",
    b.windows_sql(b.SIGNALS_SHARED)
    + "SELECT device, i AS canonical_index, bpm, bins_used, 'rolling_rmssd_60s' AS method FROM proxy",
)
def e02(spark, sf_dir):
    bins = signals.dedup_bins(b.bins(spark, sf_dir, shared=True))
    candidates = signals.candidate_windows(
        bins, b.hrv(spark, sf_dir, True), b.stress(spark, sf_dir, True), b.sleep(spark, sf_dir, True)
    )
    return signals.rolling_proxy(bins, candidates)


WINDOW_COLUMNS = [
    "device", "canonical_index", "start_ms", "end_ms", *[f"present_{m}" for m in MODALITIES],
    "heart_rate_bpm", "heart_rate_bpm_min", "heart_rate_bpm_max", "heart_rate_bins", "hrv_proxy_bpm", "hrv_proxy_windows",
    "hrv_sdnn_ms", "hrv_rmssd_ms", "stress_readings", "stress_score", "stress_score_min", "stress_score_max",
    "sleep_stage_segments", "sleep_stage_stage_codes", "sleep_stage_dominant_stage",
]


def _flat_codes(df):
    codes = F.array_join(F.col("sleep_stage_stage_codes").cast("array<string>"), ",")
    return df.withColumn("sleep_stage_stage_codes", codes)


@register("c01_align_modalities", b.windows_sql() + f"SELECT {_cols(WINDOW_COLUMNS)} FROM win")
def c01(spark, sf_dir):
    return _flat_codes(b.windows(spark, sf_dir)).select(*WINDOW_COLUMNS)


@register(
    "c01_align_modalities_shared", b.windows_sql(b.SIGNALS_SHARED) + f"SELECT {_cols(WINDOW_COLUMNS)} FROM win"
)
def c01_shared(spark, sf_dir):
    return _flat_codes(b.windows(spark, sf_dir, shared=True)).select(*WINDOW_COLUMNS)


@register(
    "g03_missing_modalities",
    b.windows_sql() + "SELECT device, canonical_index, array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN present_{m} THEN NULL ELSE '{m}' END" for m in MODALITIES
    ) + "], lambda x: x IS NOT NULL), ',') AS missing FROM win",
)
def g03(spark, sf_dir):
    missing = rollup.missing_modalities({m: F.col(f"present_{m}") for m in MODALITIES})
    return b.windows(spark, sf_dir).select("device", "canonical_index", F.array_join(missing, ",").alias("missing"))
