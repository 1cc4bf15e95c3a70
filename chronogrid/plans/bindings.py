"""How the supplied tables stand in for device exports and record stores.

``events`` are sensor records: the event type names the modality, ``k`` in
``props`` the length in seconds. Each binding has a SQL twin used by the
statements in the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DEVICE = "all"
NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, the injected clock of every view query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_ms(naive: Column) -> Column:
    return F.unix_millis(naive.cast("timestamp"))


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def modality_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", F.lit("heart_rate"))
        .when(event_type == "click", F.lit("hrv"))
        .when(event_type == "purchase", F.lit("stress"))
        .when(event_type == "error", F.lit("sleep_stage"))
        .otherwise(F.lit("journal"))
    )


EVENT_TYPE = {"heart_rate": "view", "hrv": "click", "stress": "purchase", "sleep_stage": "error"}


def obs(spark: SparkSession, sf_dir: str, shared: bool = False, modality: str | None = None) -> DataFrame:
    """device, start_ms, end_ms, modality, value, k, event_id; one modality is filtered in the scan."""
    start = utc_ms(F.col("ts"))
    device = F.lit(SHARED_DEVICE) if shared else F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events")
    if modality is not None:
        rows = rows.where(F.col("event_type") == EVENT_TYPE[modality])
    return rows.select(
        device.alias("device"),
        start.alias("start_ms"),
        (start + F.lit(1000) * k_of(F.col("props"))).alias("end_ms"),
        modality_of(F.col("event_type")).alias("modality"),
        "value",
        k_of(F.col("props")).alias("k"),
        "event_id",
    )


OBS = """
SELECT cast(user_id AS VARCHAR) AS device, epoch_us(ts) // 1000 AS start_ms,
       epoch_us(ts) // 1000 + 1000 * json_extract(props, '$.k')::BIGINT AS end_ms,
       CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'hrv' WHEN 'purchase' THEN 'stress'
                       WHEN 'error' THEN 'sleep_stage' ELSE 'journal' END AS modality,
       value, json_extract(props, '$.k')::BIGINT AS k, event_id
FROM events
"""
OBS_SHARED = OBS.replace("cast(user_id AS VARCHAR) AS device", "'all' AS device")


def bins(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    rows = obs(spark, sf_dir, shared, "heart_rate")
    return rows.select(
        "device", "start_ms", "end_ms",
        F.col("value").alias("bpm"),
        (F.col("value") - 1).alias("bpm_min"),
        (F.col("value") + F.col("k")).alias("bpm_max"),
        F.col("event_id").alias("seq"),
    )


def hrv(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    rows = obs(spark, sf_dir, shared, "hrv")
    return rows.select(
        "device", "start_ms", "end_ms",
        F.col("value").alias("sdnn_ms"),
        (F.col("value") + F.col("k")).alias("rmssd_ms"),
        F.lit("hrv.json").alias("source_file"),
        F.col("event_id").alias("seq"),
    )


def stress(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """A reading of zero seconds carries no score."""
    rows = obs(spark, sf_dir, shared, "stress")
    return rows.select(
        "device", "start_ms", "end_ms",
        F.when(F.col("k") > 0, F.col("value")).alias("score"),
        F.col("event_id").alias("seq"),
    )


def sleep(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Stage codes 40001-40004 from the record length."""
    rows = obs(spark, sf_dir, shared, "sleep_stage")
    return rows.select(
        "device", "start_ms", "end_ms",
        (F.lit(40001) + F.pmod(F.col("k"), F.lit(4))).cast("bigint").alias("stage_code"),
        F.col("event_id").alias("seq"),
    )


def _cte(source: str) -> str:
    return f"""
obs AS ({source}),
bins AS (SELECT device, start_ms, end_ms, value AS bpm, value - 1 AS bpm_min, value + k AS bpm_max, event_id AS seq
         FROM obs WHERE modality = 'heart_rate'),
hrv AS (SELECT device, start_ms, end_ms, value AS sdnn_ms, value + k AS rmssd_ms, event_id AS seq
        FROM obs WHERE modality = 'hrv'),
stress AS (SELECT device, start_ms, end_ms, CASE WHEN k > 0 THEN value END AS score, event_id AS seq
           FROM obs WHERE modality = 'stress'),
sleep AS (SELECT device, start_ms, end_ms, 40001 + k % 4 AS stage_code, event_id AS seq
          FROM obs WHERE modality = 'sleep_stage')"""


SIGNALS = _cte(OBS)
SIGNALS_SHARED = _cte(OBS_SHARED)


def rnd(expression: str, digits: int) -> str:
    """SQL twin of ``round_stable``."""
    return f"(round(({expression}) + sign({expression}) * 1e-{digits + 6}, {digits}) + 0.0)"


def windows_sql(signals: str = SIGNALS) -> str:
    """WITH list ending in ``win``: the aligned windows of all modalities."""
    return f"""WITH {signals},
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY device, start_ms // 60000, round(bpm, 3), round(bpm_min, 3), round(bpm_max, 3)
            ORDER BY start_ms, end_ms, seq) AS rn FROM bins) WHERE rn = 1),
hr AS (SELECT device, start_ms // 60000 AS i, {rnd('avg(bpm)', 3)} AS bpm, {rnd('min(bpm_min)', 3)} AS bpm_min,
              {rnd('max(bpm_max)', 3)} AS bpm_max, count(*) AS bins FROM dedup GROUP BY ALL),
hrv_x AS (SELECT device, unnest(range(start_ms // 60000, greatest(end_ms - 1, start_ms) // 60000 + 1)) AS i,
                 sdnn_ms, rmssd_ms, seq FROM hrv),
hrv_w AS (SELECT device, i, {rnd('min_by(sdnn_ms, seq)', 2)} AS sdnn_ms, {rnd('min_by(rmssd_ms, seq)', 2)} AS rmssd_ms,
                 count(*) AS n FROM hrv_x GROUP BY ALL),
stress_w AS (SELECT device, start_ms // 60000 AS i, count(*) AS readings, {rnd('avg(score)', 2)} AS score,
                    {rnd('min(score)', 2)} AS score_min, {rnd('max(score)', 2)} AS score_max FROM stress GROUP BY ALL),
sleep_x AS (SELECT device, unnest(range(start_ms // 60000, greatest(end_ms - 1, start_ms) // 60000 + 1)) AS i,
                   stage_code FROM sleep),
sleep_n AS (SELECT device, i, stage_code, count(*) AS n FROM sleep_x GROUP BY ALL),
sleep_w AS (SELECT device, i, sum(n)::BIGINT AS segments, string_agg(stage_code::VARCHAR, ',' ORDER BY stage_code) AS codes,
                   arg_max(stage_code, n * 100000 - stage_code) AS dominant FROM sleep_n GROUP BY ALL),
cand AS (SELECT device, i FROM hr UNION SELECT device, i FROM hrv_w UNION SELECT device, i FROM stress_w
         UNION SELECT device, i FROM sleep_w),
band AS (SELECT c.device, c.i, b.bpm - lag(b.bpm) OVER (PARTITION BY c.device, c.i ORDER BY b.start_ms, b.end_ms, b.seq) AS d
         FROM cand c JOIN dedup b ON b.device = c.device
          AND b.start_ms BETWEEN (c.i - 9) * 60000 AND (c.i + 1) * 60000),
proxy AS (SELECT device, i, {rnd('sqrt(avg(d * d))', 3)} AS bpm, count(*) AS bins_used FROM band
          GROUP BY ALL HAVING count(*) >= 2),
win AS (SELECT c.device, c.i AS canonical_index, c.i * 60000 AS start_ms, (c.i + 1) * 60000 AS end_ms,
   hr.i IS NOT NULL AS present_heart_rate, p.i IS NOT NULL AS present_hrv_proxy, v.i IS NOT NULL AS present_hrv,
   s.i IS NOT NULL AS present_stress, z.i IS NOT NULL AS present_sleep_stage,
   hr.bpm AS heart_rate_bpm, hr.bpm_min AS heart_rate_bpm_min, hr.bpm_max AS heart_rate_bpm_max, hr.bins AS heart_rate_bins,
   p.bpm AS hrv_proxy_bpm, p.bins_used AS hrv_proxy_windows, v.sdnn_ms AS hrv_sdnn_ms, v.rmssd_ms AS hrv_rmssd_ms,
   s.readings AS stress_readings, s.score AS stress_score, s.score_min AS stress_score_min, s.score_max AS stress_score_max,
   z.segments AS sleep_stage_segments, z.codes AS sleep_stage_stage_codes, z.dominant AS sleep_stage_dominant_stage
 FROM cand c LEFT JOIN hr ON hr.device = c.device AND hr.i = c.i
   LEFT JOIN proxy p ON p.device = c.device AND p.i = c.i
   LEFT JOIN hrv_w v ON v.device = c.device AND v.i = c.i
   LEFT JOIN stress_w s ON s.device = c.device AND s.i = c.i
   LEFT JOIN sleep_w z ON z.device = c.device AND z.i = c.i)
"""


def windows(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    from chronogrid.operators.signals import produce_windows

    return produce_windows(
        bins(spark, sf_dir, shared), hrv(spark, sf_dir, shared), stress(spark, sf_dir, shared), sleep(spark, sf_dir, shared)
    )


def rollup_sql(spans: tuple[tuple[str, int], ...] = (("5m", 300), ("1h", 3600), ("1d", 86400)), signals: str = SIGNALS) -> str:
    """WITH list ending in ``roll``: rollups of the aligned windows."""
    values = ", ".join(f"('{i}', {s}::BIGINT)" for i, s in spans)
    names = ("heart_rate", "hrv_proxy", "hrv", "stress", "sleep_stage")
    cov = ", ".join(
        f"{rnd(f'count(*) FILTER (WHERE present_{m}) / greatest(1, span_seconds // 60)::DOUBLE', 4)} AS coverage_{m}" for m in names
    )
    part = ", ".join(f"(coverage_{m} > 0 AND coverage_{m} < 0.5) AS partial_{m}" for m in names)
    total = " + ".join(f"coverage_{m}" for m in names)
    return windows_sql(signals) + f""", spans(span_id, span_seconds) AS (VALUES {values}),
x AS (SELECT w.*, s.*, start_ms - start_ms % (span_seconds * 1000) AS span_start_ms FROM win w CROSS JOIN spans s),
votes AS (SELECT device, span_id, span_start_ms, sleep_stage_dominant_stage::VARCHAR AS v, count(*) AS n FROM x
          WHERE present_sleep_stage GROUP BY ALL),
top AS (SELECT device, span_id, span_start_ms, v FROM (SELECT *, row_number() OVER (
          PARTITION BY device, span_id, span_start_ms ORDER BY n DESC, v) AS rn FROM votes) WHERE rn = 1),
base AS (SELECT device, span_id, span_seconds, span_start_ms, span_start_ms + span_seconds * 1000 AS span_end_ms,
   greatest(1, span_seconds // 60)::BIGINT AS windows_expected, count(*) AS windows_present, {cov},
   {rnd('avg(heart_rate_bpm)', 3)} AS agg_heart_rate_bpm, {rnd('min(heart_rate_bpm_min)', 3)} AS agg_heart_rate_bpm_min,
   {rnd('max(heart_rate_bpm_max)', 3)} AS agg_heart_rate_bpm_max, sum(heart_rate_bins)::BIGINT AS agg_heart_rate_bins,
   {rnd('avg(hrv_proxy_bpm)', 3)} AS agg_hrv_proxy_bpm, {rnd('avg(hrv_sdnn_ms)', 3)} AS agg_hrv_sdnn_ms,
   {rnd('avg(hrv_rmssd_ms)', 3)} AS agg_hrv_rmssd_ms, {rnd('avg(stress_score)', 3)} AS agg_stress_score,
   sum(stress_readings)::BIGINT AS agg_stress_readings, sum(sleep_stage_segments)::BIGINT AS agg_sleep_stage_segments
 FROM x GROUP BY device, span_id, span_seconds, span_start_ms),
roll0 AS (SELECT b.*, t.v AS agg_sleep_stage_dominant_stage, {part}, {rnd(f'({total}) / 5', 4)} AS quality
  FROM base b LEFT JOIN top t USING (device, span_id, span_start_ms)),
roll AS (SELECT *, CASE WHEN quality >= 0.67 THEN 'high' WHEN quality >= 0.34 THEN 'medium' ELSE 'low' END AS quality_tier,
   'wearable.rollup.' || span_seconds || 's.' || span_start_ms AS artifact_id FROM roll0)
"""
