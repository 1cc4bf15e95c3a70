"""Sources, sinks and jobs over files that Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.constants import HR_DIR, HRV_DIR, MODALITIES, NOTE_ID_PREFIX, SLEEP_STAGE_CSV, STRESS_CSV
from chronogrid.functions import ids
from chronogrid.operators import rollup, state
from chronogrid.plans import bindings as b
from chronogrid.plans import jobs
from chronogrid.plans.registry import register
from chronogrid.plans.windows_catalog import STAT_COLUMNS
from chronogrid.session import scratch_path
from chronogrid.sinks import tables
from chronogrid.sources import exports
from chronogrid.sources import records as record_source

EV = "epoch_us(ts) // 1000"
GENERATED = "2024-02-01T00:00:00.000Z"


def one_value_per_file(df, path):
    """Each text becomes a file of its own, unquoted, with the ``.json`` ending of an export."""
    writer = df.write.option("maxRecordsPerFile", 1).option("extension", "json")
    writer.option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).csv(path)
    return path


def json_arrays(rows, fields, per_file=4096):
    """Arrays of at most ``per_file`` consecutive records, one text per file."""
    group = F.floor(F.col("event_id") / per_file).alias("g")
    items = F.sort_array(F.collect_list(F.struct("event_id", *[c.alias(n) for n, c in fields.items()])))
    arrays = rows.groupBy(group).agg(F.to_json(items).alias("value"))
    return arrays.orderBy("g").select("value")


def hr_fields():
    return {
        "start_time": F.col("start_ms"), "end_time": F.col("end_ms"), "heart_rate": F.col("value"),
        "heart_rate_min": F.col("value") - 1, "heart_rate_max": F.col("value") + F.col("k"),
    }


def hrv_fields():
    return {
        "start_time": F.col("start_ms"), "end_time": F.col("end_ms"), "sdnn": F.col("value"),
        "rmssd": F.col("value") + F.col("k"),
    }


@register(
    "a01_record_scan",
    "SELECT 'ev-' || event_id AS artifact_id, event_type AS kind FROM events WHERE event_type <> 'error'",
)
def a01(spark, sf_dir):
    """Records and some malformed lines are written by source, then one source folder is missing and the root is scanned."""
    good = F.to_json(F.struct(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("artifactId"), "event_type"))
    line = F.when(F.col("event_type") == "error", F.lit('["not", "an object"]')).otherwise(good)
    path = scratch_path(spark, "records")
    b.table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_type").alias("by_source")).write.partitionBy(
        "by_source"
    ).text(path)
    found = record_source.scan_records(spark, path, "absent", layout="lines")
    return found.select(
        F.get_json_object("raw", "$.artifactId").alias("artifact_id"), F.get_json_object("raw", "$.event_type").alias("kind")
    )


@register(
    "a02_window_scan",
    b.windows_sql()
    + """SELECT device, 'wearable.win.' || canonical_index AS artifact_id, canonical_index, start_ms, end_ms, present_hrv_proxy,
         heart_rate_bpm, hrv_sdnn_ms, stress_readings, sleep_stage_dominant_stage::VARCHAR AS sleep_stage_dominant_stage FROM win""",
)
def a02(spark, sf_dir):
    """Windows written as records, mixed with records of another kind, and read back."""
    rows = rollup.window_records(b.windows(spark, sf_dir), "chronogrid")
    other = rows.withColumn("payload", F.lit('{"kind":"url"}'))
    path = scratch_path(spark, "windows")
    tables.write_records(rows, f"{path}/kept", "source")
    tables.write_records(other, f"{path}/other", "source")
    loaded = record_source.load_windows(record_source.scan_records(spark, path, layout="lines"))
    return loaded.select(
        "device", "artifact_id", "canonical_index", "start_ms", "end_ms", "present_hrv_proxy", "heart_rate_bpm",
        "hrv_sdnn_ms", "stress_readings", "sleep_stage_dominant_stage",
    )


@register(
    "a03_hr_json_arrays",
    f"WITH {b.SIGNALS} SELECT start_ms, end_ms, bpm, bpm_min, bpm_max FROM bins",
)
def a03(spark, sf_dir):
    path = one_value_per_file(json_arrays(b.obs(spark, sf_dir, modality="heart_rate"), hr_fields()), scratch_path(spark, "hr"))
    return exports.read_hr_bins(spark, path).select("start_ms", "end_ms", "bpm", "bpm_min", "bpm_max")


@register(
    "a04_hrv_json_arrays",
    f"WITH {b.SIGNALS} SELECT start_ms, end_ms, sdnn_ms, rmssd_ms FROM hrv",
)
def a04(spark, sf_dir):
    path = one_value_per_file(json_arrays(b.obs(spark, sf_dir, modality="hrv"), hrv_fields()), scratch_path(spark, "hrv"))
    return exports.read_hrv_windows(spark, path).select("start_ms", "end_ms", "sdnn_ms", "rmssd_ms")


def _sheet(rows, header, *cells):
    """Lines of one sheet per device: a banner, the header and one line per record."""
    users = rows.select(F.col("device").alias("path")).distinct()

    def order(place, within):
        return F.struct(F.lit(place).alias("block"), within.alias("line"))

    zero = F.lit(0).cast("bigint")
    banner = users.select("path", F.lit("﻿com.vendor.sheet,7006003,9").alias("line"), order(0, zero).alias("order"))
    names = users.select("path", F.lit(header).alias("line"), order(1, zero).alias("order"))
    data = rows.select(
        F.col("device").alias("path"), F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("line"),
        order(2, F.col("event_id")).alias("order"),
    )
    return banner.unionByName(names).unionByName(data)


def sheet_time(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


@register(
    "a05_banner_sheet",
    f"SELECT user_id::VARCHAR AS path, event_id::VARCHAR AS id, event_type AS note FROM events",
)
def a05(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").withColumn("device", F.col("user_id").cast("string"))
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    lines = _sheet(rows, "start_time,id,note", F.col("ts"), F.col("event_id"), quoted)
    return exports.sheet_rows(lines).select("path", exports._cell("id").alias("id"), exports._cell("note").alias("note"))


@register(
    "a06_stress_sheet",
    f"""WITH {b.SIGNALS} SELECT device AS source_file, start_ms + 14400000 AS start_ms,
        CASE WHEN score IS NULL THEN start_ms ELSE end_ms END + 14400000 AS end_ms, score FROM stress""",
)
def a06(spark, sf_dir):
    """A blank score also leaves out the end, which then falls back to the start."""
    rows = b.obs(spark, sf_dir, modality="stress")
    end = F.when(F.col("k") > 0, sheet_time(F.col("end_ms")))
    score = F.when(F.col("k") > 0, F.col("value"))
    lines = _sheet(rows, "start_time,end_time,time_offset,score", sheet_time(F.col("start_ms")), end, F.lit("UTC-0400"), score)
    return exports.stress_sheet(lines, "utc").select("source_file", "start_ms", "end_ms", "score")


@register(
    "a07_sleep_sheet",
    f"""WITH {b.SIGNALS} SELECT device AS source_file, start_ms, end_ms, stage_code::DOUBLE AS sleep_score, CAST(NULL AS DOUBLE) AS efficiency,
        stage_code % 10 AS sleep_type FROM sleep""",
)
def a07(spark, sf_dir):
    rows = b.obs(spark, sf_dir, modality="sleep_stage")
    code = F.lit(40001) + F.pmod(F.col("k"), F.lit(4))
    prefix = "com.samsung.health.sleep."
    header = f"{prefix}start_time,{prefix}end_time,{prefix}time_offset,sleep_score,{prefix}sleep_type,efficiency"
    lines = _sheet(
        rows, header, sheet_time(F.col("start_ms")), sheet_time(F.col("end_ms")), F.lit(""), code,
        F.concat(F.pmod(code, F.lit(10)).cast("string"), F.lit(".7")), F.lit(""),
    )
    return exports.sleep_sheet(lines, "utc").select("source_file", "start_ms", "end_ms", "sleep_score", "efficiency", "sleep_type")


@register(
    "a08_sleep_stage_sheet",
    f"WITH {b.SIGNALS}, o AS (SELECT * FROM obs WHERE modality = 'sleep_stage' AND k <> 0) SELECT device AS source_file, start_ms, end_ms, 40001 + k % 4 AS stage_code FROM o",
)
def a08(spark, sf_dir):
    """Rows of zero length carry no stage and are dropped."""
    rows = b.obs(spark, sf_dir, modality="sleep_stage")
    code = F.when(F.col("k") > 0, F.concat((F.lit(40001) + F.pmod(F.col("k"), F.lit(4))).cast("string"), F.lit(".0")))
    lines = _sheet(rows, "start_time,end_time,stage", sheet_time(F.col("start_ms")), sheet_time(F.col("end_ms")), code)
    return exports.sleep_stage_sheet(lines, "utc").select("source_file", "start_ms", "end_ms", "stage_code")


@register(
    "a09_discover_dispatch",
    f"""SELECT doc_id, CASE lang WHEN 'en' THEN '{HR_DIR}' || source || '/' || doc_id || '.json' WHEN 'fr' THEN '{HR_DIR}' || doc_id || '.json'
          WHEN 'de' THEN '{HRV_DIR}' || doc_id || '.json' ELSE source || '.csv' END AS rel_path,
        CASE lang WHEN 'en' THEN 'hr_json' WHEN 'fr' THEN 'hr_json' WHEN 'de' THEN 'hrv_json' ELSE 'unknown' END AS kind FROM documents""",
)
def a09(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    below = (
        F.when(F.col("lang") == "en", F.concat(F.lit(HR_DIR), "source", F.lit("/"), number, F.lit(".json")))
        .when(F.col("lang") == "fr", F.concat(F.lit("hr_bins/"), number, F.lit(".json")))
        .when(F.col("lang") == "de", F.concat(F.lit(HRV_DIR), number, F.lit(".json")))
        .otherwise(F.concat("source", F.lit(".csv")))
    )
    files = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/export/"), number).alias("path"), below.alias("below_root")
    )
    return exports.discover(files.unionByName(files)).select("doc_id", "rel_path", "kind")


@register("a10_visit_import", "SELECT page_id, url FROM pages")
def a10(spark, sf_dir):
    """Arrays of sixteen pages, exploded to visits."""
    group = F.floor(F.col("page_id") / 16).alias("g")
    files = b.table(spark, sf_dir, "pages").groupBy(group).agg(
        F.to_json(F.collect_list(F.struct("page_id", "url"))).alias("text")
    )
    return record_source.explode_visits(files).select(
        F.get_json_object("raw", "$.page_id").cast("bigint").alias("page_id"), F.get_json_object("raw", "$.url").alias("url")
    )


@register(
    "a11_counter_xml",
    "SELECT event_type || '-' || event_id AS name, CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS value, "
    "CASE WHEN event_type <> 'error' THEN json_extract(props, '$.k')::BIGINT END AS number FROM events",
)
def a11(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(k)
    entry = F.format_string('<int name="%s-%d" value="%s" />', F.col("event_type"), F.col("event_id"), value)
    group = F.floor(F.col("event_id") / 256).alias("g")
    maps = b.table(spark, sf_dir, "events").groupBy(group).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    path = scratch_path(spark, "counters")
    document = F.concat(F.lit("<map>"), "body", F.lit("</map>"))
    maps.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return record_source.read_counters(spark, path)


def page_files(spark, sf_dir):
    """Documents as page images: a PNG head with the document's size, then the text."""
    def word(value):
        return F.lpad(F.hex(value.cast("bigint")), 8, "0")

    head = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("n_chars")), word(F.col("doc_id") + 1), F.hex(F.col("text").cast("binary"))
    )
    path = F.concat(F.lit("file:/inbox/"), F.md5("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".png"))
    return b.table(spark, sf_dir, "documents").select(
        path.alias("path"), F.unhex(head).alias("content"), F.timestamp_millis(F.lit(1706000000000) + F.col("doc_id")).alias("modificationTime")
    )


@register(
    "a12_page_images",
    """SELECT md5(source) AS note_uuid, lpad(doc_id::VARCHAR, 8, '0') || '.png' AS file_name, n_chars AS width, doc_id + 1 AS height,
       (24 + strlen(text))::BIGINT AS image_bytes, 1706000000000 + max(doc_id) OVER (PARTITION BY source) AS note_modified_ms FROM documents""",
)
def a12(spark, sf_dir):
    return exports.page_images(page_files(spark, sf_dir)).select(
        "note_uuid", "file_name", "width", "height", "image_bytes", "note_modified_ms"
    )


@register(
    "a14_newest_export",
    "SELECT max('user_' || strftime(o_orderdate, '%Y%m%d%H%M%S')) AS dir FROM orders WHERE o_orderstatus = 'F'",
)
def a14(spark, sf_dir):
    stamped = F.concat(F.lit("user_"), F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    name = F.when(F.col("o_orderstatus") == "F", stamped).otherwise(F.concat(F.lit("zz-"), F.col("o_orderkey").cast("string")))
    dirs = b.table(spark, sf_dir, "orders").select(name.alias("dir"), F.col("o_orderkey").alias("modified_ms"))
    return exports.newest_export(dirs)


# --- sinks -----------------------------------------------------------------------


def _with_ids(windows):
    return windows.withColumn("artifact_id", ids.window_id(F.col("canonical_index")))


@register(
    "a21_rollup_records",
    b.rollup_sql()
    + """SELECT artifact_id, device, span_start_ms AS created_ms, windows_present AS member_count, quality_tier,
         agg_heart_rate_bpm AS hr_bpm, coverage_stress FROM roll""",
)
def a21(spark, sf_dir):
    built = rollup.build_rollups(_with_ids(b.windows(spark, sf_dir)), with_members=True)
    path = scratch_path(spark, "rollups")
    rows = rollup.rollup_records(built, F.col("device"), "chronogrid")
    tables.write_records(rows, path, "source")
    raw = record_source.scan_records(spark, path, layout="lines", ordered=False)  # a set of records: no sort of whole lines

    def at(path_text, kind):
        return F.get_json_object("raw", path_text).cast(kind)

    members = F.size(F.from_json(F.get_json_object("raw", "$.payload.payload.aggregated_from.artifact_ids"), "array<string>"))
    return raw.select(
        at("$.artifactId", "string").alias("artifact_id"), at("$.deviceAlias", "string").alias("device"),
        at("$.createdAtEpochMs", "bigint").alias("created_ms"), members.cast("bigint").alias("member_count"),
        at("$.payload.quality_metadata.quality_tier", "string").alias("quality_tier"),
        at("$.payload.payload.modalities.heart_rate.bpm", "double").alias("hr_bpm"),
        at("$.payload.missingness_metadata.modality_coverage.stress", "double").alias("coverage_stress"),
    )


_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@register(
    "a22_flat_windows",
    b.windows_sql()
    + f"""SELECT canonical_index, start_ms, end_ms, {_ISO.format('start_ms')} AS start_iso, {_ISO.format('end_ms')} AS end_iso,
         'wearable.win.' || canonical_index AS artifact_id, device AS device_alias, """
    + ", ".join(f"present_{m}, present_{m}::INT::DOUBLE AS cov_{m}" for m in MODALITIES)
    + """, heart_rate_bpm, heart_rate_bpm_min, heart_rate_bpm_max, heart_rate_bins, hrv_proxy_bpm, hrv_proxy_windows, hrv_sdnn_ms, hrv_rmssd_ms,
         stress_score, stress_readings, sleep_stage_segments, sleep_stage_dominant_stage::VARCHAR AS sleep_stage_dominant_stage FROM win""",
)
def a22(spark, sf_dir):
    path = scratch_path(spark, "flat-windows")
    tables.write_flat(rollup.flat_windows(b.windows(spark, sf_dir)), path, "windows", GENERATED)
    return spark.read.parquet(path)


@register(
    "a23_flat_rollups",
    b.rollup_sql()
    + f"""SELECT span_id, span_seconds, span_start_ms, span_end_ms, {_ISO.format('span_start_ms')} AS span_start_iso,
         {_ISO.format('span_end_ms')} AS span_end_iso, windows_expected, windows_present, artifact_id, """
    + ", ".join([f"coverage_{m}" for m in MODALITIES] + [f"partial_{m}" for m in MODALITIES] + STAT_COLUMNS) + " FROM roll",
)
def a23(spark, sf_dir):
    path = scratch_path(spark, "flat-rollups")
    tables.write_flat(rollup.flat_rollups(rollup.build_rollups(b.windows(spark, sf_dir))), path, "rollups", GENERATED)
    return spark.read.parquet(path)


@register(
    "a24_file_notes",
    f"SELECT '{GENERATED}' AS generated_at, 'chronogrid' AS producer, 'orders' AS label, count(*) AS n FROM orders",
)
def a24(spark, sf_dir):
    path = scratch_path(spark, "notes")
    tables.write_flat(b.table(spark, sf_dir, "orders"), path, "orders", GENERATED)
    notes = tables.read_notes(spark, path)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    return stored.select(*[F.lit(notes[k]).alias(k) for k in ("generated_at", "producer", "label")], "n")


@register(
    "a25_manifest_roundtrip",
    f"""SELECT source AS export, doc_id::VARCHAR AS rel_path, sha256(text) AS sha256,
        CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'empty' ELSE 'processed' END AS status,
        CASE WHEN toxic = 1 THEN 'parse' ELSE '' END AS error, {b.NOW_MS} + (quality IS NOT NULL)::BIGINT AS processed_at_ms
        FROM documents LEFT JOIN labels USING (doc_id)""",
)
def a25(spark, sf_dir):
    """All files are marked in a first run; the labelled ones are marked again in a second."""
    path = scratch_path(spark, "manifest")
    files = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("export"), F.col("doc_id").cast("string").alias("rel_path"), F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("bytes"), "doc_id",
    )
    labelled = files.join(b.table(spark, sf_dir, "labels"), "doc_id")
    error = F.when(F.col("toxic") == 1, F.lit("parse"))
    runs = [
        state.manifest_rows(files, F.lit(1), F.lit(None).cast("string"), b.NOW_MS),
        state.manifest_rows(labelled, F.col("quality"), error, b.NOW_MS + 1),
    ]
    for run in runs:
        keyed = run.withColumn("arrival", F.col("processed_at_ms"))
        tables.upsert_table(spark, path, keyed, ["export", "rel_path"], ["export"])
    stored = tables.read_table(spark, path, runs[0].schema)
    return stored.select("export", "rel_path", "sha256", "status", "error", "processed_at_ms")


# --- jobs ------------------------------------------------------------------------


_exports: dict[tuple, str] = {}


def write_export(spark, sf_dir, part=None):
    """The events as one export folder; ``part`` 0 or 1 takes the users of one parity.

    Written once per application, since runs only read it.
    """
    held = (spark.sparkContext.applicationId, sf_dir, part)
    if held not in _exports:
        _exports[held] = _new_export(spark, sf_dir, part)
    return _exports[held]


def _new_export(spark, sf_dir, part):
    root = scratch_path(spark, "export")

    def rows_of(modality):
        rows = b.obs(spark, sf_dir, False, modality)
        if part is not None:
            rows = rows.where(F.pmod(F.col("device").cast("bigint"), F.lit(2)) == part)
        return rows.withColumn("device", F.lit(b.SHARED_DEVICE))

    one_value_per_file(json_arrays(rows_of("heart_rate"), hr_fields()), f"{root}/{HR_DIR}")
    one_value_per_file(json_arrays(rows_of("hrv"), hrv_fields()), f"{root}/{HRV_DIR}")
    score = F.when(F.col("k") > 0, F.col("value"))
    rows_of("stress").select(
        sheet_time(F.col("start_ms")).alias("start_time"), sheet_time(F.col("end_ms")).alias("end_time"), score.alias("score")
    ).write.option("header", True).csv(f"{root}/{STRESS_CSV}")
    code = F.lit(40001) + F.pmod(F.col("k"), F.lit(4))
    rows_of("sleep_stage").select(
        sheet_time(F.col("start_ms")).alias("start_time"), sheet_time(F.col("end_ms")).alias("end_time"), code.alias("stage")
    ).write.option("header", True).csv(f"{root}/{SLEEP_STAGE_CSV}")
    return root


RUN_COLUMNS = [
    "canonical_index", "start_ms", "present_heart_rate", "present_hrv_proxy", "present_hrv", "present_stress",
    "present_sleep_stage", "heart_rate_bpm", "heart_rate_bins", "hrv_proxy_bpm", "hrv_proxy_windows", "hrv_sdnn_ms",
    "stress_readings", "stress_score", "sleep_stage_segments",
]


@register(
    "m03_window_producer",
    b.windows_sql(b.SIGNALS_SHARED) + f"SELECT 'watch' AS device, {', '.join(RUN_COLUMNS)} FROM win",
)
def m03(spark, sf_dir):
    """Export folder to window records on disk, read back as windows."""
    root, store = write_export(spark, sf_dir), scratch_path(spark, "store")
    jobs.produce(spark, root, store, "watch", b.NOW_MS, export="run", offset_mode="utc").collect()
    return record_source.load_windows(record_source.scan_records(spark, store, layout="lines")).select("device", *RUN_COLUMNS)


_PARITY = b._cte(b.OBS.replace("cast(user_id AS VARCHAR) AS device", "CASE WHEN user_id % 2 = 0 THEN 'watch' ELSE 'ring' END AS device"))
_VALUES = [
    "heart_rate_bpm", "heart_rate_bpm_min", "heart_rate_bpm_max", "heart_rate_bins", "hrv_proxy_bpm", "hrv_proxy_windows", "hrv_sdnn_ms",
    "hrv_rmssd_ms", "stress_readings", "stress_score", "stress_score_min", "stress_score_max", "sleep_stage_segments",
]


@register(
    "m03_two_exports",
    b.windows_sql(_PARITY)
    + f"""SELECT device, canonical_index, start_ms, end_ms, {', '.join(f'present_{m}' for m in MODALITIES)}, {', '.join(_VALUES)},
       sleep_stage_stage_codes, sleep_stage_dominant_stage::VARCHAR AS sleep_stage_dominant_stage FROM win""",
)
def m03_two_exports(spark, sf_dir):
    """Two devices with an export each in one store, and one of the runs a second time: nothing is lost or doubled."""
    store = scratch_path(spark, "store")
    for part, device, now in ((0, "watch", 1), (1, "ring", 2), (0, "watch", 3)):
        jobs.produce(spark, write_export(spark, sf_dir, part), store, device, now, offset_mode="utc").collect()
    loaded = record_source.parse_windows(record_source.scan_records(spark, store, layout="lines", ordered=False))
    codes = F.array_join(F.transform("sleep_stage_stage_codes", lambda c: c.cast("string")), ",")
    return loaded.select(
        "device", "canonical_index", "start_ms", "end_ms", *[f"present_{m}" for m in MODALITIES], *_VALUES,
        codes.alias("sleep_stage_stage_codes"), "sleep_stage_dominant_stage",
    )


@register(
    "m02_compaction",
    b.rollup_sql(signals=b.SIGNALS_SHARED)
    + f"SELECT span_id, span_start_ms, windows_present, artifact_id, {', '.join(STAT_COLUMNS)} FROM roll",
)
def m02(spark, sf_dir):
    """Stored window records to rollup records and flat Parquet; the Parquet rollups are returned."""
    store, out = scratch_path(spark, "store"), scratch_path(spark, "compact")
    rows = rollup.window_records(b.windows(spark, sf_dir, shared=True), "chronogrid")
    tables.write_records(rows, store, "source")
    jobs.compact(spark, store, f"{out}/rollup", f"{out}/data", GENERATED).collect()
    return spark.read.parquet(f"{out}/data/rollups.parquet").select(
        "span_id", "span_start_ms", "windows_present", "artifact_id", *STAT_COLUMNS
    )


@register(
    "m04_nightly_chain",
    b.rollup_sql(signals=b.SIGNALS_SHARED)
    + "SELECT 0 AS code, 'done' AS stage, (SELECT count(*) FROM win) AS windows, (SELECT count(*) FROM roll) AS rollups, '' AS detail",
)
def m04(spark, sf_dir):
    root, work = write_export(spark, sf_dir), scratch_path(spark, "nightly")
    return jobs.nightly(spark, root, work, "watch", b.NOW_MS, GENERATED, offset_mode="utc")


def fake_engine(content: bytes) -> dict:
    """Stands in for a transcriber: the text is whatever follows the image head."""
    text = content[24:].decode("utf-8")
    if len(text) % 7 == 0:
        raise TimeoutError("page took too long")
    return {"text": text if len(text) % 5 else " bl ank ", "latency_ms": len(text)}


_JOURNAL = """pages AS (SELECT d.doc_id, md5(source) AS note_uuid, d.text, length(text) AS n,
   sha256(unhex('89504E470D0A1A0A0000000D49484452' || lpad(printf('%X', n_chars), 8, '0') || lpad(printf('%X', doc_id + 1), 8, '0')) || encode(text)) AS sha,
   l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
 due AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 5 = 0 OR upper(replace(trim(text), ' ', '')) IN ('', 'BLANK') THEN 'blank' ELSE 'new' END AS status
   FROM pages WHERE quality IS NULL OR quality = 0)"""


def _numbered_pages(spark, sf_dir):
    pages = exports.page_images(page_files(spark, sf_dir)).withColumnRenamed("file_name", "page_id")
    content = page_files(spark, sf_dir).select("path", "content")
    number = F.regexp_extract("page_id", r"^0*(\d+)\.png$", 1).cast("bigint")
    full = pages.join(content, "path").withColumn("doc_id", number).withColumn("page_order", number + 1)
    return full.withColumn("captured_ms", F.col("note_modified_ms"))


def all_pages(spark, sf_dir):
    return _numbered_pages(spark, sf_dir).select("note_uuid", "page_id", "page_order", "png_sha256", "content", "captured_ms")


def _journal_run(spark, sf_dir):
    """Pages of good label are already known, all others are due."""
    full = _numbered_pages(spark, sf_dir)
    good = full.join(b.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    manifest = good.select(
        "note_uuid", "page_id", "png_sha256", F.lit("known").alias("last_artifact_id"), F.lit(False).alias("blank")
    )
    wanted = full.select("note_uuid", "page_id", "page_order", "png_sha256", "content", "captured_ms")
    return jobs.ingest_journal(wanted, manifest, fake_engine, b.NOW_MS)


@register(
    "m05_journal_records",
    f"""WITH {_JOURNAL} SELECT '{NOTE_ID_PREFIX}.' || note_uuid || '.p' || (doc_id + 1) AS artifact_id, 'accepted' AS ingest_status,
        text AS ocr_text, sha AS image_sha FROM due WHERE status = 'new'""",
)
def m05(spark, sf_dir):
    made, _, _ = _journal_run(spark, sf_dir)
    return made.select(
        "artifact_id", "ingest_status", F.col("payload.ocrText").alias("ocr_text"), F.col("payload.pageImage.sha256").alias("image_sha")
    )


@register(
    "m05_journal_commits",
    f"""WITH {_JOURNAL} SELECT note_uuid, lpad(doc_id::VARCHAR, 8, '0') || '.png' AS page_id, sha AS png_sha256, status = 'blank' AS blank,
        CASE WHEN status = 'new' THEN '{NOTE_ID_PREFIX}.' || note_uuid || '.p' || (doc_id + 1) ELSE '' END AS last_artifact_id
        FROM due WHERE status <> 'failed'""",
)
def m05_commits(spark, sf_dir):
    _, commits, _ = _journal_run(spark, sf_dir)
    return commits.select("note_uuid", "page_id", "png_sha256", "blank", "last_artifact_id")


@register(
    "m05_journal_run",
    """WITH p AS (SELECT CASE WHEN length(text) % 7 = 0 THEN 'failed' WHEN length(text) % 5 = 0 OR upper(replace(trim(text), ' ', '')) IN ('', 'BLANK')
         THEN 'blank' ELSE 'new' END AS status FROM documents),
       r AS (SELECT 1 AS run, status FROM p UNION ALL SELECT 2, status FROM p WHERE status = 'failed' UNION ALL SELECT 3, status FROM p WHERE status <> 'new')
       SELECT run, count(*) AS total_pages, count(*) FILTER (WHERE status = 'new') AS pages_new, count(*) FILTER (WHERE status = 'blank') AS blank_pages,
         count(*) FILTER (WHERE status = 'failed') AS failed_pages FROM r GROUP BY run""",
)
def m05_run(spark, sf_dir):
    """A first run, a second with its manifest, and a third that has lost the manifest and starts from the store."""
    pages = all_pages(spark, sf_dir)
    base, out = scratch_path(spark, "journal"), None
    for run, manifest in ((1, "kept"), (2, "kept"), (3, "lost")):
        done = jobs.run_journal(spark, pages, f"{base}/store", f"{base}/{manifest}", fake_engine, b.NOW_MS + run)
        part = done.select(F.lit(run).alias("run"), "total_pages", "pages_new", "blank_pages", "failed_pages")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "k01_page_transcriber",
    """SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN CASE WHEN length(text) % 5 = 0 THEN ' bl ank ' ELSE text END END AS ocr_text,
       CASE WHEN length(text) % 7 <> 0 THEN length(text) END::BIGINT AS latency_ms,
       CASE WHEN length(text) % 7 = 0 THEN 'TimeoutError: page took too long' END AS error FROM documents""",
)
def k01(spark, sf_dir):
    pages = page_files(spark, sf_dir).select(
        F.regexp_extract("path", r"/0*(\d+)\.png$", 1).cast("bigint").alias("doc_id"), "content"
    )
    return jobs.transcribe(pages, fake_engine)


def doc_inbox(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("export"), F.col("doc_id").cast("string").alias("rel_path"), F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("bytes"), F.col("text").alias("payload"),
    )
