"""Readers on real files."""

from __future__ import annotations

import json
import struct

from chronogrid.plans import jobs
from chronogrid.sources import exports, records
from chronogrid.sources.files import list_files


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
    return str(path)


def test_hr_arrays(spark, tmp_path):
    good = {"heart_rate": 70.5, "heart_rate_min": 60, "heart_rate_max": 80, "start_time": 1787709540000, "end_time": 1787709599000}
    rows = [good, {k: v for k, v in good.items() if k != "heart_rate"}, {"heart_rate": 1}, 5, {"heart_rate": 61, "start_time": 1, "end_time": 2}]
    put(tmp_path, "a.json", json.dumps(rows))
    put(tmp_path, "b.json", "[]")
    put(tmp_path, "c.json", "{broken")
    found = exports.read_hr_bins(spark, str(tmp_path)).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["bpm"], r["bpm_min"]) for r in found] == [(1, 61.0, 0.0), (1787709540000, 70.5, 60.0)]
    assert [r["source_file"].rsplit("/", 1)[1] for r in exports.bad_json_files(spark, str(tmp_path)).collect()] == ["c.json"]


def test_hrv_arrays(spark, tmp_path):
    base = {"start_time": 100, "end_time": 200, "sdnn": 53.98, "rmssd": 60.4}
    rows = [base, {**base, "start_time": 0}, {**base, "end_time": 50}, {"start_time": 1, "end_time": 2, "rmssd": 1}]
    put(tmp_path, "a.json", json.dumps(rows))
    found = exports.read_hrv_windows(spark, str(tmp_path)).collect()
    assert [(r["start_ms"], r["end_ms"], r["sdnn_ms"]) for r in found] == [(100, 200, 53.98)]


SHEET = "﻿com.samsung.shealth.stress,7006003,9\nstart_time,end_time,time_offset,score,datauuid\n"


def test_stress_sheet(spark, tmp_path):
    body = (
        "2022-01-24 15:25:00.000,2022-01-24 15:26:00.600,UTC-0400,30.5,u1\n"
        "2022-01-24 16:00:00.000,,UTC+0000,,u2\n"
        'bad,2022-01-24 15:26:00.000,UTC-0400,1,"u,3"\n'
    )
    path = put(tmp_path, "stress.csv", SHEET + body)
    lines = exports.sheet_lines(spark, path)
    rows = exports.stress_sheet(lines).orderBy("start_ms").collect()
    noon = 1643037900000  # 2022-01-24T15:25Z
    assert [(r["start_ms"], r["end_ms"], r["score"], r["data_uuid"]) for r in rows] == [
        (noon - 4 * 3600000, noon + 60000 - 4 * 3600000 + 1, 30.5, "u1"),
        (noon + 35 * 60000, noon + 35 * 60000, None, "u2"),
    ]
    true = exports.stress_sheet(lines, "utc").orderBy("start_ms").collect()
    assert sorted(r["start_ms"] for r in true) == [noon + 35 * 60000, noon + 4 * 3600000]


def test_sheet_without_banner_and_prefixed_columns(spark, tmp_path):
    p = "com.samsung.health.sleep."
    path = put(tmp_path, "sleep.csv", f"{p}start_time,{p}end_time,efficiency,sleep_type\n2022-01-24 15:25:00.000,2022-01-24 15:26:00.000,,2.9\n")
    (r,) = exports.sleep_sheet(exports.sheet_lines(spark, path)).collect()
    assert (r["end_ms"] - r["start_ms"], r["efficiency"], r["sleep_type"], r["sleep_score"]) == (60000, None, 2, None)
    path = put(tmp_path, "sleep_stage.csv", "banner,1\nstart_time,stage,sleep_id\n2022-01-24 15:25:00.000,40002.0,s\n2022-01-24 15:25:00.000,,s\n")
    rows = exports.sleep_stage_sheet(exports.sheet_lines(spark, path)).collect()
    assert [(r["stage_code"], r["sleep_id"]) for r in rows] == [(40002, "s")]


def test_record_scan(spark, tmp_path):
    put(tmp_path, "mobile/b.json", '{\n "artifactId": "b"\n}')
    put(tmp_path, "mobile/deep/a.json", '{"artifactId": "a"}')
    put(tmp_path, "mobile/x.json", "[1]")
    put(tmp_path, "mobile/y.json", "{oops")
    put(tmp_path, "browser/c.json", '{"artifactId": "c"}')
    inside = records.scan_records(spark, str(tmp_path), "mobile").collect()
    assert [json.loads(r["raw"])["artifactId"] for r in inside] == ["b", "a"]
    assert records.scan_records(spark, str(tmp_path), "absent").count() == 3


def test_visits_and_counters(spark, tmp_path):
    assert records.import_visits(spark, put(tmp_path, "v.json", '[{"a":1},{"a":2}]')).count() == 2
    assert records.import_visits(spark, put(tmp_path, "w.json", '{"a":1}')).count() == 1
    assert records.import_visits(spark, put(tmp_path, "v.jsonl", '{"a":1}\n\n{"a":2}\n')).count() == 2
    xml = "<?xml version='1.0'?>\n<map>\n<int name=\"runs\" value=\"3\" />\n<int name=\"odd\" value=\"x\" />\n</map>"
    rows = records.read_counters(spark, put(tmp_path, "t.xml", xml)).orderBy("name").collect()
    assert [(r["name"], r["value"], r["number"]) for r in rows] == [("odd", "x", None), ("runs", "3", 3)]


def test_page_images(spark, tmp_path):
    note = "0123456789abcdef0123456789abcdef"
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 499, 666) + b"rest"
    put(tmp_path, f"{note}/p1.png", png)
    put(tmp_path, "elsewhere/p1.png", png)
    (r,) = exports.read_page_images(spark, str(tmp_path)).collect()
    assert (r["note_uuid"], r["width"], r["height"], r["image_bytes"]) == (note, 499, 666, len(png))


def export(tmp_path):
    root = tmp_path / "user_20240101000000"
    bins = [{"heart_rate": 60 + i, "heart_rate_min": 50, "heart_rate_max": 90, "start_time": 1787709540000 + 60000 * i, "end_time": 1787709599000 + 60000 * i} for i in range(6)]
    put(root, "com.samsung.shealth.tracker.heart_rate/a/1.json", json.dumps(bins))
    put(root, "hr_bins/2.json", json.dumps(bins[:2]))
    put(root, "com.samsung.health.hrv/1.json", "{broken")
    put(root, "hr.csv", "x\n")
    put(root, "stress.csv", SHEET + "2026-08-25 15:25:00.000,,UTC+0000,20,u\n")
    put(root, "notes.txt", "ignored")
    return str(root)


def test_producer_compaction_and_nightly(spark, tmp_path):
    root = export(tmp_path)
    kinds = {r["rel_path"]: r["kind"] for r in exports.discover_export(spark, root).collect()}
    assert kinds["com.samsung.shealth.tracker.heart_rate/2.json"] == "hr_json" and kinds["notes.txt"] == "unknown"
    manifest = str(tmp_path / "manifest")
    stats = jobs.produce(spark, root, str(tmp_path / "raw"), "watch", 1, manifest_path=manifest).first()
    assert (stats["files"], stats["files_error"]) == (5, 1)
    assert (stats["windows_heart_rate"], stats["windows_hrv_proxy"], stats["windows_stress"]) == (6, 6, 1)  # each start lies on the edge of the window before
    status = {r["rel_path"]: (r["status"], r["records_emitted"]) for r in spark.read.parquet(manifest).collect()}
    assert status["com.samsung.health.hrv/1.json"] == ("error", 0) and status["hr.csv"] == ("empty", 0)
    assert status["stress.csv"] == ("processed", 1)
    again = jobs.produce(spark, root, str(tmp_path / "raw"), "watch", 2, manifest_path=manifest).first()
    assert again["files_due"] == 0 and again["windows_emitted"] == 0
    out = jobs.compact(spark, str(tmp_path / "raw"), str(tmp_path / "rollup"), str(tmp_path / "data"), "now", ["5m", "1d"]).first()
    assert out["windows_loaded"] == stats["windows_emitted"] and out["parquet_ok"]
    assert spark.read.parquet(str(tmp_path / "data/rollups.parquet")).count() == out["rollups_built"]
    assert jobs.nightly(spark, root, str(tmp_path / "n"), "watch", 1, "now").first()["code"] == 0
    assert jobs.nightly(spark, str(tmp_path / "nowhere"), str(tmp_path / "n2"), "watch", 1, "now").first()["code"] == 3
    empty = tmp_path / "empty"
    put(empty, "hr.csv", "x\n")
    assert jobs.nightly(spark, str(empty), str(tmp_path / "n3"), "watch", 1, "now").first()["code"] == 2


def test_compaction_of_an_empty_store(spark, tmp_path):
    out = jobs.compact(spark, str(tmp_path / "none"), str(tmp_path / "r"), str(tmp_path / "d"), "now").first()
    assert (out["windows_loaded"], out["rollups_built"], out["parquet_ok"]) == (0, 0, False)


def test_listing_reads_no_content(spark, tmp_path):
    put(tmp_path, "a.bin", b"12345")
    (r,) = list_files(spark, str(tmp_path)).collect()
    assert r["bytes"] == 5


def test_sheet_with_quoted_break_quote_and_comma(spark, tmp_path):
    body = (
        '2022-01-24 15:25:00.000,2022-01-24 15:26:00.000,UTC+0000,5,"u,1 ""x""\nsecond line"\n'
        "2022-01-24 16:25:00.000,2022-01-24 16:26:00.000,UTC+0000,6,u2\r\n"
        '"2022-01-24 17:25:00.000",,,"7",\n'
    )
    path = put(tmp_path, "stress.csv", SHEET + body)
    rows = exports.stress_sheet(exports.sheet_lines(spark, path)).orderBy("start_ms").collect()
    assert [(r["score"], r["data_uuid"]) for r in rows] == [(5.0, 'u,1 "x"\nsecond line'), (6.0, "u2"), (7.0, "")]
    header, cells = exports.sheet_rows(exports.sheet_lines(spark, path)).select("header", "cells").orderBy("order").collect()[2]
    assert len(cells) == len(header) and cells[1] == cells[2] == cells[4] == ""


def test_two_devices_and_exports_in_one_store(spark, tmp_path):
    def bins(first, n):
        return [{"heart_rate": 60 + i, "start_time": first + 60000 * i, "end_time": first + 60000 * i + 59000} for i in range(n)]

    store, manifest = str(tmp_path / "raw"), str(tmp_path / "manifest")
    first = tmp_path / "u_20240101000000"
    put(first, "com.samsung.shealth.tracker.heart_rate/1.json", json.dumps(bins(1787709540000, 5)))
    second = tmp_path / "u_20240102000000"
    put(second, "com.samsung.shealth.tracker.heart_rate/1.json", json.dumps(bins(1787709540000 + 86_400_000, 4)))
    jobs.produce(spark, str(first), store, "watch", 1, manifest_path=manifest).collect()
    jobs.produce(spark, str(second), store, "watch", 2, manifest_path=manifest).collect()
    jobs.produce(spark, str(first), store, "ring", 3).collect()
    jobs.produce(spark, str(first), store, "watch", 4).collect()  # again: replaces its own windows
    rows = records.load_windows(records.scan_records(spark, store, layout="lines")).collect()
    keys = [(r["device"], r["start_ms"]) for r in rows]
    assert len(keys) == len(set(keys))
    per_device = {d: sum(1 for k in keys if k[0] == d) for d in ("watch", "ring")}
    one = jobs.produce(spark, str(second), str(tmp_path / "other"), "watch", 5).first()["windows_emitted"]
    alone = jobs.produce(spark, str(first), str(tmp_path / "third"), "watch", 6).first()["windows_emitted"]
    assert per_device == {"watch": alone + one, "ring": alone}
    assert {r["ingested_ms"] for r in rows if r["device"] == "ring"} == {3}
    skipped = jobs.produce(spark, str(second), store, "watch", 7, manifest_path=manifest).first()
    assert skipped["windows_emitted"] == 0 and len(rows) == records.scan_records(spark, store, layout="lines").count()


def test_upsert_reads_only_the_partitions_of_a_batch(spark, tmp_path):
    from chronogrid.sinks import tables

    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, i % 5, "old", 1) for i in range(50)], "id int, p int, v string, arrival bigint")
    tables.upsert_table(spark, path, first, ["id"], ["p"])
    batch = spark.createDataFrame([(3, 3, "new", 2)], "id int, p int, v string, arrival bigint")
    kept = tables.only_touched(tables.read_table(spark, path, first.drop("arrival").schema), batch, ["p"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "3" in plan.split("PartitionFilters")[1].split("]")[0]
    assert kept.count() == 10
    tables.upsert_table(spark, path, batch, ["id"], ["p"])
    assert spark.read.parquet(path).where("v = 'new'").count() == 1 and spark.read.parquet(path).count() == 50


def test_interval_in_microseconds_is_rejected_with_its_reason(spark, tmp_path):
    good = {"start_time": 1787709540000, "end_time": 1787709600000, "sdnn": 50.0, "rmssd": 60.0}
    odd = {**good, "end_time": good["end_time"] * 1000}
    put(tmp_path / "e", "com.samsung.health.hrv/1.json", json.dumps([good, odd]))
    rejects = str(tmp_path / "rejects")
    stats = jobs.produce(spark, str(tmp_path / "e"), str(tmp_path / "raw"), "watch", 1, rejects=rejects).first()
    assert (stats["records_rejected"], stats["windows_hrv"], stats["windows_emitted"]) == (1, 1, 1)
    (r,) = spark.read.parquet(rejects).collect()
    assert r["modality"] == "hrv" and r["reason"].startswith("interval of 29")


def test_written_records_are_packed_and_read_back(spark, tmp_path):
    from chronogrid.sinks import tables
    from chronogrid.sources import records

    rows = spark.range(500).selectExpr("concat('wearable.win.', id) AS artifactId", "'mobile' AS source", "'{\"kind\":\"url\"}' AS payload")
    tables.write_records(rows, str(tmp_path / "store"), "source")
    files = list((tmp_path / "store" / "by_source=mobile").glob("part-*"))
    lines = records.scan_records(spark, str(tmp_path / "store"), layout="lines", ordered=False).collect()
    assert len(lines) == 500 and sum(f.stat().st_size for f in files) < sum(len(r["raw"]) + 1 for r in lines) / 3


def test_a_day_of_a_device_stays_one_file_over_runs(spark, tmp_path):
    start = 1787702400000  # a UTC midnight
    rows = [{"heart_rate": 60 + i % 9, "start_time": start + 1_800_000 * i, "end_time": start + 1_800_000 * i + 59000} for i in range(96)]
    root, store = tmp_path / "u_20240101000000", tmp_path / "raw"
    put(root, "com.samsung.shealth.tracker.heart_rate/1.json", json.dumps(rows))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for now, device in enumerate(("watch", "ring", "watch")):
            jobs.produce(spark, str(root), str(store), device, now).collect()
    finally:
        spark.conf.unset(coalesce)
    folders = [f for f in store.glob("by_source=*/by_device=*/by_day=*")]
    assert len(folders) == 4 and all(len(list(f.glob("part-*"))) == 1 for f in folders)
    stored = records.parse_windows(records.scan_records(spark, str(store), layout="lines", ordered=False)).collect()
    assert len(stored) == len({(r["device"], r["start_ms"]) for r in stored}) == 2 * 96
    assert {(r["device"], r["ingested_ms"]) for r in stored} == {("watch", 2), ("ring", 1)}


def test_lines_of_a_large_sheet_are_not_dealt_out_by_its_path(spark, tmp_path):
    put(tmp_path / "e", "stress.csv", SHEET + "2026-08-25 15:25:00.000,,UTC+0000,20,u\n")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as if the sheet were too large for a guess
    try:
        parts = jobs.read_export(spark, str(tmp_path / "e"), "watch")
        plan = parts["stress"]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r["score"] for r in parts["stress"].collect()] == [20.0]
        jobs.release(parts)
    finally:
        spark.conf.unset(threshold)


def test_a_batch_of_many_partitions_opens_no_folders_beyond_its_values(spark, tmp_path, monkeypatch):
    from chronogrid.sinks import tables

    monkeypatch.setattr(tables, "MAX_NAMED", 2)
    path = str(tmp_path / "t")
    schema = "id int, device string, day int, arrival bigint"
    rows = [(i, d, i, 1) for i in range(5) for d in ("watch", "ring")] + [(9, None, 9, 1), (9, "watch", None, 1)]
    tables.upsert_table(spark, path, spark.createDataFrame(rows, schema), ["id", "device", "day"], ["device", "day"])
    stored = tables.read_table(spark, path, spark.createDataFrame([], "id int, device string, day int").schema)
    batch = spark.createDataFrame([(i, "ring", i, 2) for i in range(1, 4)], schema)
    kept = tables.only_touched(stored, batch, ["device", "day"])
    filters = kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert "ring" in filters and "day" in filters
    assert sorted((r["id"], r["device"]) for r in kept.collect()) == [(1, "ring"), (2, "ring"), (3, "ring")]
    blank = spark.createDataFrame([(i, "ring", i, 2) for i in range(1, 4)] + [(9, None, 9, 2), (9, "watch", None, 2)], schema)
    assert len(tables.only_touched(stored, blank, ["device", "day"]).collect()) == 5
