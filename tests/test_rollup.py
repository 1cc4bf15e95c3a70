"""Rollups of canonical windows: coverage, partial flags, statistics and records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chronogrid.constants import MODALITIES
from chronogrid.operators import rollup
from chronogrid.sinks import tables
from chronogrid.sources import records as source

T0 = (1761000000000 // 86400000) * 86400000


def record(slot, modalities, device="watch", kind="canonical_window"):
    start = T0 + 60000 * slot
    return json.dumps({
        "artifactId": f"wearable.win.{start // 60000}", "source": "mobile", "deviceAlias": device,
        "payload": {
            "kind": kind,
            "window": {"start_ms": start, "end_ms": start + 60000, "canonical_index": start // 60000},
            "modalities_present": {m: m in modalities for m in MODALITIES},
            "payload": {"modalities": modalities},
            "missingness_metadata": {"modality_coverage": {m: float(m in modalities) for m in MODALITIES}},
        },
    })


def heart(bpm=70.0):
    return {"heart_rate": {"bpm": bpm, "bpm_min": 55.0, "bpm_max": 90.0, "bins": 2}}


def load(spark, rows):
    return source.load_windows(spark.createDataFrame([("p", r) for r in rows], "path string, raw string"))


def roll(spark, rows, *spans, **options):
    return rollup.build_rollups(load(spark, rows), spans, **options).orderBy("span_start_ms").collect()


def test_full_bucket(spark):
    (r,) = roll(spark, [record(s, heart()) for s in range(5)], "5m")
    assert (r["coverage_heart_rate"], r["partial_heart_rate"], r["agg_heart_rate_bpm"]) == (1.0, False, 70.0)
    assert r["agg_heart_rate_bins"] == 10 and r["artifact_id"] == f"wearable.rollup.300s.{T0}"
    assert r["agg_hrv_sdnn_ms"] is None
    assert (r["quality"], r["quality_tier"]) == (0.2, "low")


def test_partial_is_strict(spark):
    (r,) = roll(spark, [record(s, heart() if s in (0, 2) else {}) for s in range(5)], "5m")
    assert r["coverage_heart_rate"] == 0.4 and r["partial_heart_rate"]
    assert r["coverage_hrv"] == 0.0 and not r["partial_hrv"]
    (day,) = roll(spark, [record(s, heart() if s < 720 else {}) for s in range(1440)], "1d")
    assert day["coverage_heart_rate"] == 0.5 and not day["partial_heart_rate"]


def test_spans(spark):
    assert len(roll(spark, [record(s, heart()) for s in (0, 1)], "5m")) == 1
    assert len(roll(spark, [record(s, heart()) for s in (0, 1, 2)], "60s")) == 3
    (hour,) = roll(spark, [record(s, heart()) for s in range(60)], "1h")
    assert hour["windows_present"] == 60
    assert rollup.resolve_span("300") == ("300s", 300) and rollup.resolve_span("1H") == ("1h", 3600)
    for bad in ("bogus", "13x"):
        with pytest.raises(ValueError):
            rollup.resolve_span(bad)


def test_text_votes_and_ties(spark):
    stages = ["light", "deep", "deep", "light", "rem"]
    rows = [record(s, {"sleep_stage": {"segments": 1, "dominant_stage": v}}) for s, v in enumerate(stages)]
    (r,) = roll(spark, rows, "5m")
    assert r["agg_sleep_stage_dominant_stage"] == "deep" and r["agg_sleep_stage_segments"] == 5


def test_scan_skips_other_kinds_and_orders(spark):
    rows = [record(s, heart()) for s in (3, 0, 5, 2, 4)] + [record(1, heart(), kind="url"), record(6, heart(), kind="rollup")]
    starts = [r["start_ms"] for r in load(spark, rows).collect()]
    assert starts == [T0 + 60000 * s for s in (0, 2, 3, 4, 5)]


def test_scan_fallbacks(spark):
    bare = {"artifactId": "x", "payload": {"kind": "canonical_window", "window": {"start_time": "2025-10-20T22:40:00.000Z"}}}
    none = {"artifactId": "y", "payload": {"kind": "canonical_window", "window": {"start_ms": 0}}}
    (r,) = load(spark, [json.dumps(bare), json.dumps(none)]).collect()
    assert r["end_ms"] == r["start_ms"] + 60000 and r["canonical_index"] == r["start_ms"] // 60000
    assert not r["present_heart_rate"]


def test_members_are_in_time_order(spark):
    (r,) = roll(spark, [record(s, heart()) for s in (2, 0, 1)], "5m", with_members=True)
    assert r["members"] == [f"wearable.win.{T0 // 60000 + s}" for s in (0, 1, 2)]


def test_flat_tables_round_trip(spark, tmp_path):
    rows = [record(s, {**heart(60 + s), **({"hrv": {"sdnn_ms": 30.0 + s, "rmssd_ms": 40.0 + s}} if s % 2 == 0 else {})}) for s in range(5)]
    windows = load(spark, rows)
    path = str(tmp_path / "windows")
    tables.write_flat(rollup.flat_windows(windows), path, "windows", "2024-01-01T00:00:00.000Z")
    back = spark.read.parquet(path).orderBy("start_ms").collect()
    assert [r["hrv_sdnn_ms"] for r in back] == [30.0, None, 32.0, None, 34.0]
    assert tables.read_notes(spark, path) == {"generated_at": "2024-01-01T00:00:00.000Z", "producer": "chronogrid", "label": "windows"}


def test_rollup_records_have_nine_keys(spark):
    built = rollup.build_rollups(load(spark, [record(s, heart()) for s in range(5)]), ["5m"], with_members=True)
    (r,) = rollup.rollup_records(built, F.lit("watch"), "chronogrid").collect()
    assert len(r.asDict()) == 9
    payload = r["payload"].asDict(recursive=True)
    assert {m for m, v in payload["payload"]["modalities"].items() if v} == {"heart_rate"}
    assert payload["missingness_metadata"]["missing_modalities"] == ["hrv_proxy", "hrv", "stress", "sleep_stage"]
    assert payload["payload"]["aggregated_from"]["count"] == 5
