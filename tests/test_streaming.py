"""Streams: replay, late files and agreement with the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import signals
from chronogrid.streaming import jobs

BINS = "device string, start_ms bigint, end_ms bigint, bpm double, bpm_min double, bpm_max double, seq bigint"


def test_files_that_arrive_later_are_taken_once(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(10).select("id")
    for part in (rows.where("id < 4"), rows.where("id >= 4")):
        part.write.mode("append").parquet(inbox)
        jobs.drain_to_files(jobs.read_inbox(spark, inbox, rows.schema), out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))


def test_proxy_stream_equals_batch_when_bins_arrive_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [("d", rng.randrange(0, 7_200_000), float(rng.randrange(50, 100)), i) for i in range(120)]
    df = spark.createDataFrame([(d, s, s + 1000, v, 0.0, 0.0, i) for d, s, v, i in rows], BINS)
    inbox = str(tmp_path / "in")
    for part in range(3):
        df.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(inbox)
    stream = jobs.read_inbox(spark, inbox, df.schema, files_per_batch=1)
    out = str(tmp_path / "proxy")
    jobs.drain_proxy(stream, str(tmp_path / "bins"), out, str(tmp_path / "mark"))
    columns = ["device", "canonical_index", "bpm", "bins_used"]
    streamed = {tuple(r) for r in spark.read.parquet(out).select(*columns).collect()}
    batch = {tuple(r) for r in signals.rolling_proxy(signals.dedup_bins(df)).select(*columns).collect()}
    assert streamed == batch


def test_sessions_on_a_stream_close_behind_the_watermark(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    minutes = [0, 5, 50, 2000]
    rows = spark.createDataFrame([("u", 60000 * m) for m in minutes], "user string, ms bigint").select("user", F.timestamp_millis("ms").alias("ts"))
    rows.coalesce(1).write.parquet(inbox)
    stream = jobs.read_inbox(spark, inbox, rows.schema)
    jobs.drain_to_files(jobs.sessions(stream, "user", "10 minutes", "1 hour"), out, str(tmp_path / "mark"))
    closed = {(r["start_ms"], r["events"]) for r in spark.read.parquet(out).collect()}
    assert closed == {(0, 2), (3_000_000, 1)}
    batch = {(r["start_ms"], r["events"]) for r in jobs.sessions(rows, "user", "10 minutes").collect()}
    assert batch == closed | {(120_000_000, 1)}


def test_failed_batch_leaves_no_mark(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows = spark.createDataFrame([("e", "f", "s", 1, "p")], "export string, rel_path string, sha256 string, bytes bigint, payload string")
    rows.write.parquet(inbox)
    stream = jobs.read_inbox(spark, inbox, rows.schema)
    with pytest.raises(Exception, match="broken sink"):
        jobs.drain_batches(stream, lambda batch, i: (_ for _ in ()).throw(RuntimeError("broken sink")), str(tmp_path / "mark"))
    jobs.drain_files_with_manifest(
        jobs.read_inbox(spark, inbox, rows.schema), str(tmp_path / "records"), str(tmp_path / "manifest"), str(tmp_path / "mark"), 1
    )
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 1


def test_an_event_at_the_end_of_a_session_opens_the_next(spark, tmp_path):
    gap = 600_000
    times = [0, gap - 1, 2 * gap - 1, 2 * gap, 3 * gap + 1, 90 * gap]
    rows = spark.createDataFrame([("u", t) for t in times], "user string, ms bigint").select("user", F.timestamp_millis("ms").alias("ts"))
    expected = {(0, 2 * gap - 1, 2), (2 * gap - 1, 3 * gap, 2), (3 * gap + 1, 4 * gap + 1, 1)}
    columns = ["start_ms", "end_ms", "events"]
    batch = {tuple(r) for r in jobs.sessions(rows, "user", "10 minutes").select(*columns).collect()}
    assert batch == expected | {(90 * gap, 91 * gap, 1)}
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(inbox)
    stream = jobs.sessions(jobs.read_inbox(spark, inbox, rows.schema), "user", "10 minutes", "10 minutes")
    jobs.drain_to_files(stream, out, str(tmp_path / "mark"))
    assert {tuple(r) for r in spark.read.parquet(out).select(*columns).collect()} == expected


def test_an_inbox_has_files_by_the_splits_of_its_rows(spark):
    from chronogrid.plans import streaming_catalog

    for splits, share in ((1, 1), (3, 1), (10, 4)):
        path, found = streaming_catalog.inbox(spark.range(0, 3_000, 1, splits), "inbox", ["id"])
        files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
        assert found == share and len(files) == 3 * share and max(r["count"] for r in files) <= 2 * 3_000 / (3 * share)
