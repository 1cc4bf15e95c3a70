"""Keyed state, views, journal, records and the gate on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid.functions import ids, jsontext, numbers, predicates, timefn, vectors
from chronogrid.operators import embedding, journal, records, state, views
from chronogrid.plans import jobs
from chronogrid.sinks import tables

STORE = "source string, artifact_id string, created_ms bigint, payload string, ingest_status string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_upsert_last_write_wins_and_repeats_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame(
        [("Browser_x", "a", 1, "one", 1), ("browser", "a", 1, "two", 2), (None, None, None, "three", 3)],
        "source string, artifact_id string, created_ms bigint, payload string, arrival bigint",
    )
    stamped = state.stamp_batch(batch, 99).withColumn("day", F.lit(0))
    for _ in range(2):
        tables.upsert_table(spark, path, stamped, state.UPSERT_KEYS, ["source"])
        rows = {(r["source"], r["artifact_id"], r["created_ms"]): r["payload"] for r in spark.read.parquet(path).collect()}
        assert rows == {("browser", "a", 1): "two", ("other", "unknown", 99): "three"}


def test_insert_if_missing(spark):
    old = spark.createDataFrame([("m", "p", 1), ("m", "p", 1)], "source string, payload string, created_ms bigint")
    new = spark.createDataFrame([("m", "p", 1, 0), ("m", "q", 1, 2), ("m", "q", 1, 1)], "source string, payload string, created_ms bigint, arrival int")
    assert state.insert_if_missing(old, new, ["source", "payload", "created_ms"]).count() == 3


def test_file_and_page_delta(spark):
    files = spark.createDataFrame([("e", "new", "s"), ("e", "same", "s"), ("e", "changed", "s2"), ("e", "blank_sha", "s")], "export string, rel_path string, sha256 string")
    manifest = spark.createDataFrame([("e", "same", "s"), ("e", "changed", "s"), ("e", "blank_sha", "")], "export string, rel_path string, sha256 string")
    due = {r["rel_path"] for r in state.needs_processing(files, manifest, ["export", "rel_path"]).collect()}
    assert due == {"new", "changed", "blank_sha"}
    assert state.needs_processing(files, manifest, ["export", "rel_path"], force=True).count() == 4
    pages = spark.createDataFrame([("n", p, "s") for p in ("new", "done", "blank", "failed", "changed")], "note_uuid string, page_id string, png_sha256 string")
    known = spark.createDataFrame(
        [("n", "done", "s", "a", False), ("n", "blank", "s", "", True), ("n", "failed", "s", "", False), ("n", "changed", "t", "a", False)],
        "note_uuid string, page_id string, png_sha256 string, last_artifact_id string, blank boolean",
    )
    assert {r["page_id"] for r in state.needs_transcription(pages, known).collect()} == {"new", "failed", "changed"}


def test_upload_checks(spark):
    png = b"\x89PNG\r\n\x1a\nrest"
    good, sha = base64.b64encode(png).decode(), hashlib.sha256(png).hexdigest()
    text = base64.b64encode(b"text").decode()
    rows = [("ok.png", sha, good), ("../x", sha, good), ("b", sha, "%%%"), ("c", sha, ""), ("d", sha, text), ("e", "0" * 64, good), ("f", sha, good + "\n")]
    df = spark.createDataFrame(rows, "path string, sha256 string, b64 string")
    out = {r["path"]: r["reason"] for r in state.check_uploads(df, safe=predicates.safe_segment(F.col("path"))).collect()}
    assert out == {"ok.png": None, "../x": "unsafe path", "b": "bad base64", "c": "empty", "d": "not a png", "e": "hash mismatch", "f": "bad base64"}


RECORDS = "artifact_id string, source string, created_ms bigint, payload string"


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(
        [("m", "mobile", 1750000000000, '{"kind":"demo-mobile-1"}'), ("b1", "browser", 1750001000000, '{"kind":"pageview"}'), ("b2", "browser", 1750002000000, '{"kind":"pageview"}')],
        RECORDS,
    )


def test_views(spark, store):
    total = views.overview_totals(store).first()
    assert total["total"] == 3 and total["active_sources"] == ["browser", "mobile"]
    days = views.activity_histogram(store, 1750002000000).collect()
    assert len(days) == 14 and sum(r["n"] for r in days) == 3
    assert views.view_filter(store, ["mobile"]).count() == 1
    assert views.view_filter(store, None, 1750000500000, 1750003000000).count() == 2
    assert not views.is_narrowed([]) and views.is_narrowed(since_ms=0)
    lines = {r["source"]: r for r in views.source_timeline(store).collect()}
    assert set(lines) == {"mobile", "browser", "desktop", "journal", "other"}
    assert lines["browser"]["newest_ids"] == ["b2", "b1"] and lines["desktop"]["n"] == 0


def test_pairing(spark):
    reports = spark.createDataFrame([("r1", "rep1", 2, "pass"), (None, "rep2", 3, "fail")], "run_id string, artifact_id string, created_ms bigint, verdict string")
    embeddings = spark.createDataFrame([("r1", "e2", 5, 8, 2), ("r1", "e1", 4, 8, 1)], "run_id string, artifact_id string, n_windows bigint, embedding_dim bigint, place int")
    rows = views.pair_runs(reports, embeddings, ["place"]).collect()
    assert [(r["run_id"], r["embedding_id"], r["embedding_committed"]) for r in rows] == [("rep2", None, False), ("r1", "e1", True)]
    counts = views.verdict_counts(views.pair_runs(reports, embeddings, ["place"])).first()
    assert (counts["pass_count"], counts["fail_count"], counts["latest_verdict"]) == (1, 1, "fail")


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_temporal_split(spark, n):
    rows = spark.createDataFrame([(f"a{i}", i) for i in range(n)], "artifact_id string, created_ms bigint")
    out = views.temporal_split(rows).orderBy("created_ms").collect()
    train, valid = [r["created_ms"] for r in out if r["is_train"]], [r["created_ms"] for r in out if r["is_validation"]]
    assert (train, valid) == {0: ([], []), 1: ([0], []), 2: ([0, 1], [1]), 5: ([0, 1, 2, 3], [4])}[n]


def test_relative_time(spark):
    now = 1_700_000_000_000
    cases = {0: "just now", -61: "1m ago", -7200: "2h ago", -172800: "2d ago", -86400 * 65: "2mo ago", 30: "in <1m", 3 * 3600 + 300: "in 3h 05m", 86400 * 3: "in 3d"}
    for seconds, text in cases.items():
        assert one(spark, timefn.rel_time(F.lit(now + 1000 * seconds), F.lit(now))) == text
    assert one(spark, timefn.rel_time(F.lit(0), F.lit(now))) == "—"


def test_scalars(spark):
    assert one(spark, timefn.floor_index(F.lit(-1))) == -1
    assert one(spark, numbers.as_int(F.lit("12.7"))) == 12
    assert one(spark, numbers.round_stable(F.lit(2.675), 2)) == 2.68
    assert one(spark, numbers.round_stable(F.lit(-2.675), 2)) == -2.68
    digest = hashlib.sha256(b"abc").digest()
    words = [int.from_bytes(digest[2 * (i % 16): 2 * (i % 16) + 2], "big") / 65535 * 2 - 1 for i in range(18)]
    assert one(spark, vectors.hash_vector(F.lit("abc"), 18)) == pytest.approx(words)
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, ids.note_of_file(F.lit("boox.abc.p3-17.json"))) == "abc"
    assert one(spark, ids.safe_name(F.lit("a b/c"))) == "a-b-c"
    value = json.dumps({"b": [1, {"c": "é"}], "a": 1.0, "t": True, "n": None})
    assert one(spark, jsontext.canonical_json_exact(F.lit(value))) == '{"a":1.0,"b":[1,{"c":"\\u00e9"}],"n":null,"t":true}'
    shape = one(spark, jsontext.json_facts(F.lit(value)))
    assert (shape["depth"], shape["scalars"]) == (4, 3)


def test_record_normalisation(spark):
    raw = [
        json.dumps({"artifactId": "a", "source": "mobile", "payload": {"k": 1}, "createdAtEpochMs": 5, "provenanceMetadataJson": '{"p":1}', "extra": "x"}),
        json.dumps({"artifact_id": "b", "created_at": "1970-01-01T00:00:01Z", "provenance_metadata": "not json"}),
        json.dumps({"artifactId": "c"}),
    ]
    rows = {r["artifact_id"]: r for r in records.normalize_records(spark.createDataFrame([(r,) for r in raw], "raw string"), "raw").collect()}
    assert rows["a"]["extras"] == {"extra": "x"} and rows["a"]["provenance"] == '{"p":1}' and rows["a"]["ingested_at_ms"] == 5
    assert rows["b"]["created_at_ms"] == 1000 and rows["b"]["provenance"] is None and rows["b"]["payload"] == "{}"
    assert rows["c"]["created_at_ms"] is None


def test_visits(spark):
    visit = {
        "schema_version": "1.0", "event_type": "browser_visit", "source_app": "x", "device_id": "d", "visit_id": "v1", "canonical_host": "h",
        "visit_start_ms": 5, "visit_end_ms": 6, "dwell_ms": 1, "page_title": None, "raw_content_blocked": False,
        "provenance": {"collected_by": "e", "collection_version": "1", "collection_mode": "m", "recorded_at_ms": 7, "more": 1},
    }
    raw = [
        visit,
        {"artifactId": "w", "source": "mobile", "payload": {"browser_package": "com.x", "browser_name": "X", "observed_at_ms": 7}},
        {"payload": {"browser_package": "com.x", "observed_at_ms": 7}},
        {"event_type": "other"},
    ]
    df = records.validate_visits(spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string"), "raw")
    assert [len(r["errors"]) for r in df.collect()] == [0, 0, 0, 10]
    faulty = {**visit, "dwell_ms": "long", "visit_end_ms": 6.5, "raw_content_blocked": None, "input_context": {"focused": 1, "key": "x"}}
    del faulty["provenance"]["recorded_at_ms"]
    found = records.validate_visits(spark.createDataFrame([(json.dumps(faulty),), ("[1]",)], "raw string"), "raw").collect()
    assert found[0]["errors"] == [
        "visit_end_ms is no integer", "dwell_ms is no integer", "input_context.focused is no boolean",
        "provenance.recorded_at_ms is missing", "raw_content_blocked is no boolean", "input_context.key is not known",
    ]
    assert found[1]["errors"] == ["the record is no JSON object"]
    out = records.visit_records(df.where(F.size("errors") == 0), "raw").collect()
    assert [(r["artifact_id"], r["created_at_ms"], r["device_alias"]) for r in out] == [("v1", 5, "d"), ("w", 7, "unknown"), ("com.x-7", 7, "unknown")]


def test_note_timing_and_enrichment(spark):
    paths = [("n", "/d/n/shape/1750000000000#1750000060000.zip"), ("n", "/d/n/stash/archivedShape/1750000120000.zip"), ("n", "/d/n/shape/9999999999999.zip"), ("m", "/d/m/stash/1750000000000.zip")]
    timing = journal.note_timing(journal.strokes(spark.createDataFrame(paths, "note_uuid string, path string"), "/d"))
    rows = {r["note_uuid"]: r for r in timing.collect()}
    assert (rows["n"]["total_strokes"], rows["n"]["live_strokes"], rows["n"]["modified_end_ms"]) == (3, 2, 1750000060000)
    assert rows["m"]["modified_end_ms"] == 1750000000000 and rows["m"]["live_strokes"] == 0
    out = journal.enrich_records(spark.createDataFrame([("n",), ("none",)], "note_uuid string"), timing, 1).collect()
    blocks = {r["note_uuid"]: r["noteTemporal"] for r in out}
    assert blocks["none"] is None and blocks["n"]["durationSec"] == 120


def test_journal_run_is_idempotent_and_isolates_failures(spark):
    def engine(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return {"text": content.decode()}

    pages = spark.createDataFrame(
        [("n", "p1", 1, "s1", b"hello", 5), ("n", "p2", 2, "s2", b"blank", 5), ("n", "p3", 3, "s3", b"bad", 5)],
        "note_uuid string, page_id string, page_order bigint, png_sha256 string, content binary, captured_ms bigint",
    )
    none = spark.createDataFrame([], "note_uuid string, page_id string, png_sha256 string, last_artifact_id string, blank boolean")
    made, commits, summary = jobs.ingest_journal(pages, none, engine, 9)
    assert [r["artifact_id"] for r in made.collect()] == ["boox.n.p1"]
    s = summary.first()
    assert (s["pages_new"], s["blank_pages"], s["failed_pages"]) == (1, 1, 1)
    again, _, second = jobs.ingest_journal(pages, commits, engine, 10)
    assert again.count() == 0 and second.first()["total_pages"] == 1  # only the failed page is taken again


def test_gate(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    rows = spark.createDataFrame([(f"a{i}", i, [float(v) for v in r]) for i, r in enumerate(x)], "artifact_id string, t bigint, embedding array<double>")
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    gram = unit @ unit.T
    expected = (gram.sum() - np.trace(gram)) / (40 * 39)
    assert embedding.mean_offdiag_cosine(rows).first()["mean_cosine"] == pytest.approx(expected, abs=1e-12)
    pairs = (unit[1:] * unit[:-1]).sum(axis=1).mean()
    assert embedding.temporal_coherence(rows, ["t"]).first()["coherence"] == pytest.approx(pairs, abs=1e-9)
    verdicts = {}
    for name, loss in (("good", 0.1), ("high", 9.0), ("nan", float("nan")), ("inf", float("inf"))):
        parts = []
        report = embedding.quality_report(rows, ["t"], F.lit(loss), "r")
        verdicts[name] = (embedding.gated_commit(report, rows, ["t"], "r", lambda part, df: parts.append(part)), parts)
    failed = ("fail", ["report", "lineage", "module_run"])
    assert verdicts == {"good": ("pass", ["report", "embedding", "lineage", "module_run"]), "high": failed, "nan": failed, "inf": failed}
    dry = embedding.quality_report(rows, ["t"], F.lit(0.1), "r")
    assert embedding.gated_commit(dry, rows, ["t"], "r", lambda *a: pytest.fail("wrote"), dry_run=True) == "dry-run"
    empty = embedding.quality_report(rows.where("t < 0"), ["t"], F.lit(0.1), "r")
    assert embedding.gated_commit(empty, rows, ["t"], "r", lambda *a: pytest.fail("wrote")) == "skip"


def test_training_lowers_the_loss_and_warm_start_goes_on(spark):
    data = [(f"a{i}", "mobile" if i % 2 else "browser", 60000 * i, json.dumps({"kind": f"k{i % 3}", "demo": True})) for i in range(60)]
    rows = embedding.features(spark.createDataFrame(data, "artifact_id string, source string, created_ms bigint, payload string"))
    assert len(rows.first()["features"]) == 17
    weights, losses = embedding.train(rows, embedding.new_weights(), epochs=4)
    assert losses[-1] < losses[0]
    stored = embedding.weights_rows(spark, weights, "weekly", "r1", 1)
    warm = embedding.last_weights(stored, "weekly")
    _, again = embedding.train(rows, warm, epochs=1)
    assert again[0] == pytest.approx(losses[-1])
    assert embedding.last_weights(stored, "monthly") is None and not embedding.starts_warm("monthly")
    # the gradient of the first weight agrees with a finite difference
    start = embedding.new_weights()
    gradient, _, n = embedding._epoch_sums(rows, start)
    def loss(delta):
        moved = [(w.copy(), b) for w, b in start]
        moved[0][0][0, 0] += delta
        return embedding._epoch_sums(rows, moved)[1]
    assert gradient[0] / n == pytest.approx((loss(1e-5) - loss(-1e-5)) / 2e-5 / n, rel=1e-4, abs=1e-9)
