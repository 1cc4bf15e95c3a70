"""De-duplication, rolling proxy and the aligned windows, against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import ordered, signals

BINS = "device string, start_ms bigint, end_ms bigint, bpm double, bpm_min double, bpm_max double, seq bigint"


def make(spark, rows):
    data = [(d, s, s + 59000, float(v), 0.0, 0.0, i) for i, (d, s, v) in enumerate(rows)]
    return spark.createDataFrame(data, BINS)


def proxy(spark, rows, candidates):
    marks = spark.createDataFrame([("d", i) for i in candidates], "device string, canonical_index bigint")
    found = signals.rolling_proxy(make(spark, rows), marks).collect()
    return {r["canonical_index"]: (r["bpm"], r["bins_used"]) for r in found}


def brute(rows, candidates):
    out = {}
    series = sorted((s, i, v) for i, (_, s, v) in enumerate(rows))
    for c in candidates:
        band = [v for s, _, v in series if (c - 9) * 60000 <= s <= (c + 1) * 60000]
        if len(band) >= 2:
            steps = [(b - a) ** 2 for a, b in zip(band, band[1:])]
            out[c] = (round(math.sqrt(sum(steps) / len(steps)) + 1e-9, 3), len(band))
    return out


@pytest.mark.parametrize(
    ("values", "expected"), [([0, 10, 0, 10], 10.0), ([60, 65, 70, 65, 60], 5.0)]
)
def test_adjacent_difference(spark, values, expected):
    rows = [("d", 60000 * i, v) for i, v in enumerate(values)]
    assert proxy(spark, rows, [len(values) - 1])[len(values) - 1] == (expected, len(values))


def test_one_bin_gives_nothing(spark):
    assert proxy(spark, [("d", 0, 60)], [0, 1, 5]) == {}


def test_upper_edge_is_inclusive(spark):
    ten = [("d", 60000 * i, 60) for i in range(10)]
    found = proxy(spark, ten, [8, 9, 10])
    assert {i: n for i, (_, n) in found.items()} == {8: 10, 9: 10, 10: 9}
    assert proxy(spark, [("d", 0, 60), ("d", 540000, 70)], [9]) == {9: (10.0, 2)}
    sparse = proxy(spark, [("d", 0, 60), ("d", 300000, 60), ("d", 600000, 60)], [0, 1, 2, 3, 4, 9, 14])
    assert sorted(sparse) == [4, 9, 14]
    assert sparse[9][1] == 3


def test_random_series_match_brute_force(spark):
    rng = random.Random(7)
    starts = [rng.choice([rng.randrange(0, 3_600_000), 60000 * rng.randrange(0, 60)]) for _ in range(300)]
    starts += [120_000] * 40  # a crowded instant
    rows = [("d", s, rng.randrange(50, 120)) for s in starts]
    assert proxy(spark, rows, range(-2, 75)) == brute(rows, range(-2, 75))


def test_devices_do_not_mix(spark):
    rows = [("a", 0, 60), ("b", 60000, 90), ("a", 120000, 70)]
    marks = spark.createDataFrame([("a", 2), ("b", 2)], "device string, canonical_index bigint")
    found = signals.rolling_proxy(make(spark, rows), marks).collect()
    assert [(r["device"], r["bpm"]) for r in found] == [("a", 10.0)]


def test_dedup_keeps_the_earliest(spark):
    data = [("d", 10, 100, 60.0001, 1.0, 2.0, 0), ("d", 5, 100, 60.0002, 1.0, 2.0, 1), ("d", 70000, 80000, 60.0, 1.0, 2.0, 2)]
    kept = signals.dedup_bins(spark.createDataFrame(data, BINS)).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["copies"]) for r in kept] == [(5, 2), (70000, 1)]


def test_aligned_windows(spark):
    bins = make(spark, [("d", 0, 60), ("d", 60000, 70)])
    hrv = spark.createDataFrame(
        [("d", 30000, 90000, 50.126, 60.0, "f2", 0), ("d", 30000, 70000, 40.0, 41.0, "f1", 5)],
        "device string, start_ms bigint, end_ms bigint, sdnn_ms double, rmssd_ms double, source_file string, seq bigint",
    )
    stress = spark.createDataFrame([("d", 120000, 120000, None), ("d", 121000, 121000, 30.0)], "device string, start_ms bigint, end_ms bigint, score double")
    sleep = spark.createDataFrame([("d", 300000, 420000, 40002), ("d", 300000, 360000, 40001)], "device string, start_ms bigint, end_ms bigint, stage_code bigint")
    rows = {r["canonical_index"]: r for r in signals.produce_windows(bins, hrv, stress, sleep).collect()}
    assert sorted(rows) == [0, 1, 2, 5, 6]
    assert rows[0]["hrv_sdnn_ms"] == 40.0  # first by file, then position
    assert rows[1]["hrv_proxy_bpm"] == 10.0 and rows[1]["hrv_proxy_windows"] == 2
    assert rows[2]["stress_readings"] == 2 and rows[2]["stress_score"] == 30.0
    assert rows[2]["present_heart_rate"] is False and rows[2]["heart_rate_bpm"] is None
    assert rows[5]["sleep_stage_dominant_stage"] == 40001  # a tie goes to the smaller code
    assert rows[5]["sleep_stage_stage_codes"] == [40001, 40002]
    for r in rows.values():  # presence, payload and coverage agree
        assert r["present_hrv"] == (r["hrv_sdnn_ms"] is not None) == (r["cov_hrv"] == 1.0)


def test_order_helpers_match_plain_python(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(700)]
    df = spark.createDataFrame(data, "k string, t bigint, id bigint").repartition(5)
    ranked = sorted(data, key=lambda r: (r[0], r[1], r[2]))
    previous, numbers, last, count = {}, {}, {}, {}
    for k, t, i in ranked:
        previous[i] = last.get(k)
        last[k] = i
        count[k] = count.get(k, 0) + 1
        numbers[i] = count[k]
    got = {r["id"]: r["prev"] and r["prev"]["id"] for r in ordered.with_previous(df, ["k"], ["t", "id"], ["id"]).collect()}
    assert got == previous
    got = {r["id"]: r["position"] for r in ordered.with_group_position(df, ["k"], ["t", "id"]).collect()}
    assert got == numbers
    got = {r["id"]: r["position"] for r in ordered.with_position(df, ["t", "id"]).collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}


def test_distances_of_two_samples_with_ties_and_nulls(spark):
    import numpy as np

    from chronogrid.operators import experiments

    random = np.random.default_rng(4)
    before = [float(v) for v in random.integers(0, 40, 300)] + [7.0] * 400
    during = [float(v) for v in random.integers(5, 60, 200)]
    rows = [("baseline", v) for v in before] + [("experiment", v) for v in during] + [(None, 3.0), ("baseline", None)]
    found = experiments.two_sample_distance(spark.createDataFrame(rows, "period string, value double"), "value").first()
    values = sorted({*before, *during})
    gaps = [abs(np.mean(np.array(before) <= v) - np.mean(np.array(during) <= v)) for v in values]
    assert found["ks_distance"] == round(max(gaps), 6)
    assert abs(found["wasserstein"] - sum(g * (b - a) for g, a, b in zip(gaps, values, values[1:]))) < 1e-3
    assert (found["n_baseline"], found["n_experiment"]) == (700, 200)
    empty = experiments.two_sample_distance(spark.createDataFrame([], "period string, value double"), "value").first()
    assert tuple(empty) == (None, None, 0, 0)


def test_rolling_distinct_members_across_days(spark):
    from pyspark.sql import functions as F

    from chronogrid.operators import presence

    rows = [("a", 0, "x"), ("a", 0, "x"), ("a", 0, "y"), ("a", 3, "z"), ("a", 8, "y"), ("b", 9, None), ("b", 9, "q")]
    states = presence.distinct_states(spark.createDataFrame(rows, "app string, day int, m string"), [F.col("app"), F.col("day")], "m")
    found = {(r["app"], r["day"]): (r["members"], r["returning"]) for r in presence.rolling_distinct(states, ["app"]).collect()}
    assert found == {("a", 0): (2, 0), ("a", 3): (3, 0), ("a", 8): (2, 1), ("b", 9): (1, 0)}


def test_rolling_members_are_counted_not_estimated(spark):
    import random

    from pyspark.sql import functions as F

    from chronogrid.operators import presence

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(60), rng.choice([None, *"pqrst"])) for _ in range(90)]
    df = spark.createDataFrame(rows, "app string, day int, m string")
    found = {(r["app"], r["day"]): (r["members"], r["returning"]) for r in presence.rolling_members(df, ["app"], "m").collect()}

    def members(app, low, high):
        return {m for a, d, m in rows if a == app and low <= d <= high and m is not None}

    expected = {}
    for app, day, _ in rows:
        now, before = members(app, day - 6, day), members(app, day - 13, day - 7)
        expected[app, day] = (len(now), len(now & before))
    assert found == expected
    crowd = spark.range(20_000).select(F.lit("a").alias("app"), (F.col("id") % 2 * 7).alias("day"), (F.col("id") % 14_999).cast("string").alias("m"))
    counts = {(r["day"], r["members"], r["returning"]) for r in presence.rolling_members(crowd, ["app"], "m").collect()}
    assert counts == {(0, 10_000, 0), (7, 10_000, 5_001)}


def test_windows_are_spread_over_all_partitions(spark):
    """Small packed shuffle blocks hold many windows, so they are not merged into a few tasks with large maps."""
    bins = make(spark, [(f"d{i % 40}", 60000 * (i // 40), i % 7) for i in range(4000)])
    times = "device string, start_ms bigint, end_ms bigint, "
    hrv = spark.createDataFrame([], times + "sdnn_ms double, rmssd_ms double, source_file string, seq bigint")
    stress = spark.createDataFrame([], times + "score double")
    sleep = spark.createDataFrame([], times + "stage_code bigint")
    windows = signals.produce_windows(bins, hrv, stress, sleep).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in windows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(windows) == 4000 and {r["hrv_proxy_windows"] for r in windows if 9 <= r["canonical_index"] < 99} == {11}
