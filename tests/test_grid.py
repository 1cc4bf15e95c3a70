"""Interval and point placement on the 60-second grid."""

from __future__ import annotations

import pytest

from chronogrid.operators import grid

ROWS = "device string, start_ms bigint, end_ms bigint, source string, seq bigint"


def cover(spark, intervals):
    rows = spark.createDataFrame([("d", s, e, u, i) for i, (s, e, u) in enumerate(intervals)], ROWS)
    found = grid.overlap_coverage(rows, ["device"]).orderBy("canonical_index").collect()
    return {r["canonical_index"]: r["coverage"] for r in found}


@pytest.mark.parametrize(
    ("intervals", "expected"),
    [
        ([(0, 60000, "a")], {0: 1.0}),
        ([(0, 30000, "a")], {0: 0.5}),
        ([(0, 30000, "a"), (30000, 60000, "b")], {0: 0.5}),  # the largest share, not the sum
        ([(30000, 90000, "a")], {0: 0.5, 1: 0.5}),
        ([(120000, 300000, "a")], {2: 1.0, 3: 1.0, 4: 1.0}),
        ([(-30000, 30000, "a")], {-1: 0.5, 0: 0.5}),
    ],
)
def test_overlap(spark, intervals, expected):
    assert cover(spark, intervals) == expected


def test_empty_interval_touches_one_cell(spark):
    rows = spark.createDataFrame([("d", 60000, 60000, "a", 0)], ROWS)
    assert [r["canonical_index"] for r in grid.expand_to_grid(rows).collect()] == [1]
    assert cover(spark, [(60000, 60000, "a")]) == {1: 0.0}


def test_sources_are_distinct_and_in_arrival_order(spark):
    rows = spark.createDataFrame([("d", 0, 1000, "b", 0), ("d", 10, 1000, "a", 1), ("d", 20, 1000, "b", 2)], ROWS)
    found = grid.cell_sources(rows, ["device"], "source", ["start_ms", "seq"]).orderBy("first_start_ms").collect()
    assert [r["source"] for r in found] == ["b", "a"]


def test_merge_takes_the_larger_coverage(spark):
    schema = "device string, canonical_index bigint, coverage double, present boolean"
    base = spark.createDataFrame([("d", 0, 0.5, True), ("d", 1, 0.0, False)], schema)
    extra = spark.createDataFrame([("d", 0, 1.0, True), ("d", 2, 0.25, True)], schema)
    merged = {r["canonical_index"]: (r["present"], r["coverage"]) for r in grid.merge_aligned(base, extra, ["device"]).collect()}
    assert merged == {0: (True, 1.0), 1: (False, 0.0), 2: (True, 0.25)}
