"""The stateful rolling proxy: out of order, too late, restarted, and what stays in the state."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid.operators import signals
from chronogrid.streaming import jobs, rolling

BINS = "device string, start_ms bigint, end_ms bigint, bpm double, bpm_min double, bpm_max double, seq bigint, arrival int"
COLUMNS = ["device", "canonical_index", "bpm", "bins_used"]
MINUTE = 60_000


def feed(spark, tmp_path, rows, batches, restart_after=None):
    """Files in the order of arrival, one a batch; with ``restart_after`` the query ends there and starts again."""
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame(rows, BINS)
    left = 0
    for part in range(batches):
        df.where(F.col("arrival") == part).coalesce(1).write.mode("append").parquet(inbox)
        if part == batches - 1 or part == restart_after:
            stream = jobs.read_inbox(spark, inbox, df.schema, files_per_batch=1)
            left = rolling.drain_stream(rolling.proxy_stream(stream, "5 minutes"), out, mark)
    sent = rolling.read_sent(spark, out)
    return df, sent, left


def expected(rows, lateness, batches):
    """(accepted rows, late sequence numbers, last watermark) by the rule of the docstring."""
    newest, good, late = None, [], set()
    for part in range(batches):
        mark = 0 if newest is None else newest - lateness
        now = [r for r in rows if r[-1] == part]
        for r in now:
            (late.add(r[6]) if r[1] <= mark else good.append(r))
        newest = max([newest or 0] + [r[1] for r in now])
    return good, late, newest - lateness


@pytest.mark.parametrize("restart_after", [None, 1])
def test_stream_out_of_order_equals_batch_and_sets_late_bins_aside(spark, tmp_path, restart_after):
    rng, rows, seq = random.Random(3), [], 0
    for part in range(4):
        for device in ("d1", "d2"):
            for _ in range(60):
                seq += 1
                start = rng.randrange(part * 40 * MINUTE + 1, (part * 40 + 44) * MINUTE)  # up to four minutes of overlap
                start = start - start % 15_000 if rng.random() < 0.3 else start  # some on the edge of a window
                value = float(rng.randrange(50, 60))
                rows.append((device, max(start, 1), start + 1000, value, value - 1, value + 1, seq, part))
    for r in rows[5:15]:  # copies in a later reading of the same minute
        seq += 1
        rows.append((*r[:6], seq, r[7]))
    for minute in (2, 61, 100):  # far behind the watermark of the last batch
        seq += 1
        rows.append(("d1", minute * MINUTE + 7, minute * MINUTE + 9, 90.0, 89.0, 91.0, seq, 3))
    df, sent, left = feed(spark, tmp_path, rows, 4, restart_after)
    good, late, mark = expected(rows, 5 * MINUTE, 4)
    assert len(late) >= 3
    batch = signals.rolling_proxy(signals.dedup_bins(spark.createDataFrame(good, BINS)))
    closed = batch.where((F.col("canonical_index") + 1) * MINUTE <= mark)
    want = sorted(tuple(r) for r in closed.select(*COLUMNS).collect())
    assert len(want) > 100
    assert sorted(tuple(r) for r in sent.where("not late").select(*COLUMNS).collect()) == want
    assert {r["seq"] for r in sent.where("late").collect()} == late and sent.where("late").count() == len(late)
    # what is kept: bins that an open window can need, in at most two blocks, and a mark a block
    needed = [r for r in good if r[1] >= (mark // MINUTE - 9) * MINUTE]
    assert left <= 2 * len(needed) + 4 * 4


def test_rows_without_device_or_start_and_an_empty_inbox(spark, tmp_path):
    rows = [(None, 5, 6, 1.0, 1.0, 1.0, 1, 0), ("d", None, 6, 1.0, 1.0, 1.0, 2, 0), ("d", 9_000_000, 9_000_001, 1.0, 1.0, 1.0, 3, 0)]
    _, sent, _ = feed(spark, tmp_path, rows, 1)
    assert sent.count() == 0


def test_band_sums_against_every_pair():
    rng = np.random.default_rng(1)
    starts = np.sort(rng.integers(0, 60 * MINUTE, 200) // 20_000 * 20_000)
    bpm = rng.integers(50, 99, 200).astype(float)
    windows = np.unique(starts // MINUTE)
    used, squares = rolling.band_sums(starts, bpm, windows, 10)
    for i, n, s in zip(windows, used, squares):
        inside = bpm[(starts >= (i - 9) * MINUTE) & (starts <= (i + 1) * MINUTE)]
        assert n == len(inside) and abs(s - (np.diff(inside) ** 2).sum()) < 1e-6
