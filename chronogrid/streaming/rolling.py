"""Rolling proxy as a keyed stateful stream in append mode.

State lies by device and block of an hour, so the past of one crowded device is
spread over many tasks. A block gets its own bins, those of the last ``band``
minutes of the block before, and a bin that starts exactly at its end. A window
is sent once, when the watermark has reached its end; bins that no open window
can need are taken out of the state then, and the state of a block goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronogrid.constants import PROXY_BAND_BINS, RESOLUTION_MS
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index
from chronogrid.operators.signals import BLOCK_MINUTES
from chronogrid.streaming.jobs import DAY_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

ALIKE = ["minute", "r_bpm", "r_low", "r_high"]
ORDER = ["start_ms", "end_ms", "seq"]
KEPT = [*ORDER, "bpm", *ALIKE]
STATE = "start_ms bigint, end_ms bigint, seq bigint, bpm double, minute bigint, r_bpm double, r_low double, r_high double"
OUT = (
    "device string, canonical_index bigint, bins_used bigint, pairs bigint, square_sum double, "
    "late boolean, start_ms bigint, end_ms bigint, seq bigint, bpm_in double"
)
SENT = (
    "device string, canonical_index bigint, bpm double, bins_used bigint, start_ms bigint, end_ms bigint, "
    "seq bigint, bpm_in double, late boolean, day bigint"
)


def band_sums(starts: np.ndarray, bpm: np.ndarray, windows: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, sum of squared steps) of every window; ``starts`` ascending, both ends of a band inclusive."""
    steps = np.nan_to_num(np.diff(bpm)) ** 2
    upto = np.concatenate([[0.0, 0.0], np.cumsum(steps)])[: len(bpm) + 1]  # steps that end before a place
    first = np.searchsorted(starts, (windows - band + 1) * RESOLUTION_MS, "left")
    behind = np.searchsorted(starts, (windows + 1) * RESOLUTION_MS, "right")
    inside = upto[behind] - upto[np.minimum(first + 1, behind)]
    return behind - first, inside


class RollingProxy(StatefulProcessor):
    """Keeps the earliest bin of a minute and reading; sends closed windows and, marked, bins that came too late."""

    def __init__(self, band: int, size: int) -> None:
        self.band, self.size = band, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getListState("bins", STATE)
        self.done = handle.getValueState("done", "until_ms bigint")

    def close(self) -> None:
        pass

    def _stored(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.bins.get()], columns=KEPT)

    def _next_timer(self, held: pd.DataFrame, block: int, until: int) -> None:
        """One timer: the end of the earliest open window of the block, else the end of the block."""
        first, last = block * self.size, (block + 1) * self.size
        ends = (held["minute"][held["minute"].between(first, last - 1)] + 1) * RESOLUTION_MS
        ends = ends[ends > until]
        wanted = (int(ends.min()) if len(ends) else last * RESOLUTION_MS) - 1
        for other in list(self.handle.listTimers()):
            if other != wanted:
                self.handle.deleteTimer(other)
        self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        device, block = key[0], int(key[1])
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = pd.concat(list(rows), ignore_index=True)
        late = fresh["start_ms"] <= mark
        gone = fresh[late & fresh["own"]]
        if len(gone):
            yield pd.DataFrame(
                {
                    "device": device, "canonical_index": gone["minute"], "bins_used": 0, "pairs": 0, "square_sum": 0.0,
                    "late": True, "start_ms": gone["start_ms"], "end_ms": gone["end_ms"], "seq": gone["seq"], "bpm_in": gone["bpm"],
                }
            )
        fresh = fresh[~late][KEPT]
        if not len(fresh):
            return
        held = self._stored() if self.bins.exists() else fresh.iloc[:0]
        held = pd.concat([held, fresh], ignore_index=True) if len(held) else fresh
        held = held.sort_values(ORDER).drop_duplicates(ALIKE)
        self.bins.put(list(held.astype(object).where(held.notna(), None).itertuples(index=False, name=None)))
        until = self.done.get()[0] if self.done.exists() else mark
        self._next_timer(held, block, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        device, block = key[0], int(key[1])
        mark = timerValues.getCurrentWatermarkInMs()
        if not self.bins.exists():
            return
        held = self._stored().sort_values(ORDER)
        until = self.done.get()[0] if self.done.exists() else None
        windows = np.unique(held["minute"].to_numpy(dtype="int64"))
        ends = (windows + 1) * RESOLUTION_MS
        closed = (windows // self.size == block) & (ends <= mark)
        if until is not None:
            closed &= ends > until
        windows = windows[closed]
        if len(windows):
            used, squares = band_sums(
                held["start_ms"].to_numpy(dtype="int64"), held["bpm"].to_numpy(dtype="float64"), windows, self.band
            )
            sent = used >= 2
            if sent.any():
                yield pd.DataFrame(
                    {
                        "device": device, "canonical_index": windows[sent], "bins_used": used[sent], "pairs": used[sent] - 1,
                        "square_sum": squares[sent], "late": False, "start_ms": None, "end_ms": None, "seq": None, "bpm_in": None,
                    }
                )
        first_open = mark // RESOLUTION_MS
        if first_open >= (block + 1) * self.size:
            self.bins.clear()
            self.done.clear()
            return
        held = held[held["start_ms"] >= (first_open - self.band + 1) * RESOLUTION_MS]
        if len(held):
            self.bins.put(list(held.astype(object).where(held.notna(), None).itertuples(index=False, name=None)))
        else:
            self.bins.clear()
        self.done.update((mark,))
        self._next_timer(held, block, mark)


def proxy_stream(stream: DataFrame, lateness: str, band: int = PROXY_BAND_BINS) -> DataFrame:
    """Rows of the rolling proxy in append mode, and the bins that came too late.

    ``stream``: device, start_ms, end_ms, bpm, bpm_min, bpm_max, seq; rows without
    device or start are dropped, other columns ignored. A bin is too late when it
    starts at or before the watermark its batch runs with (newest start of all
    earlier batches less ``lateness``); it enters no window and comes out with
    ``late`` true, so that ``recompute_touched`` can mend its windows. Otherwise
    the result is that of ``signals.rolling_proxy`` over de-duplicated bins, for
    all windows whose end the watermark has reached. The query needs the RocksDB
    state store (``drain_stream`` sets it).
    """
    size = max(BLOCK_MINUTES, band)
    known = stream.where(F.col("device").isNotNull() & F.col("start_ms").isNotNull())
    timed = known.withColumn("ts", F.timestamp_millis("start_ms")).withWatermark("ts", lateness)
    minute = floor_index(F.col("start_ms"))
    block = floor_index(F.col("start_ms"), size * RESOLUTION_MS)
    places = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.when(minute + F.lit(band) >= (block + 1) * F.lit(size), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        F.when(F.col("start_ms") == block * F.lit(size * RESOLUTION_MS), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    )
    # without its time column Spark drops no late row in silence
    placed = timed.select(
        "device", *ORDER, "bpm", minute.alias("minute"),
        F.round("bpm", 3).alias("r_bpm"), F.round("bpm_min", 3).alias("r_low"), F.round("bpm_max", 3).alias("r_high"),
        F.inline(F.array_compact(places)),
    )
    sent = placed.groupBy("device", "block").transformWithStateInPandas(
        statefulProcessor=RollingProxy(band, size), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
    return sent.select(
        "device", "canonical_index",
        F.when(~F.col("late"), round_stable(F.sqrt(F.col("square_sum") / F.col("pairs")), 3)).alias("bpm"),
        F.when(~F.col("late"), F.col("bins_used")).alias("bins_used"),
        "start_ms", "end_ms", "seq", "bpm_in",
        floor_index(F.col("canonical_index") * F.lit(RESOLUTION_MS), DAY_MS).alias("day"), "late",
    )


def read_sent(spark: SparkSession, path: str) -> DataFrame:
    """What ``drain_stream`` has written; a scan of one kind or of some days opens only their folders."""
    return spark.read.schema(SENT).parquet(path)


def drain_stream(rows: DataFrame, path: str, checkpoint: str) -> int:
    """Append to a file sink by ``late`` and ``day``, exactly once; returns the rows of state left behind."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("late", "day").trigger(availableNow=True).outputMode("append").start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    progress = query.lastProgress
    return progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else 0
