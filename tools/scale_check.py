"""Wall time of the window producer and the multi-span rollup as the number of heart-rate bins grows.

    python tools/scale_check.py [bins ...]        # default 42655 426550 4265500
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chronogrid.operators import rollup, signals  # noqa: E402
from chronogrid.session import build_session  # noqa: E402

EMPTY = {
    "hrv": "device string, start_ms bigint, end_ms bigint, sdnn_ms double, rmssd_ms double, source_file string, seq bigint",
    "stress": "device string, start_ms bigint, end_ms bigint, score double",
    "sleep": "device string, start_ms bigint, end_ms bigint, stage_code bigint",
}


def main() -> None:
    sizes = [int(a) for a in sys.argv[1:]] or [42_655, 426_550, 4_265_500]
    spark = build_session("local[8]", "scale", **{"spark.sql.shuffle.partitions": "16", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    none = {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}
    for warm, n in [(True, sizes[0])] + [(False, n) for n in sizes]:
        start = F.lit(1_700_000_000_000) + F.col("id") * 61_000
        bins = spark.range(n).select(
            F.lit("watch").alias("device"), start.alias("start_ms"), (start + 60_000).alias("end_ms"),
            (F.lit(60.0) + F.pmod(F.col("id") * 7, F.lit(40))).alias("bpm"), F.lit(50.0).alias("bpm_min"),
            F.lit(120.0).alias("bpm_max"), F.col("id").alias("seq"),
        )
        began = time.perf_counter()
        windows = signals.produce_windows(bins, none["hrv"], none["stress"], none["sleep"]).persist()
        rows = windows.count()
        middle = time.perf_counter()
        rollups = rollup.build_rollups(windows).count()
        if not warm:
            print(f"{n} bins: {rows} windows in {middle - began:.2f}s, {rollups} rollups in {time.perf_counter() - middle:.2f}s")
        windows.unpersist()
    spark.stop()


if __name__ == "__main__":
    main()
