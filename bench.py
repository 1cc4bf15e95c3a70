"""Headline queries: median of three timed runs after a warm-up, one JSON line on stdout.

BENCH_SF_DIR selects the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from chronogrid.plans.catalog import QUERIES
from chronogrid.session import build_session

HEADLINE = [
    "d07_rollup_multi_span",
    "d05_rollup_modality_stats",
    "c01_align_modalities",
    "c04_overlap_coverage",
    "e01_dedup_bins",
    "e02_rolling_proxy",
    "d01_hr_window_payload",
    "d04_sleep_window_payload",
    "a20_keyed_upsert",
    "a22_flat_windows",
    "b01_artifact_query",
    "c07_manifest_delta",
    "c11_report_pairing",
    "d13_source_kind_matrix",
    "d14_source_timeline",
    "d15_activity_histogram",
    "d18_note_timing",
    "d21_mean_offdiag_cosine",
    "e03_newest_per_group",
    "e04_temporal_coherence",
    "h14_hash_vector",
    "l01_features",
    "l02_embedding_scores",
    "n18_regime_runs",
    "m03_window_producer",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        run_once(spark, name, sf_dir)
        timings[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(3)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
