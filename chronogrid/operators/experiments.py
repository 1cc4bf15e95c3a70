"""Experiments: windows in scope, matched comparisons, regimes and drift."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.functions import vectors
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index
from chronogrid.operators.grid import last_index
from chronogrid.operators.ordered import CHUNK, previous_in_chunks, range_chunks

DAY_MS = 86_400_000


def in_scope(rows: DataFrame, experiments: DataFrame, at: str = "start_ms") -> DataFrame:
    """Rows inside each experiment's ``[from_ms, to_ms)``: an equi join on the day, then the exact bounds."""
    days = F.sequence(floor_index(F.col("from_ms"), DAY_MS), last_index(F.col("from_ms"), F.col("to_ms"), DAY_MS))
    spread = experiments.withColumn("_day", F.explode(days))
    keyed = rows.withColumn("_day", floor_index(F.col(at), DAY_MS))
    joined = keyed.join(spread, "_day").where((F.col(at) >= F.col("from_ms")) & (F.col(at) < F.col("to_ms")))
    return joined.drop("_day")


def period(ms: Column, baseline_from: int, split: int, until: int) -> Column:
    """``baseline`` before the split, ``experiment`` after it, NULL outside both."""
    return F.when((ms >= baseline_from) & (ms < split), F.lit("baseline")).when(
        (ms >= split) & (ms < until), F.lit("experiment")
    )


def effect(rows: DataFrame, keys: list[str], value: str, z: float = 1.96) -> DataFrame:
    """Shift of the experiment against the baseline per key: means, Cohen's d and an interval of the difference.

    ``rows`` carry ``period``. Everything follows from counts, means and variances of one grouped pass.
    """
    def side(name: str) -> list[Column]:
        v = F.when(F.col("period") == name, F.col(value))
        return [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"m_{name}"), F.var_samp(v).alias(f"v_{name}")]

    stats = rows.where("period is not null").groupBy(*keys).agg(*side("baseline"), *side("experiment"))
    n0, n1 = F.col("n_baseline"), F.col("n_experiment")
    shift = F.col("m_experiment") - F.col("m_baseline")
    pooled = F.sqrt(((n0 - 1) * F.col("v_baseline") + (n1 - 1) * F.col("v_experiment")) / F.nullif(n0 + n1 - 2, F.lit(0)))
    error = F.sqrt(F.col("v_baseline") / F.nullif(n0, F.lit(0)) + F.col("v_experiment") / F.nullif(n1, F.lit(0)))
    return stats.select(
        *keys, "n_baseline", "n_experiment",
        round_stable(F.col("m_baseline"), 4).alias("baseline_mean"), round_stable(F.col("m_experiment"), 4).alias("experiment_mean"),
        round_stable(shift, 4).alias("shift"), round_stable(shift / F.nullif(pooled, F.lit(0.0)), 4).alias("cohens_d"),
        round_stable(shift - F.lit(z) * error, 4).alias("ci_low"), round_stable(shift + F.lit(z) * error, 4).alias("ci_high"),
    )


def regime_frequency(rows: DataFrame, regime: str) -> DataFrame:
    """Share of each regime before and during the experiment."""
    counts = rows.where("period is not null").groupBy(regime).agg(
        F.count_if(F.col("period") == "baseline").alias("before"), F.count_if(F.col("period") == "experiment").alias("during")
    )
    totals = counts.agg(F.sum("before").alias("before"), F.sum("during").alias("during"))
    return counts.select(
        regime, "before", "during",
        round_stable(F.col("before") / totals.select("before").scalar(), 4).alias("before_share"),
        round_stable(F.col("during") / totals.select("during").scalar(), 4).alias("during_share"),
    )


def distribution_distance(rows: DataFrame, value: Column, label: str = "bucket") -> DataFrame:
    """Total variation distance between the two periods' histograms of ``value``."""
    shares = regime_frequency(rows.withColumn(label, value), label)
    return shares.agg(
        round_stable(F.sum(F.abs(F.col("before_share") - F.col("during_share"))) / 2, 4).alias("distance"),
        F.count(F.lit(1)).alias("buckets"),
    )


def two_sample_distance(rows: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein distance between the two periods' values, of any number of distinct values.

    Equal values are counted before anything is ordered, so a hot value is one
    row and ties step together. The running counts lie on range partitions;
    only one row a partition is put in order as a whole. Rows without value or
    period do not count; no row at all gives null distances.
    """
    known = rows.where(F.col(value).isNotNull() & F.col("period").isNotNull())
    steps = known.groupBy(F.col(value).alias("v")).agg(
        F.count_if(F.col("period") == "baseline").alias("x"), F.count_if(F.col("period") == "experiment").alias("y")
    )
    chunked = range_chunks(steps, ["v"])
    sizes = chunked.groupBy(CHUNK).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("v").alias("v"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.partitionBy()
    edges = sizes.select(
        CHUNK,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("x", "y")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("x", "y")],
        F.max("v").over(before).alias("v_before"),
    )
    inside = Window.partitionBy(CHUNK).orderBy("v")
    running = chunked.select(
        CHUNK, "v", "x", "y", F.sum("x").over(inside).alias("cx"), F.sum("y").over(inside).alias("cy"), F.lag("v").over(inside).alias("p")
    ).join(F.broadcast(edges), CHUNK)
    cx, cy = F.col("cx") + F.col("x_before"), F.col("cy") + F.col("y_before")
    here = F.abs(cx / F.col("x_all") - cy / F.col("y_all"))
    behind = F.abs((cx - F.col("x")) / F.col("x_all") - (cy - F.col("y")) / F.col("y_all"))
    gap = F.col("v") - F.coalesce("p", "v_before", "v")
    return running.agg(
        round_stable(F.max(here), 6).alias("ks_distance"),
        round_stable(F.sum(behind * gap), 4).alias("wasserstein"),
        F.coalesce(F.sum("x"), F.lit(0)).alias("n_baseline"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("n_experiment"),
    )


def runs(rows: DataFrame, key: str, order: list[str], label: str, at: str = "start_ms") -> DataFrame:
    """Runs of equal labels along each key (gaps and islands), without sorting a key in one task.

    The rows are spread by (key, order) once. A row starts a run when the label
    changes; the other rows take the last start before them, in their own chunk
    or, from one row per chunk, in those before it.
    """
    chunked = range_chunks(rows.select(*dict.fromkeys([key, label, *order, at])), [key, *order])
    linked = previous_in_chunks(chunked, [key], order, [label])
    opens = F.col("prev").isNull() | ~F.col(label).eqNullSafe(F.col(f"prev.{label}"))
    marked = linked.withColumn("_start", F.when(opens, F.struct(key, *order)))
    so_far = Window.partitionBy(CHUNK, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_run", F.last("_start", ignorenulls=True).over(so_far))
    tails = placed.groupBy(CHUNK).agg(F.max_by("_run", F.struct(key, *order)).alias("_tail"))
    earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = tails.select(CHUNK, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    joined = placed.join(F.broadcast(carried), CHUNK, "left")
    return joined.groupBy(key, label, F.coalesce("_run", "_carried").alias("_run")).agg(
        F.min(at).alias("from_ms"), F.max(at).alias("to_ms"), F.count(F.lit(1)).alias("length")
    ).drop("_run")


def regimes(rows: DataFrame, vector: str, k: int, seed: int) -> tuple[DataFrame, float]:
    """Cluster labels (``regime``) and the silhouette of the clustering."""
    pointed = rows.withColumn("_point", array_to_vector(vector))
    model = KMeans(featuresCol="_point", predictionCol="regime", k=k, seed=seed).fit(pointed)
    labelled = model.transform(pointed)
    silhouette = ClusteringEvaluator(featuresCol="_point", predictionCol="regime").evaluate(labelled)
    return labelled.drop("_point"), silhouette


def best_matching(counts: dict[tuple[int, int], int], k: int) -> int:
    """Largest number of rows that agree when the clusters of two fits are named one to one."""
    best = {0: 0}
    for other in range(k):
        step: dict[int, int] = {}
        for used, hits in best.items():
            for regime in range(k):
                if not used >> regime & 1:
                    taken = used | 1 << regime
                    step[taken] = max(step.get(taken, 0), hits + counts.get((other, regime), 0))
        best = step
    return max(best.values())


def bootstrap_agreement(rows: DataFrame, vector: str, k: int, seed: int, rounds: int = 3) -> DataFrame:
    """Share of rows on which clusterings of resamples agree with the full one, after matching cluster names one to one."""
    pointed = rows.withColumn("_point", array_to_vector(vector))
    base = KMeans(featuresCol="_point", predictionCol="regime", k=k, seed=seed).fit(pointed)
    labelled = base.transform(pointed)
    found = []
    for i in range(rounds):
        sample = pointed.sample(withReplacement=True, fraction=1.0, seed=seed + i + 1)
        model = KMeans(featuresCol="_point", predictionCol="other", k=k, seed=seed).fit(sample)
        pairs = model.transform(labelled).groupBy("other", "regime").agg(F.count(F.lit(1)).alias("n")).collect()  # k * k rows
        counts = {(r["other"], r["regime"]): r["n"] for r in pairs}
        agreement = best_matching(counts, k) / max(sum(counts.values()), 1)
        found.append((agreement, i, agreement > 0.85))
    return rows.sparkSession.createDataFrame(found, "agreement double, round int, stable boolean")


def ablation_agreement(rows: DataFrame, vector: str, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean cosine between each vector and itself with one block of dimensions set to zero."""
    parts = []
    for name, (low, high) in blocks.items():
        cut = F.transform(vector, lambda v, i: F.when((i >= low) & (i < high), F.lit(0.0)).otherwise(v.cast("double")))
        parts.append(F.struct(F.lit(name).alias("block"), vectors.cosine(F.col(vector), cut).alias("cosine")))
    spread = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return spread.groupBy("block").agg(round_stable(F.avg("cosine"), 6).alias("agreement"))


def retrain_trigger(rows: DataFrame, fitted_until: int, value: str, at: str, new_share: float = 0.01, max_shift: float = 0.2) -> DataFrame:
    """Whether enough is new since the last fit, or the mean has moved by a share of the old deviation."""
    old, new = F.col(at) <= fitted_until, F.col(at) > fitted_until
    stats = rows.agg(
        F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"),
        F.avg(F.when(old, F.col(value))).alias("_m0"), F.avg(F.when(new, F.col(value))).alias("_m1"),
        F.stddev_samp(F.when(old, F.col(value))).alias("_s0"),
    )
    share = F.col("n_new") / F.col("n_old")
    shift = F.abs(F.col("_m1") - F.col("_m0")) / F.col("_s0")
    return stats.select(
        "n_old", "n_new", round_stable(share, 4).alias("new_share"), round_stable(shift, 4).alias("mean_shift"),
        ((share > new_share) | F.coalesce(shift > max_shift, F.lit(False))).alias("retrain"),
    )
