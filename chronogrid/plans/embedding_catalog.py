"""Feature, embedding and gate queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronogrid.constants import DIVERSITY_MAX, LOSS_MAX, SOURCES
from chronogrid.functions import vectors
from chronogrid.functions.numbers import round_stable
from chronogrid.operators import embedding as emb
from chronogrid.plans import bindings as b
from chronogrid.plans import jobs
from chronogrid.plans.registry import register
from chronogrid.plans.state_catalog import ARTIFACTS, artifacts
from chronogrid.session import cut_lineage, scratch_path

UNITS = """sq AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings),
cells AS (SELECT vec_id, unnest(embedding)::DOUBLE / (len + 1e-12) AS u, generate_subscripts(embedding, 1) AS dim FROM sq),
dims AS (SELECT dim, sum(u) AS s, sum(u * u) AS own, count(*) AS n FROM cells GROUP BY dim),
diversity AS (SELECT (sum(s * s) - sum(own)) / (max(n) * (max(n) - 1)) AS mean_cosine, max(n) AS n FROM dims)"""

PAIRS = """linked AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (ORDER BY vec_id) AS p FROM embeddings),
dots AS (SELECT list_sum(list_transform(list_zip(a, p), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS d,
  sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(p, lambda x: x::DOUBLE * x::DOUBLE))) AS l
  FROM linked WHERE p IS NOT NULL),
coherence AS (SELECT avg(CASE WHEN l = 0 THEN 0.0 ELSE d / l END) AS coherence FROM dots)"""


def vectors_of(spark, sf_dir):
    return b.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


@register("d21_mean_offdiag_cosine", f"WITH {UNITS} SELECT {b.rnd('mean_cosine', 9)} AS mean_cosine, n FROM diversity")
def d21(spark, sf_dir):
    found = emb.mean_offdiag_cosine(vectors_of(spark, sf_dir))
    return found.select(round_stable(F.col("mean_cosine"), 9).alias("mean_cosine"), "n")


@register(
    "d22_reconstruction_mse",
    f"""SELECT {b.rnd('avg(e / 64)', 9)} AS loss FROM (SELECT list_sum(list_transform(list_zip(embedding, list_reverse(embedding)),
        lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS e FROM embeddings)""",
)
def d22(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).withColumn("rebuilt", F.reverse("embedding"))
    return emb.reconstruction_loss(rows, "embedding", "rebuilt").select(round_stable(F.col("loss"), 9).alias("loss"))


@register("e04_temporal_coherence", f"WITH {PAIRS} SELECT {b.rnd('coherence', 9)} AS coherence FROM coherence")
def e04(spark, sf_dir):
    found = emb.temporal_coherence(vectors_of(spark, sf_dir), ["vec_id"])
    return found.select(round_stable(F.col("coherence"), 9).alias("coherence"))


@register(
    "l05_quality_report",
    f"""WITH {UNITS}, {PAIRS} SELECT 'run-1' AS run_id, n AS n_artifacts, 0.5::DOUBLE AS final_loss, {LOSS_MAX}::DOUBLE AS loss_threshold, true AS loss_passed,
        {b.rnd('mean_cosine', 6)} AS diversity, {DIVERSITY_MAX}::DOUBLE AS diversity_threshold, mean_cosine <= {DIVERSITY_MAX} AS diversity_passed,
        {b.rnd('coherence', 6)} AS coherence, CASE WHEN mean_cosine <= {DIVERSITY_MAX} THEN 'pass' ELSE 'fail' END AS verdict FROM diversity, coherence""",
)
def l05(spark, sf_dir):
    return emb.quality_report(vectors_of(spark, sf_dir), ["vec_id"], F.lit(0.5), "run-1")


@register(
    "l07_embedding_rows",
    "SELECT vec_id, printf('window-%03d', row_number() OVER (ORDER BY vec_id) - 1) AS label, 'run-1' AS run_id FROM embeddings",
)
def l07(spark, sf_dir):
    return emb.embedding_rows(vectors_of(spark, sf_dir), ["vec_id"], "run-1").select("vec_id", "label", "run_id")


# The payload of an event record has two keys, or one without a kind, and as many scalars; its depth is 2.
_HASHES = [f"(('0x' || substr(sha256(canon), {4 * i + 1}, 4))::BIGINT / 65535.0::DOUBLE * 2 - 1)" for i in range(8)]
_KEYS = "CASE WHEN kind = '(untyped)' THEN 1 ELSE 2 END / 16.0::DOUBLE"
_VALUES = [f"(source = '{s}')::INT::DOUBLE" for s in SOURCES] + _HASHES + [_KEYS, "0.25::DOUBLE", _KEYS, "(kind <> '(untyped)')::INT::DOUBLE"]
_CANON = f"""{ARTIFACTS}, f AS (SELECT *, CASE WHEN kind = '(untyped)' THEN '{{"k":' || k || '}}' ELSE '{{"k":' || k || ',"kind":"' || kind || '"}}' END AS canon FROM art)"""


@register("l01_features", f"WITH {_CANON} SELECT artifact_id, {', '.join(f"{b.rnd(f'({v})::FLOAT::DOUBLE', 5)} AS f{i}" for i, v in enumerate(_VALUES))} FROM f")
def l01(spark, sf_dir):
    rows = emb.features(artifacts(spark, sf_dir))
    at = F.col("features").cast("array<double>")
    return rows.select("artifact_id", *[round_stable(at[i], 5).alias(f"f{i}") for i in range(17)])


def feature_rows(spark, sf_dir):
    return emb.features(artifacts(spark, sf_dir)).select("artifact_id", "created_ms", "features")


def _layers_sql() -> str:
    """The forward pass with the first weights as numbers: one list per layer."""
    steps, before = [], "x"
    layers = emb.new_weights()
    for i, (w, bias) in enumerate(layers):
        cells = []
        for j in range(w.shape[1]):
            total = " + ".join(f"{before}[{r + 1}] * ({float(w[r, j])!r})::DOUBLE" for r in range(w.shape[0]))
            total = f"({total} + ({float(bias[j])!r})::DOUBLE)"
            cells.append(total if i == len(layers) - 1 else f"tanh({total})")
        steps.append(f"y{i} AS (SELECT *, [{', '.join(cells)}] AS a{i} FROM {f'y{i - 1}' if i else 'y'})")
        before = f"a{i}"
    return ", ".join(steps)


_ERROR = " + ".join(f"(x[{i + 1}] - a3[{i + 1}]) * (x[{i + 1}] - a3[{i + 1}])" for i in range(17))


@register(
    "l02_embedding_scores",
    f"""WITH {_CANON}, y AS (SELECT artifact_id, [{', '.join(f'({v})::FLOAT::DOUBLE' for v in _VALUES)}] AS x FROM f), {_layers_sql()}
        SELECT artifact_id, {', '.join(f"{b.rnd(f'a1[{i + 1}]', 6)} AS z{i}" for i in range(8))}, {b.rnd(f'({_ERROR}) / 17', 6)} AS error FROM y3""",
)
def l02(spark, sf_dir):
    scored = emb.score(feature_rows(spark, sf_dir), emb.default_backend(emb.new_weights()))
    return scored.select(
        "artifact_id", *[round_stable(F.col("embedding")[i], 6).alias(f"z{i}") for i in range(8)],
        round_stable(vectors.squared_error_mean(F.col("features"), F.col("reconstruction")), 6).alias("error"),
    )


def mean_backend(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A second backend: eight block means, and the row mean as reconstruction."""
    blocks = np.stack([part.mean(axis=1) for part in np.array_split(x, 8, axis=1)], axis=1)
    return blocks, np.repeat(x.mean(axis=1, keepdims=True), x.shape[1], axis=1)


@register(
    "k02_swapped_backend",
    f"""SELECT vec_id, {b.rnd('list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64', 6)} AS mean, """
    + ", ".join(f"{b.rnd(f'list_sum(list_transform(embedding[{8 * i + 1}:{8 * i + 8}], lambda x: x::DOUBLE)) / 8', 6)} AS z{i}" for i in range(8))
    + " FROM embeddings",
)
def k02(spark, sf_dir):
    rows = vectors_of(spark, sf_dir).select("vec_id", F.col("embedding").alias("features"))
    scored = emb.score(rows, mean_backend)
    return scored.select(
        "vec_id", round_stable(F.col("reconstruction")[0], 6).alias("mean"),
        *[round_stable(F.col("embedding")[i], 6).alias(f"z{i}") for i in range(8)],
    )


@register("l03_training_curve")
def l03(spark, sf_dir):
    """Losses of a short data-parallel run over all records."""
    rows = cut_lineage(feature_rows(spark, sf_dir))
    _, losses = emb.train(rows, emb.new_weights(), epochs=3)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "epoch int, loss double")


@register("l04_warm_start")
def l04(spark, sf_dir):
    """A weekly run goes on from stored weights, so its first loss is the last one of the run before."""
    rows = cut_lineage(feature_rows(spark, sf_dir))
    weights, losses = emb.train(rows, emb.new_weights(), epochs=2)
    path = scratch_path(spark, "weights")
    emb.weights_rows(spark, weights, "weekly", "run-a", b.NOW_MS).write.parquet(path)
    stored = spark.read.parquet(path)
    start = emb.last_weights(stored, "weekly") if emb.starts_warm("weekly") else emb.new_weights()
    _, again = emb.train(rows, start, epochs=1)
    return spark.createDataFrame([(losses[-1], again[0], again[-1])], "last_loss double, warm_loss double, next_loss double")


_RUNS = {"pass": (0.5, False), "fail": (9.0, False), "dry": (0.5, True), "empty": (0.5, False)}


@register(
    "l06_gated_commit",
    """WITH v AS (SELECT vec_id::VARCHAR AS id FROM embeddings)
       SELECT 'pass' AS run, 'report' AS part, 'pass.report' AS child, 'pass' AS parent UNION ALL SELECT 'fail', 'report', 'fail.report', 'fail'
       UNION ALL SELECT run, 'lineage', run || '.report', id FROM v, (VALUES ('pass'), ('fail')) r(run)
       UNION ALL SELECT 'pass', 'lineage', 'pass.embedding', id FROM v UNION ALL SELECT 'pass', 'lineage', 'pass.embedding', 'pass.report'
       UNION ALL SELECT 'pass', 'embedding', 'pass.embedding', id FROM v
       UNION ALL SELECT 'pass', 'module_run', 'representation_weekly', 'pass.embedding,pass.report' UNION ALL SELECT 'fail', 'module_run', 'representation_weekly', 'fail.report'
       UNION ALL SELECT 'pass', 'weights', 'weekly', layer::VARCHAR FROM range(4) t(layer)""",
)
def l06(spark, sf_dir):
    """All that a passing, a failing, a dry and an empty run leave behind."""
    rows = vectors_of(spark, sf_dir).withColumn("artifact_id", F.col("vec_id").cast("string"))
    named = {
        "report": ("artifact_id", "verdict"), "lineage": ("child_id", "parent_id"), "embedding": ("embedding_id", "artifact_id"),
        "module_run": ("module", "array_join(artifact_ids, ',')"), "weights": ("cadence", "cast(layer as string)"),
    }
    base, written = scratch_path(spark, "gate"), []

    def writer(run):
        def write(part, df):
            path = f"{base}/{run}-{part}"
            df.write.parquet(path)
            child, parent = named[part]
            written.append(spark.read.parquet(path).select(
                F.lit(run).alias("run"), F.lit(part).alias("part"), F.expr(child).alias("child"), F.expr(parent).alias("parent")
            ))

        return write

    for run, (loss, dry) in _RUNS.items():
        mine = rows.where("false") if run == "empty" else rows
        report = emb.quality_report(mine, ["vec_id"], F.lit(loss), run)
        state = emb.weights_rows(spark, emb.new_weights(), "weekly", run, b.NOW_MS)
        emb.gated_commit(report, mine, ["vec_id"], run, writer(run), dry_run=dry, cadence="weekly", weights=state, now_ms=b.NOW_MS)
    out = written[0]
    for more in written[1:]:
        out = out.unionByName(more)
    return out


@register(
    "l06_representation_run",
    f"""WITH {ARTIFACTS} SELECT 'pass' AS verdict, count(*) AS n_artifacts, true AS learnt, false AS first_warm, true AS second_warm, true AS goes_on FROM art""",
)
def l06_run(spark, sf_dir):
    """Two weekly runs over all records: the second starts from the weights of the first, where its loss goes on."""
    base, parts = scratch_path(spark, "represent"), {}

    def writer(run):
        def write(part, df):
            df.write.parquet(f"{base}/{run}-{part}")
            parts[run, part] = f"{base}/{run}-{part}"

        return write

    rows = artifacts(spark, sf_dir)
    first = jobs.represent(rows, None, "weekly", 1, writer("a"), epochs=2, loss_max=10.0, diversity_max=1.0)
    stored = spark.read.parquet(parts["a", "weights"])
    second = jobs.represent(rows, stored, "weekly", 2, writer("b"), epochs=1, loss_max=10.0, diversity_max=1.0)
    a, c = first.alias("a"), second.alias("b")
    both = a.join(c, F.col("a.n_artifacts") == F.col("b.n_artifacts"))  # one row each
    return both.select(
        F.col("b.verdict").alias("verdict"), F.col("b.n_artifacts").alias("n_artifacts"), (F.col("a.final_loss") < F.col("a.first_loss")).alias("learnt"),
        F.col("a.warm_start").alias("first_warm"), F.col("b.warm_start").alias("second_warm"),
        (F.abs(F.col("b.first_loss") - F.col("a.final_loss")) < 1e-9).alias("goes_on"),
    )
