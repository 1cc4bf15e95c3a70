"""Features, embeddings, their quality metrics and the commit gate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.constants import DIVERSITY_MAX, LATENT_INDEX, LOSS_MAX, MODEL_DIMS
from chronogrid.functions import ids, vectors
from chronogrid.functions.jsontext import json_facts, n_keys
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.predicates import normalize_source
from chronogrid.operators.ordered import with_position, with_previous

EPSILON = 1e-12


# --- features (L-01) ---------------------------------------------------------------


def features(records: DataFrame, payload: str = "payload", source: str = "source") -> DataFrame:
    """Add ``features``: 17 floats per record.

    one-hot source (5), hash vector of the canonical payload (8), then key
    count, depth and scalar count on a 0-1 scale and a flag for a kind.
    """
    text = F.col(payload)
    shaped = records.withColumn("_shape", json_facts(text))

    def scaled(value: Column, full: float) -> Column:
        return F.least(value.cast("double") / F.lit(full), F.lit(1.0))

    has_kind = F.array_contains(F.json_object_keys(text), "kind")
    tail = F.array(
        scaled(n_keys(text), 16.0),
        scaled(F.col("_shape.depth"), 8.0),
        scaled(F.col("_shape.scalars"), 16.0),
        F.when(has_kind, F.lit(1.0)).otherwise(F.lit(0.0)),
    )
    whole = F.concat(
        vectors.one_hot_source(normalize_source(F.col(source))), vectors.hash_vector(F.col("_shape.canonical"), 8), tail
    )
    return shaped.withColumn("features", whole.cast("array<float>")).drop("_shape")


# --- model (K-02, L-02, L-03, L-04) -----------------------------------------------------

Weights = list[tuple[np.ndarray, np.ndarray]]


def new_weights(seed: int = 1337, dims: tuple[int, ...] = MODEL_DIMS) -> Weights:
    rng = np.random.default_rng(seed)
    layers = []
    for n_in, n_out in zip(dims[:-1], dims[1:]):
        limit = np.sqrt(6.0 / (n_in + n_out))
        layers.append((rng.uniform(-limit, limit, (n_in, n_out)), np.zeros(n_out)))
    return layers


def forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer: tanh inside, linear at the end."""
    out = [x]
    for i, (w, bias) in enumerate(weights):
        z = out[-1] @ w + bias
        out.append(z if i == len(weights) - 1 else np.tanh(z))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def default_backend(weights: Weights) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Backend protocol: rows in, (embedding, reconstruction) out."""

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        layers = forward(weights, x)
        return layers[LATENT_INDEX], layers[-1]

    return run


def score(rows: DataFrame, backend: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add ``embedding`` and ``reconstruction``; the small model travels with the tasks, rows stay put."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                yield batch.assign(embedding=[], reconstruction=[])
                continue
            latent, rebuilt = backend(_matrix(batch["features"]))
            yield batch.assign(embedding=list(latent), reconstruction=list(rebuilt))

    return rows.mapInPandas(run, f"{fields}, embedding array<double>, reconstruction array<double>")


def _epoch_sums(rows: DataFrame, weights: Weights) -> tuple[np.ndarray, float, int]:
    """Summed gradient, summed squared error and row count of one pass over all rows.

    Every task reduces its batches to one row of fixed size; Spark adds the
    rows up by position, so only the gradient itself reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, error, count = None, 0.0, 0
        for batch in batches:
            if batch.empty:
                continue
            x = _matrix(batch["features"])
            layers = forward(weights, x)
            delta = 2.0 * (layers[-1] - x) / x.shape[1]
            error += float(((layers[-1] - x) ** 2).mean(axis=1).sum())
            count += len(x)
            grads = []
            for i in range(len(weights) - 1, -1, -1):
                grads.append(np.concatenate([(layers[i].T @ delta).ravel(), delta.sum(axis=0)]))
                if i:
                    delta = (delta @ weights[i][0].T) * (1.0 - layers[i] ** 2)
            flat = np.concatenate(grads[::-1])
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"sums": [np.concatenate([total, [error, float(count)]])]})

    parts = rows.select("features").mapInPandas(run, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("i", "v"))
    summed = cells.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one row per parameter
    values = np.array([r["v"] for r in summed])
    return (values[:-2], float(values[-2]), int(values[-1])) if len(values) else (values, 0.0, 0)


def _step(weights: Weights, gradient: np.ndarray, rate: float) -> Weights:
    out, at = [], 0
    for w, bias in weights:
        dw = gradient[at : at + w.size].reshape(w.shape)
        at += w.size
        db = gradient[at : at + bias.size]
        at += bias.size
        out.append((w - rate * dw, bias - rate * db))
    return out


def train(rows: DataFrame, weights: Weights, epochs: int = 25, rate: float = 0.05) -> tuple[Weights, list[float]]:
    """Full-batch gradient descent, data parallel; losses before and after each epoch."""
    losses: list[float] = []
    for _ in range(epochs):
        gradient, error, count = _epoch_sums(rows, weights)
        if count == 0:
            return weights, [float("nan")]
        losses.append(error / count)
        weights = _step(weights, gradient / count, rate)
    _, error, count = _epoch_sums(rows, weights)
    losses.append(error / count if count else float("nan"))
    return weights, losses


def weights_rows(spark: SparkSession, weights: Weights, cadence: str, run_id: str, created_ms: int) -> DataFrame:
    """Model state as a table: one row per layer."""
    rows = [
        (cadence, run_id, created_ms, i, list(w.shape), [float(v) for v in w.ravel()], [float(v) for v in bias])
        for i, (w, bias) in enumerate(weights)
    ]
    return spark.createDataFrame(
        rows, "cadence string, run_id string, created_ms bigint, layer int, shape array<int>, weight array<double>, bias array<double>"
    )


def last_weights(stored: DataFrame, cadence: str) -> Weights | None:
    """Weights of the newest run of a cadence; None for a cold start."""
    mine = stored.where(F.col("cadence") == cadence)
    newest = mine.agg(F.max_by("run_id", F.struct("created_ms", "run_id"))).scalar()
    rows = mine.where(F.col("run_id") == newest).orderBy("layer").collect()  # one row per layer
    if not rows:
        return None
    return [(np.array(r["weight"]).reshape(r["shape"]), np.array(r["bias"])) for r in rows]


def starts_warm(cadence: str) -> bool:
    """Weekly runs go on from the last weights; monthly and on-demand runs start anew."""
    return cadence == "weekly"


# --- metrics (D-21, D-22, E-04) ---------------------------------------------------------


def mean_offdiag_cosine(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs of different rows, in linear time: ``mean_cosine``, ``n``.

    The sum over pairs is the squared length of the summed unit vectors minus
    the rows' own squares. Fewer than two rows give zero.
    """
    size = vectors.norm(F.col(vector)) + F.lit(EPSILON)
    unit = F.transform(vector, lambda v: v.cast("double") / size)
    per_dim = rows.select(F.posexplode(unit).alias("dim", "u")).groupBy("dim").agg(
        F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("own"), F.count(F.lit(1)).alias("n")
    )
    totals = per_dim.agg(
        F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("own").alias("own"), F.coalesce(F.max("n"), F.lit(0)).alias("n")
    )
    pairs = F.col("n") * (F.col("n") - 1)
    return totals.select(
        F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.col("square") - F.col("own")) / pairs).alias("mean_cosine"), "n"
    )


def temporal_coherence(rows: DataFrame, order: list[str], keys: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Mean cosine of consecutive embeddings in time order; zero when there is no pair."""
    linked = with_previous(rows.select(*(keys or []), *order, vector), keys or [], order, [vector])
    value = vectors.cosine(F.col(vector), F.col(f"prev.{vector}"))
    return linked.where("prev is not null").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("coherence"))


def reconstruction_loss(rows: DataFrame, original: str = "features", rebuilt: str = "reconstruction") -> DataFrame:
    return rows.agg(F.avg(vectors.squared_error_mean(F.col(original), F.col(rebuilt))).alias("loss"))


# --- gate (L-05, L-06, L-07) --------------------------------------------------------------


def quality_report(
    embeddings: DataFrame,
    order: list[str],
    loss: Column,
    run_id: str,
    loss_max: float = LOSS_MAX,
    diversity_max: float = DIVERSITY_MAX,
) -> DataFrame:
    """One row of metrics and checks. A loss that is not a finite number fails."""
    diversity = mean_offdiag_cosine(embeddings).withColumn("_one", F.lit(1))
    coherence = temporal_coherence(embeddings, order).withColumn("_one", F.lit(1))
    joined = diversity.join(coherence, "_one").drop("_one").withColumn("final_loss", loss)
    finite = F.col("final_loss").isNotNull() & ~F.isnan("final_loss") & (F.abs("final_loss") < float("inf"))
    checked = joined.withColumn("loss_passed", finite & (F.col("final_loss") <= loss_max)).withColumn(
        "diversity_passed", F.col("mean_cosine") <= diversity_max
    )
    return checked.select(
        F.lit(run_id).alias("run_id"),
        F.col("n").alias("n_artifacts"),
        "final_loss",
        F.lit(loss_max).alias("loss_threshold"),
        "loss_passed",
        round_stable(F.col("mean_cosine"), 6).alias("diversity"),
        F.lit(diversity_max).alias("diversity_threshold"),
        "diversity_passed",
        round_stable(F.col("coherence"), 6).alias("coherence"),
        F.when(F.col("loss_passed") & F.col("diversity_passed"), F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"),
    )


def embedding_rows(embeddings: DataFrame, order: list[str], run_id: str) -> DataFrame:
    """One row per vector with its ``window-NNN`` label in time order."""
    numbered = with_position(embeddings, order, "ordinal")
    return numbered.withColumn("label", ids.window_label(F.col("ordinal"))).withColumn("run_id", F.lit(run_id))


def run_lineage(parents: DataFrame, parent: str, child_id: str, module: str) -> DataFrame:
    """Edges from every parent row to one artifact of a run."""
    return parents.select(
        F.lit(child_id).alias("child_id"), F.col(parent).cast("string").alias("parent_id"),
        F.lit("derived").alias("edge_type"), F.lit(module).alias("module"),
    )


def gated_commit(
    report: DataFrame,
    embeddings: DataFrame,
    order: list[str],
    run_id: str,
    write: Callable[[str, DataFrame], None],
    upstream: str = "artifact_id",
    dry_run: bool = False,
    cadence: str = "on_demand",
    weights: DataFrame | None = None,
    now_ms: int = 0,
) -> str:
    """Write what a run leaves behind; returns the verdict, ``dry-run`` or ``skip``.

    The report and its lineage are always written, as is the module run. On a
    pass the embedding comes too, with the report among its parents, and the
    weights for the next warm start; on a fail the earlier embedding stays.
    """
    spark = report.sparkSession
    row = report.first()
    if row is None or row["n_artifacts"] == 0:
        return "skip"
    if dry_run:
        return "dry-run"
    module, report_id, embedding_id = f"representation_{cadence}", f"{run_id}.report", f"{run_id}.embedding"
    passed = row["verdict"] == "pass"
    write("report", spark.createDataFrame([(report_id, *row)], f"artifact_id string, {_fields(report)}"))
    lineage = run_lineage(embeddings, upstream, report_id, module)
    if passed:
        write("embedding", embedding_rows(embeddings, order, run_id).withColumn("embedding_id", F.lit(embedding_id)))
        own = spark.createDataFrame([(report_id,)], "parent_id string")
        lineage = lineage.unionByName(run_lineage(own, "parent_id", embedding_id, module))
        lineage = lineage.unionByName(run_lineage(embeddings, upstream, embedding_id, module))
    write("lineage", lineage)
    made = [embedding_id, report_id] if passed else [report_id]
    write("module_run", spark.createDataFrame([(module, run_id, now_ms, made)], "module string, run_id string, completed_ms bigint, artifact_ids array<string>"))
    if passed and weights is not None:
        write("weights", weights)
    return row["verdict"]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
