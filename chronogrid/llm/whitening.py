"""Embedding whitening by shifted CholeskyQR.

The centred rows A of all vectors are never held in one place. A pass adds up
the Gram matrix of what the rows are after the triangular solves so far. Its
Cholesky factor gives the next solve: the first one with a shift, which makes
it safe for any condition number, the two that follow without. Then
A = Q R with R the product of the factors, and the singular value decomposition
of the small R gives the components and variances of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MAX_ENTRY = float(1 << 54)  # beyond it SCALE times the entry is no long
INDEPENDENT = 1e-15
BLOCK_ROWS = 4096


class Whitening(NamedTuple):
    """What a row needs to be whitened; the largest members are of dimensions by components."""

    n: int
    sums: list[int]
    whole: np.ndarray  # floor of the mean
    rest: np.ndarray  # mean less its floor
    axes: np.ndarray  # dimensions x components, each column already over the root of its variance
    explained: np.ndarray
    identity_error: float


def whole_numbers(vectors: DataFrame, vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Array of longs floor(scale * c) + offset; null where the vector is null or an entry is null or not finite."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(MAX_ENTRY)))
    return F.when(usable, F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint") + F.lit(offset)))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of rows by d."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _matrix_sums(rows: DataFrame, d: int, size: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``made(block)``, a matrix with ``size`` columns.

    A task sends one matrix, whatever its number of rows; the entries are added
    up by Spark and only the sum comes to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "x", d):
            part = made(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(work, "i int, row array<double>")
    entries = parts.select("i", F.posexplode("row").alias("j", "value"))
    found = entries.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, size))
    for r in found:
        out[r["i"], r["j"]] = r["value"]
    return out


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension as whole numbers of any size: upper and lower halves apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for _, x in _blocks(batches, "x", d):
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d), "high": pa.array(high), "low": pa.array(low)})

    parts = rows.select("x").mapInArrow(work, "i int, n bigint, high bigint, low bigint")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = {r["i"]: r for r in parts.groupBy("i").agg(*total).collect()}
    if not found:
        return 0, [0] * d
    return int(found[0]["n"]), [(int(found[i]["high"]) << 32) + int(found[i]["low"]) for i in range(d)]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, by forward substitution over all rows at once."""
    out = np.empty((len(factor), len(rows)))
    for j in range(len(factor)):
        out[j] = (rows[:, j] - factor[:j, j] @ out[:j]) / factor[j, j]
    return out.T


def independent_columns(gram: np.ndarray, least: float = INDEPENDENT) -> list[int]:
    """Columns that span all others: Cholesky with pivots, until what is left is under ``least`` of the largest."""
    rest, chosen = gram.copy(), []
    limit = least * max(float(np.max(np.diag(gram), initial=0.0)), 0.0)
    for _ in range(len(gram)):
        at = int(np.argmax(np.diag(rest)))
        if rest[at, at] <= limit:
            break
        chosen.append(at)
        column = rest[:, at] / np.sqrt(rest[at, at])
        rest = rest - np.outer(column, column)
        rest[at, :] = rest[:, at] = 0.0
    return sorted(chosen)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors among ``rows`` (column ``x`` of ``d`` longs each).

    Fewer components come out where the vectors span fewer dimensions.
    """
    distinct = stored(rows.select("x").distinct(), "vectors")
    n, sums = _exact_sums(distinct, d)
    if not n:
        return Whitening(0, sums, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, 0)), np.zeros(0), 0.0)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest

    def gram_of(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def made(x: np.ndarray) -> np.ndarray:
            a = centred(x)
            for step in steps:
                a = step(a)
            return a.T @ a

        return made

    gram = _matrix_sums(distinct, d, d, gram_of())
    trace = float(np.trace(gram))
    if trace <= 0:
        return Whitening(n, sums, whole, rest, np.zeros((d, 0)), np.zeros(0), 0.0)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * trace
    first = np.linalg.cholesky(gram + shift * np.eye(d)).T
    second_gram = _matrix_sums(distinct, d, d, gram_of(lambda a: solved(a, first)))
    used = independent_columns(second_gram)
    second = np.linalg.cholesky(second_gram[np.ix_(used, used)]).T
    third_gram = _matrix_sums(distinct, d, len(used), gram_of(lambda a: solved(solved(a, first)[:, used], second)))
    third = np.linalg.cholesky(third_gram).T
    # columns left out are combinations of those used: their part of the second factor follows from its Gram matrix
    factor = third @ np.linalg.solve(second.T, second_gram[used, :]) @ first
    _, spread, turned = np.linalg.svd(factor, full_matrices=False)
    variances = spread**2 / n
    kept = min(components, len(used))
    axes = turned[:kept].T / np.sqrt(variances[:kept])

    def seen(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ axes
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _matrix_sums(distinct, d, kept, seen) / n
    error = np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(kept)).max()
    return Whitening(n, sums, whole, rest, axes, variances[:kept] / (trace / n), float(error))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None where it does not fit a long."""
    off, left = x - model.whole, np.array([s % model.n for s in model.sums], np.int64)
    largest = model.n * (np.abs(off).max(initial=0) + 1.0)
    if largest**2 * x.shape[1] < 2.0**62:
        return ((off * model.n - left) ** 2).sum(axis=1).tolist()
    lefts = left.tolist()
    exact = (sum((o * model.n - s) ** 2 for o, s in zip(row, lefts)) for row in off.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Dropped are rows whose vector is null or empty, holds a null or an entry
    that is not finite (or 2^54 and more, which has no long), or has another
    length than most vectors have (of lengths equally frequent the longer one
    counts). Repeated rows and keys, null ones too, each get their components;
    the fit counts a vector once. Where the vectors span fewer dimensions than
    ``components``, there are as many components; equal vectors have none, so
    they and an empty table give an empty result. ``deviation`` is null where
    it does not fit a long. Other columns are not read.
    """
    rows = vectors.select(F.col(key).alias("k"), whole_numbers(vectors, vector).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 1
    rows = rows.where(F.size("x") == d)
    model = fit(rows, d, components)
    kind = dict(rows.dtypes)["k"]
    kept = model.axes.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x", d):
            if not kept:
                continue
            white = ((x - model.whole).astype(np.float64) - model.rest) @ model.axes
            each = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_pydict(
                {
                    "k": part.column("k").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(each), model.n, np.int64)),
                    "deviation": pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(model.explained, len(x))),
                    "identity_error": pa.array(np.full(len(each), model.identity_error)),
                }
            )

    schema = f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(work, schema).withColumnRenamed("k", key)
