"""Quality classifier: naive Bayes support vectors over n-gram indicators.

An n-gram's indicator is scaled by the log ratio of its smoothed counts in the
two classes; a linear hinge-loss model over these is fitted by dual coordinate
descent. The margin becomes a probability by a logistic fit on rows that the
descent has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import hash_share, small_side

BITS = 18
SAMPLE_ROWS = 8000
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
THRESHOLD = 0.7
BLOCK_CHARS = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Code points by kind: letters and digits by one symbol each, white space by two, the rest as it is."""
    global _kinds
    if _kinds is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isupper():
                table[i] = 65
            elif c.isalpha():
                table[i] = 97
            elif c.isdigit():
                table[i] = 48
            elif c.isspace():
                table[i] = 10 if c == "\n" else 32
        _kinds = table
    return _kinds


def _runs(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    if len(codes) < n:
        return np.zeros(0, np.int64)
    rolled = codes[: len(codes) - n + 1].astype(np.uint64) + np.uint64(salt)
    for i in range(1, n):
        rolled = rolled * _GOLD + codes[i : len(codes) - n + 1 + i]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return (rolled >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """Distinct n-gram buckets of a text; the scratch array is reused from text to text."""

    def __init__(self) -> None:
        self.mark = np.zeros(1 << BITS, bool)

    def of(self, text: str | None) -> np.ndarray:
        mark, kinds = self.mark, _kind_table()
        mark[0] = True  # the constant feature
        for at in range(0, len(text or ""), BLOCK_CHARS):
            block = text[at : at + BLOCK_CHARS]
            codes = np.frombuffer(block.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
            mark[_runs(codes, 4, 1)] = True  # character 4-grams
            shapes = kinds[codes.astype(np.int64)].astype(np.uint64)
            mark[_runs(shapes, 5, 2)] = True  # 5-grams of character kinds
            gaps = np.flatnonzero((shapes == 32) | (shapes == 10))
            starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(codes)]))
            long = ends > starts
            starts, ends = starts[long], ends[long]
            if len(starts) > 1:
                # a word is told by its ends and length: enough to see it said again
                tail = codes[ends - 1] + codes[starts] * _GOLD + (ends - starts).astype(np.uint64) * np.uint64(977)
                tail += codes[(starts + ends) // 2] * np.uint64(0xD6E8FEB86659FD93)
                again = (tail[1:] == tail[:-1]).astype(np.uint64)
                mark[_runs(again, 1, 3)] = True  # runs of words said again
                mark[_runs(again, 3, 4)] = True
                mark[_runs(again, 6, 5)] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        return found


@dataclass
class QualityModel:
    """Margin of a text: sum of ``weight`` over its features, over the length of their ``ratio`` vector."""

    weight: np.ndarray
    ratio: np.ndarray
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        size = float(np.sqrt(np.square(self.ratio[found]).sum())) or 1.0
        margin = float(self.weight[found].sum()) / size
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    counts = {1: np.full(1 << BITS, smoothing), 0: np.full(1 << BITS, smoothing)}
    for row, label in zip(rows, labels):
        counts[int(label > 0)][row] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum of cost times hinge loss, one dual variable at a time.

    A coordinate moves to the minimum of its own quadratic, clipped to [0, cost].
    """
    w, dual = np.zeros(1 << BITS), np.zeros(len(rows))
    squares = np.array([float(v @ v) for v in values])
    random = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            if not squares[i]:
                continue
            slack = y[i] * float(values[i] @ w[rows[i]]) - 1.0
            new = min(max(dual[i] - slack / squares[i], 0.0), cost[i])
            if new != dual[i]:
                w[rows[i]] += (new - dual[i]) * y[i] * values[i]
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return w


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by a few damped Newton steps; targets are smoothed by the class sizes."""
    good, bad = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        gradient = x @ (p - target) + 1e-6 * np.array([a, b])
        curve = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Fit on four fifths of the rows, calibrate on the rest; one class alone gives a constant score."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        shift = 0.0 if not len(y) else 3.0 * y[0]
        return QualityModel(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, float(shift))
    order = np.random.default_rng(11).permutation(len(rows))
    rows, y = [rows[i] for i in order], y[order]
    check = np.arange(len(rows)) % 5 == 0
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.zeros(len(rows), bool)
    used = [i for i in range(len(rows)) if not check[i]]
    ratio = log_count_ratio([rows[i] for i in used], y[used])
    values = []
    for row in rows:
        v = ratio[row]
        values.append(v / (float(np.sqrt(v @ v)) or 1.0))
    share = (y[used] > 0).mean()
    cost = COST * np.where(y[used] > 0, 0.5 / share, 0.5 / (1 - share))
    w = dual_descent([rows[i] for i in used], [values[i] for i in used], y[used], cost)
    judged = np.flatnonzero(check) if check.any() else np.arange(len(rows))
    margins = np.array([float(values[i] @ w[rows[i]]) for i in judged])
    return QualityModel((w * ratio).astype(np.float64), ratio, *_logistic(margins, y[judged]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Fit on about ``sample_rows`` labelled documents picked by a hash of the key, in one task.

    Rows without a label or key and keys with both labels teach nothing. The
    sample is drawn from the labels, so that only its keys are sent to the
    documents; the bound holds the one task's memory. Features are made where
    the texts lie.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"), F.min(label).cast("int").alias("y2"))
    known = known.where("y = y2").select("k", "y")
    total = known.count()
    picked = known.where(hash_share(F.col("k")) < F.lit(min(1.0, sample_rows / max(total, 1))))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = rows.join(small_side(picked, min(total, 2 * sample_rows)), "k")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Features()
        for batch in batches:
            yield pd.DataFrame(
                {
                    "k": batch["k"].astype("Int64").astype(str),
                    "y": batch["y"],
                    "f": [maker.of(t).astype(np.uint32).tobytes() for t in batch["t"]],
                }
            )

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, labels, keys = [], [], []
        for batch in batches:
            rows += [np.frombuffer(f, np.uint32).astype(np.int32) for f in batch["f"]]
            labels += list(batch["y"])
            keys += list(batch["k"])
        order = sorted(range(len(rows)), key=lambda i: (keys[i], labels[i]))  # the order of arrival must not matter
        model = fit_rows([rows[i] for i in order], np.array(labels, float)[order])
        yield pd.DataFrame(
            {
                "w": [model.weight.astype("<f8").tobytes()],
                "r": [model.ratio.astype("<f8").tobytes()],
                "a": [model.slope],
                "b": [model.shift],
            }
        )

    found = sample.mapInPandas(featured, "k string, y int, f binary")
    # only the bounded sample moves; the texts are read and cut into features where they lie
    got = found.repartition(1).mapInPandas(fitted, "w binary, r binary, a double, b double").first()
    if got is None:
        return fit_rows([], np.zeros(0))
    return QualityModel(np.frombuffer(got["w"], "<f8"), np.frombuffer(got["r"], "<f8"), got["a"], got["b"])


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row from its whole text alone; null counts as empty.

    Equal texts score equally; rows with equal or null keys are judged each. An
    empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of fixed length
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Features()
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "score": [shared.value.score(maker.of(t)) for t in batch["t"]]})

    scored = rows.mapInPandas(work, f"k {kind}, score double").withColumnRenamed("k", key)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
