"""Labelled rows for training, up to a documented number, and numpy fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import ID, crc_of_id, id_and_text


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """Texts with ``y`` from labelled rows outside the held-out fold.

    At most ``rows`` of each label, those of least hash of the id, so the sample
    is the same in every run. A document with several labels counts as 1 if any is.
    ``weight`` is how many labelled documents a row stands for: all of its label over
    those taken, so that weighted sums have the true shares of the labels.
    """
    known = (labels.select(F.col(ID).cast("long").alias(ID), F.col(label).cast("int").alias("y"))
             .dropna().filter(crc_of_id() % folds != held)
             .groupBy(ID).agg(F.max("y").alias("y")).withColumn("h", F.xxhash64(F.lit(label), ID)))
    some = [known.filter(F.col("y") == y).orderBy("h", ID).limit(rows) for y in (0, 1)]
    of_label = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [s.withColumn("weight", F.lit(max(of_label.get(y, 0) / rows, 1.0))) for y, s in enumerate(some)]
    chosen = some[0].unionByName(some[1])  # at most 2 x rows ids
    return id_and_text(docs).join(F.broadcast(chosen), ID).withColumn(
        "part", F.pmod("h", F.lit(4)).cast("int")).drop("h")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def even(weight: np.ndarray) -> np.ndarray:
    """Weights of mean 1."""
    return weight / weight.mean()


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The divisor of least cross-entropy, by golden-section on its logarithm."""
    weight = np.ones(len(y)) if weight is None else even(weight)

    def loss(log_t: float) -> float:
        p = np.clip(sigmoid(logits / np.exp(log_t)), 1e-9, 1 - 1e-9)
        return -float(np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))))

    lo, hi, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3,
             weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with bias last, by Newton steps."""
    weight = np.ones(len(y)) if weight is None else even(weight)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * len(x) * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w
