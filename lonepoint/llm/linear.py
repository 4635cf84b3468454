"""Logistic regression on sparse rows, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, chosen by a hash of the id.

    The chosen ids are broadcast: ``rows`` bounds their size.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Rows:
    """Sparse rows: ``column`` and ``value`` of each entry, and the row it belongs to."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None = None):
        sizes = [len(c) for c in columns]
        self.count = len(columns)
        self.row = np.repeat(np.arange(self.count), sizes)
        self.column = np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate(values).astype(float) if values else np.ones(len(self.column))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.count)

    def back(self, gradient: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * gradient[self.row], width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def prior(label: np.ndarray) -> float:
    """Log-odds of the label, smoothed; without rows a quarter."""
    share = (label.sum() + 0.5) / (len(label) + 2)
    return float(np.log(share / (1 - share)))


def fit(
    rows: Rows,
    label: np.ndarray,
    width: int,
    l2: float,
    steps: int = 300,
    pairs: tuple[Rows, Rows] | None = None,
    penalty: float = 0.0,
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss plus ``l2`` times the squared weights.

    ``pairs`` holds rows that should score alike; ``penalty`` weighs the mean square of the differences of
    their log-odds.  Full-batch steps with adaptive rates: the same rows give the same model.
    """
    weights, bias = np.zeros(width), prior(label)
    if rows.count == 0 or width == 0:
        return weights, bias
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        error = (sigmoid(rows.times(weights) + bias) - label) / rows.count
        slope = rows.back(error, width) + 2 * l2 * weights
        if pairs and pairs[0].count:
            gap = 2 * penalty / pairs[0].count * (pairs[0].times(weights) - pairs[1].times(weights))
            slope += pairs[0].back(gap, width) - pairs[1].back(gap, width)
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        rate = 0.1 * (1 - step / (steps + 1)) + 0.005
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)
