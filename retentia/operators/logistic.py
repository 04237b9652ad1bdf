"""Logistic regression by Newton steps: few passes over the rows, small systems on the driver.

A pass gives the loss, its gradient and the weighted Gram matrix at given weights: each task
sums its batches with numpy and hands on one row per entry, which Spark adds up. What comes to the
driver is a square of the number of features, never of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    """Weights per column, the free intercept, and the curvature (columns, then intercept) they were found with."""

    weights: np.ndarray
    intercept: float
    curvature: np.ndarray
    passes: int

    def without(self, place: int) -> np.ndarray:
        """Where to start without one column: the best weights of the quadratic that the curvature describes."""
        all_weights = np.append(self.weights, self.intercept)
        rest = np.delete(np.arange(len(all_weights)), place)
        block, cross = self.curvature[np.ix_(rest, rest)], self.curvature[rest, place]
        return all_weights[rest] + np.linalg.solve(block, cross * all_weights[place])


def _sums(cols: Sequence[str], label: str, weights: np.ndarray) -> Callable:
    """Per task the entries of loss, row count, gradient and upper Gram matrix, numbered in that order."""
    upper = np.triu_indices(len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(weights) + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (*cols, label)]
            y = columns.pop()
            x = np.column_stack([*columns, np.ones(len(y))])
            margin = x @ weights
            # log(1 + e^m) - y m, without overflow at either end.
            loss = np.maximum(margin, 0) + np.log1p(np.exp(-np.abs(margin))) - y * margin
            p = 0.5 * (1 + np.tanh(margin / 2))
            gram = (x * (p * (1 - p))[:, None]).T @ x
            total += np.concatenate([[loss.sum(), len(y)], (p - y) @ x, gram[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    return run


def _pass(table: DataFrame, cols: Sequence[str], label: str, weights: np.ndarray, penalty: float):
    """Penalised loss, gradient and curvature at ``weights`` (the intercept last), and the number of rows."""
    size = len(weights)
    parts = table.select(*cols, label).mapInArrow(_sums(cols, label, weights), "place int, value double")
    sums = np.zeros(2 + size + size * (size + 1) // 2)
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[row["place"]] = row["value"]
    if not np.isfinite(sums).all():
        raise ValueError("a logistic fit needs columns and labels without null, NaN or infinity")
    curvature = np.zeros((size, size))
    curvature[np.triu_indices(size)] = sums[2 + size :]
    curvature += np.triu(curvature, 1).T
    ridge = np.append(np.full(size - 1, penalty), 0.0)
    loss = sums[0] + 0.5 * (ridge * weights**2).sum()
    return loss, sums[2 : 2 + size] + ridge * weights, curvature + np.diag(ridge), int(sums[1])


def fit_logistic(
    table: DataFrame,
    cols: Sequence[str],
    label: str,
    penalty: float = 1.0,
    start: np.ndarray | None = None,
    tol: float = 1e-4,
    rounds: int = 100,
) -> LogisticFit:
    """Minimises the summed log loss plus half ``penalty`` (1 / C) times the squared weights; the intercept is free.

    ``table`` is read once per step, so it should be a written one. The penalty makes the
    optimum unique and finite, also where a column separates the classes; steps that would not lower the
    loss are halved. The error of a last step below ``tol`` is of the order of its square, so it is
    taken without another pass. Labels of one class only are an error.
    """
    cols = list(cols)
    weights = np.zeros(len(cols) + 1) if start is None else np.asarray(start, dtype=float)
    loss, slope, curvature, rows = _pass(table, cols, label, weights, penalty)
    if start is None and abs(slope[-1]) >= rows / 2:
        raise ValueError("a logistic fit needs rows of both classes")
    passes = 1
    for _ in range(rounds):
        step = np.linalg.solve(curvature, slope)
        if np.abs(step).max() <= tol * max(1.0, np.abs(weights).max()):
            weights = weights - step
            return LogisticFit(weights[:-1], float(weights[-1]), curvature, passes)
        size = 1.0
        while True:
            now = _pass(table, cols, label, weights - size * step, penalty)[:3]
            passes += 1
            if now[0] <= loss - 1e-4 * size * (slope @ step) or size < 1e-6:
                break
            size /= 2
        weights, (loss, slope, curvature) = weights - size * step, now
    raise RuntimeError(f"the logistic fit did not converge in {rounds} steps")
