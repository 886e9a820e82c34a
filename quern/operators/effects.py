"""The effect of a treatment on an outcome, by doubly robust scores over sums that Spark makes.

The chance of treatment is logistic in the covariates (Newton steps on summed gradients and Hessians), each arm's outcome is
linear (normal equations). Rows whose chance is outside the overlap bounds are trimmed and counted. The effect is the mean
of the rows' scores; its variance is that of their influence function. Only sums of the size of the covariates reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(weights: np.ndarray, columns: list[Column]) -> Column:
    return sum((F.lit(float(w)) * c for w, c in zip(weights[1:], columns, strict=True)), F.lit(float(weights[0])))


def _moments(rows: DataFrame, weight: Column, residual: Column, x: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weight times x x', sums of residual times x), x with a leading one."""
    z = [F.lit(1.0), *x]
    pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    found = rows.agg(*[F.sum(weight * z[i] * z[j]) for i, j in pairs], *[F.sum(residual * c) for c in z]).first()
    a = np.zeros((len(z), len(z)))
    for (i, j), v in zip(pairs, found, strict=False):
        a[i, j] = a[j, i] = v or 0.0
    return a, np.array([v or 0.0 for v in found[len(pairs) :]])


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a + 1e-9 * np.eye(len(a)) * max(1.0, np.trace(a)), b)


def effect(df: DataFrame, outcome: str, treatment: str, covariates: list[str], low: float = 0.05, high: float = 0.95, steps: int = 8) -> DataFrame:
    """One row: effect, error, low and high of the 95 % interval, naive (the difference of the arms' means), n and trimmed.

    Rows with a null in any column are left out; treatment is 0 or 1. Covariates are standardised first. Without rows in
    both arms all figures are null but the counts.
    """
    spark = df.sparkSession
    names = [outcome, treatment, *covariates]
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]).dropna()
    y, t = F.col("_0"), F.col("_1")
    raw = [F.col(f"_{i + 2}") for i in range(len(covariates))]
    first = rows.agg(F.count("*"), F.sum("_1"), F.avg(F.when(t == 1, y)), F.avg(F.when(t == 0, y)), *[f(c) for c in raw for f in (F.avg, F.stddev_pop)]).first()
    n, treated = first[0], first[1] or 0
    schema = "effect double, error double, low double, high double, naive double, n long, trimmed long"
    if not 0 < treated < n:
        return spark.createDataFrame([(None, None, None, None, None, n, 0)], schema)
    x = [(c - F.lit(first[4 + 2 * i])) / F.lit((first[5 + 2 * i] or 0.0) + 1e-9) for i, c in enumerate(raw)]
    w = np.zeros(len(x) + 1)
    w[0] = math.log(treated / (n - treated))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_dot(w, x)))
        a, b = _moments(rows, p * (1 - p), t - p, x)
        step = _solved(a, b)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    chance = 1 / (1 + F.exp(-_dot(w, x)))
    kept = rows.where(chance.between(low, high))
    arms = []
    for arm in (1, 0):
        a, b = _moments(kept.where(t == arm), F.lit(1.0), y, x)
        arms.append(_dot(_solved(a, b), x))
    score = arms[0] - arms[1] + t / chance * (y - arms[0]) - (1 - t) / (1 - chance) * (y - arms[1])
    mean, variance, left = kept.agg(F.avg(score), F.var_samp(score), F.count("*")).first()
    error = math.sqrt(variance / left) if left and variance is not None else None
    bounds = (mean - 1.96 * error, mean + 1.96 * error) if error is not None else (None, None)
    return spark.createDataFrame([(mean, error, *bounds, first[2] - first[3], n, n - left)], schema)
