"""Weights of difficulty components that agree best with manual labels, by Spearman's rank correlation."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import rank_of
from .scores import WEIGHTS_V1

#: Labels under which a fit is not to be trusted.
FEW = 50


def average_ranks(x: np.ndarray) -> np.ndarray:
    values, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Spearman's; values that differ by less than sums of fractions are exact to are ties."""
    a, b = average_ranks(np.round(x, 9)), average_ranks(y)
    if a.std() == 0 or b.std() == 0:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def _simplex(parts: int, total: int):
    if parts == 1:
        yield (total,)
        return
    for i in range(total + 1):
        for rest in _simplex(parts - 1, total - i):
            yield (i, *rest)


def fit_weights(components: np.ndarray, ranks: np.ndarray, start: np.ndarray, steps: int = 10, rounds: int = 3) -> tuple[np.ndarray, float]:
    """The best weights on a grid of the simplex, refined around the best; ties stay nearest the start."""
    best, rho = start, rank_correlation(components @ start, ranks)
    grid = [np.array(w) / steps for w in _simplex(components.shape[1], steps)]
    centre, width = np.zeros(components.shape[1]), 1.0
    for _ in range(rounds):
        for w in sorted((centre * (1 - width) + g * width for g in grid), key=lambda w: float(np.abs(w - start).sum())):
            r = rank_correlation(components @ w, ranks)
            if r > rho + 1e-12:
                best, rho = w, r
        centre, width = best, width / steps * 2
    return best, rho


def calibrate(difficulty: DataFrame, labels: dict[str, str] | DataFrame, weights: dict[str, float] = WEIGHTS_V1, rounds: int = 3, most_labels: int = 100_000) -> dict:
    """Joins labels (triplet_id, label: easy, medium or hard) and fits weights to them on the driver.

    Labels are given by hand, so they are few; of more than ``most_labels`` labelled rows, those of the
    least md5 of their ids are used.
    """
    spark, names = difficulty.sparkSession, list(weights)
    given = spark.createDataFrame(sorted(labels.items()), "triplet_id string, label string") if isinstance(labels, dict) else labels.select("triplet_id", "label")
    odd = given.filter(~F.coalesce(F.col("label").isin("easy", "medium", "hard"), F.lit(False))).select("label").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"labels must be easy, medium or hard, not {[r.label for r in odd]}")
    rows = difficulty.select("triplet_id", *names).join(given.withColumnRenamed("label", "__label"), "triplet_id")
    rows = rows.select(*names, rank_of(F.col("__label")).alias("__rank"), F.md5(F.col("triplet_id").cast("string")).alias("__at"))
    rows = rows.orderBy("__at").limit(most_labels).toPandas()
    if len(rows) < FEW:
        warnings.warn(f"only {len(rows)} labelled rows", stacklevel=2)
    x, y, start = rows[names].to_numpy(float), rows["__rank"].to_numpy(float), np.array(list(weights.values()))
    if not len(rows):
        return {"n": 0, "weights": dict(weights), "rho": None, "baseline_rho": None}
    best, rho = fit_weights(x, y, start / start.sum(), rounds=rounds)
    return {"n": len(rows), "weights": dict(zip(names, best.tolist(), strict=True)), "rho": rho, "baseline_rho": rank_correlation(x @ start, y)}
