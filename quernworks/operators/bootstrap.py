"""Paired bootstrap of a mean difference, exact for small groups or spread over the cluster."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "n bigint, mean_a double, mean_b double, delta double, ci_low double, ci_high double, p_value_one_sided double"


def paired_bootstrap(a: np.ndarray, b: np.ndarray, n_iter: int, seed: int) -> dict[str, float]:
    """The mean of b - a with a 95 % interval and the share of resamples in which it is not positive.

    Resamples draw rows with replacement, the same for both sides; no rows give NaN.
    """
    if len(a) != len(b):
        raise ValueError(f"{len(a)} and {len(b)} values are no pairs")
    if not len(a):
        return {"n": 0} | dict.fromkeys(("mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value_one_sided"), float("nan"))
    rng, gap = np.random.default_rng(seed), b - a
    means = np.array([gap[rng.integers(0, len(gap), len(gap))].mean() for _ in range(n_iter)])
    low, high = np.percentile(means, [2.5, 97.5])
    return {"n": len(a), "mean_a": a.mean(), "mean_b": b.mean(), "delta": b.mean() - a.mean(), "ci_low": low, "ci_high": high, "p_value_one_sided": (means <= 0).mean()}


def grouped_bootstrap(pairs: DataFrame, a: str, b: str, key: str, group: str, n_iter: int = 1000, seed: int = 0) -> DataFrame:
    """One result per group, and for all rows as '(all)'. Each group's rows are taken in the order of ``key``.

    A group is drawn from in one task: for groups that fit in memory (16 bytes a row). The seed of a
    group is ``seed`` and a checksum of its name, so results agree between runs.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        name = frame["_group"].iloc[0]
        found = paired_bootstrap(frame[a].to_numpy(float), frame[b].to_numpy(float), n_iter, seed + zlib.crc32(str(name).encode()))
        return pd.DataFrame([{"group": name} | found])

    rows = pairs.select(key, a, b, F.explode(F.array(F.lit("(all)"), F.col(group).cast("string"))).alias("_group"))
    return rows.groupBy("_group").applyInPandas(run, f"group string, {_OUT}")


def poisson_bootstrap(pairs: DataFrame, a: str, b: str, key: str, group: str, n_iter: int = 200, seed: int = 0) -> DataFrame:
    """The same for groups of any size: each row has a hash-drawn Poisson(1) weight in each resample.

    Only sums by (group, resample) are shuffled, combined on the map side. Weights of a resample come
    from md5 of seed, resample and key, by inversion of the distribution up to 7.
    """
    cuts, p, total = [], np.exp(-1.0), 0.0
    for k in range(7):
        total += p
        cuts.append(total)
        p /= k + 1
    rows = pairs.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"), F.explode(F.array(F.lit("(all)"), F.col(group).cast("string"))).alias("group"))
    draws = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_i").cast("string"), F.col(key).cast("string"))), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / float(1 << 32)
    weight = F.lit(0)
    for cut in cuts:
        weight = weight + F.when(u >= cut, 1).otherwise(0)
    sums = draws.withColumn("_w", weight).groupBy("group", "_i").agg(F.try_divide(F.sum(F.col("_w") * (F.col("_b") - F.col("_a"))), F.sum("_w")).alias("gap"))
    spread = sums.groupBy("group").agg(F.percentile("gap", F.lit(0.025)).alias("ci_low"), F.percentile("gap", F.lit(0.975)).alias("ci_high"), F.avg(F.when(F.col("gap") <= 0, 1.0).otherwise(0.0)).alias("p_value_one_sided"))
    means = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"), (F.avg("_b") - F.avg("_a")).alias("delta"))
    return means.join(spread, "group")
