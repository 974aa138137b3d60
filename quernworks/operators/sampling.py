"""Reproducible samples and orders: a row's place is by a hash of the seed and its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(df: DataFrame, strata: list[str], k: int, key: str, seed: int = 0) -> DataFrame:
    """At most k rows of each stratum; rows with a null stratum are left out.

    Ranks are taken in two steps, first within 16 shares of a stratum, so none is sorted in one place
    before it is down to 16 k rows.
    """
    rows = df
    for s in strata:
        rows = rows.filter(F.col(s).isNotNull())
    rows = rows.withColumn("_at", shuffle_key(seed, key)).withColumn("_share", F.substring("_at", 1, 1))
    for by in ([*strata, "_share"], strata):
        window = Window.partitionBy(*by).orderBy("_at", key)
        rows = rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k)
    return rows.select(df.columns)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in an order fixed by the seed."""
    return df.withColumn("_at", shuffle_key(seed, key)).orderBy("_at", key).drop("_at")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of the seed's order; all for -1."""
    return df if n < 0 else df.withColumn("_at", shuffle_key(seed, key)).orderBy("_at", key).limit(n).drop("_at")


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def most_common(df: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """Labels with counts, most frequent first, equal ones by label."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))
    return counted if n is None else counted.limit(n)
