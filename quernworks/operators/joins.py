"""Equi-joins of artifact tables. Sides are left to the planner, which broadcasts what is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their match; rows without one go. The side must be unique by key."""
    return rows.join(side, key, "inner")


def matched(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return rows.join(side.select(key), key, "left_semi")


def unmatched(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return rows.join(side.select(key), key, "left_anti")


def join_all(rows: DataFrame, sides: list[DataFrame], key: str) -> DataFrame:
    """Rows that every side has, with all columns."""
    for side in sides:
        rows = rows.join(side, key, "inner")
    return rows


def pair_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str], labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two runs side by side: key, and each column once a run, with the run's label after it."""
    named = lambda df, label: df.select(key, *[F.col(c).alias(f"{c}_{label}") for c in columns])
    return named(a, labels[0]).join(named(b, labels[1]), key, "inner")


def join_counts(rows: DataFrame, sides: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: how many rows there are, how many each side lacks, and how many all sides have."""
    marked = rows.select(key)
    for name, side in sides.items():
        marked = marked.join(side.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    has = [F.col(f"_{n}").isNotNull() for n in sides]
    every = has[0]
    for h in has[1:]:
        every = every & h
    lacking = [F.count_if(~h).alias(f"n_without_{n}") for n, h in zip(sides, has, strict=True)]
    return marked.agg(F.count(F.lit(1)).alias("n"), *lacking, F.count_if(every).alias("n_joined"))
