"""Deduplication by key under an explicit order, and policies for keys that collide.

All keep one row, or none, per key with aggregations that combine on the map side; only the collision
policies that need each row's own count go through a join with the (small) table of colliding keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a row stood: files in name order, then rows.
POSITION = ("_file", "_row")


def with_position(df: DataFrame) -> DataFrame:
    """Adds the position of each row of a Parquet scan, for the order of shards, then rows."""
    return df.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that stands last in ``order``; nulls in the order come first, null keys are a key."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that stands first in ``order``."""
    return _keep(df, keys, order, F.min_by)


def first_of_rest(df: DataFrame, done: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key that ``done``, what earlier runs have finished, does not hold yet."""
    return keep_first(df.join(done.select(key), key, "left_anti").select(df.columns), [key], order)


def colliding(df: DataFrame, key: Column) -> DataFrame:
    """(_key, n) of keys with two rows or more; null keys never collide."""
    return df.select(key.alias("_key")).filter("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def drop_all(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has; rows with a null key stay."""
    return df.join(colliding(df, F.col(key)).select(F.col("_key").alias(key)), key, "left_anti").select(df.columns)


def collision_report(df: DataFrame, key: str, line: str, examples: int = 5) -> DataFrame:
    """One row: n_collisions, n_records, and the first keys with their lines."""
    found = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line")).filter("n > 1")
    top = F.slice(F.array_sort(F.collect_list(F.struct("first_line", key, "n"))), 1, examples)
    sums = found.agg(F.count(F.lit(1)).alias("n_collisions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))
    return sums.join(F.broadcast(found.orderBy("first_line").limit(examples).agg(top.alias("examples"))))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, once it is checked that no key has two rows; an error names one that has."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise RuntimeError(f"not unique: {twice[0].asDict()}")
    return df


def resolve_collisions(df: DataFrame, key: str, order: list[str], policy: str = "drop_all") -> DataFrame:
    if policy == "drop_all":
        return drop_all(df, key)
    if policy == "keep_first":
        return keep_first(df.filter(F.col(key).isNotNull()), [key], order)
    raise ValueError(f"no such policy: {policy}")
