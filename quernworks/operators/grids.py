"""Operators on small pixel grids held as arrays, row by row, with built-in functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import clip01
from ..image import kernels


def doubles(grid: Column) -> Column:
    return F.transform(grid, lambda x: x.cast("double"))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def total(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0.0), lambda s, x: s + x)


def mean(grid: Column) -> Column:
    return total(grid) / F.size(grid)


def spread(grid: Column) -> Column:
    """Standard deviation of the population; ``grid`` must be a plain column."""
    m = mean(grid)
    return F.sqrt(F.greatest(F.aggregate(grid, F.lit(0.0), lambda s, x: s + x * x) / F.size(grid) - m * m, F.lit(0.0)))


def percentile(grid: Column, p: float) -> Column:
    """Linearly interpolated; ``grid`` must be a plain column."""
    sorted_ = F.sort_array(grid)
    at = F.lit(p / 100.0) * (F.size(grid) - 1)
    low = F.floor(at).cast("int")
    x, y = F.get(sorted_, low), F.get(sorted_, F.least(low + 1, F.size(grid) - 1))
    return x + (y - x) * (at - low)


def with_normalized(df: DataFrame, grid: str, out: str, p: float = 99.0) -> DataFrame:
    """Adds the grid over its own percentile, clipped to [0, 1]; zeros where that is next to nothing."""
    if not 50 <= p <= 100:
        raise ValueError("the percentile must be from 50 to 100")
    steps = df.withColumn("_top", percentile(F.col(grid), p))
    scaled = F.transform(grid, lambda x: clip01(x / F.col("_top")))
    zeros = F.transform(grid, lambda x: F.lit(0.0))
    return steps.withColumn(out, F.when(F.col("_top") <= 1e-6, zeros).otherwise(scaled)).drop("_top")


def combine_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def combine_mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def strongest(means: dict[str, Column]) -> Column:
    """The name of the largest mean, the first of equal ones."""
    top = F.greatest(*means.values()) if len(means) > 1 else next(iter(means.values()))
    found = F.lit(None).cast("string")
    for name, m in reversed(means.items()):
        found = F.when(m == top, F.lit(name)).otherwise(found)
    return found


def above(grid: Column, cut: Column | float) -> Column:
    cut = cut if isinstance(cut, Column) else F.lit(cut)
    return F.transform(grid, lambda x: x > cut)


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """IoU and Dice of two masks, 1 for two empty ones."""
    both = count_true(F.zip_with(a, b, lambda x, y: x & y))
    either = count_true(F.zip_with(a, b, lambda x, y: x | y))
    sizes = count_true(a) + count_true(b)
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1))), F.when(sizes == 0, 1.0).otherwise(2 * both / F.greatest(sizes, F.lit(1)))


def route(df: DataFrame, grid: str, cut: float, global_mean: float = 0.4, global_area: float = 0.9, ambiguous_area: float = 0.005) -> DataFrame:
    """Adds mask, mask_area_frac, edit_scope and confidence of a combined grid, cut at a stated value."""
    g = F.col(grid)
    steps = df.withColumns({"_mean": mean(g), "_std": spread(g), "_cut": above(g, cut)})
    steps = steps.withColumns({"_area": count_true(F.col("_cut")) / F.size(g), "_over": total(F.filter(g, lambda x: x > cut)), "_all": total(g), "_n": F.size(g)})
    n_over = F.col("_area") * F.col("_n")
    contrast = F.when((F.col("_area") == 0) | (F.col("_area") == 1), 0.0).otherwise(clip01(F.try_divide(F.col("_over"), n_over) - F.try_divide(F.col("_all") - F.col("_over"), F.col("_n") - n_over)))
    flat = F.col("_std") < 1e-4
    whole = F.when(flat, F.col("_mean") >= 0.5).otherwise(F.col("_mean") >= global_mean)
    wide = F.col("_area") >= global_area
    scope = F.when(whole, "global").when(flat, "ambiguous").when(wide, "global").when(F.col("_area") <= ambiguous_area, "ambiguous").otherwise("local")
    mask = F.when(whole | (~flat & wide), F.transform(g, lambda x: F.lit(True))).when(flat, F.transform(g, lambda x: F.lit(False))).otherwise(F.col("_cut"))
    confidence = F.when(whole, clip01(F.col("_mean"))).when(flat, 0.0).otherwise(contrast)
    steps = steps.withColumns({"mask": mask, "edit_scope": scope, "confidence": confidence, "combined_diff_mean": F.col("_mean")})
    return steps.withColumn("mask_area_frac", count_true(F.col("mask")) / F.size("mask")).drop("_mean", "_std", "_cut", "_area", "_over", "_all", "_n")


def with_shape(df: DataFrame, mask: str, width: int, scope: str = "edit_scope") -> DataFrame:
    """Adds mask_compactness and spatial_descriptor of boolean grids, by the image kernels in Arrow batches."""
    @F.pandas_udf("mask_compactness double, spatial_descriptor string")
    def shape(masks: pd.Series, scopes: pd.Series) -> pd.DataFrame:
        grids = [np.asarray(m, bool).reshape(-1, width) for m in masks]
        return pd.DataFrame({"mask_compactness": [kernels.compactness(g) for g in grids], "spatial_descriptor": [kernels.spatial_descriptor(g, s) for g, s in zip(grids, scopes, strict=True)]})

    # marked so that no filter on its results is pushed below it, which would run it and all before it twice
    once = shape.asNondeterministic()
    return df.withColumn("_s", once(F.col(mask), F.col(scope))).select("*", "_s.*").drop("_s")


def patch_distance(a: Column, b: Column, size: int) -> Column:
    """1 - cosine of matching patches of ``size`` values of two vectors."""
    n = F.size(a) / size
    part = lambda v, i: F.slice(v, i * size + 1, F.lit(size))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    one = lambda i: 1 - dot(part(a, i), part(b, i)) / F.greatest(F.sqrt(dot(part(a, i), part(a, i))) * F.sqrt(dot(part(b, i), part(b, i))), F.lit(1e-12))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one)
