"""Difficulty scores: weighted sums of clipped components."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexity import complexity
from ..functions.exact import clip01, finite

# The components of both versions, in the order they are summed, with default weights.
WEIGHTS_V1 = {"structural_change": 0.30, "perceptual_change": 0.30, "locality": 0.20, "instruction_complexity": 0.20}
WEIGHTS_V2 = {"structural_change": 0.55, "compactness_score": 0.25, "instruction_complexity": 0.20}


@dataclass(frozen=True)
class ScoreConfig:
    version: int = 2
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = WEIGHTS_V2 if self.version == 2 else WEIGHTS_V1
        given = self.weights or names
        missing = [n for n in names if n not in given]
        if missing:
            raise ValueError(f"weights missing required components: {missing}")
        for n, w in given.items():
            if isinstance(w, bool) or not isinstance(w, (int, float)):
                raise TypeError(f"weight for {n!r} must be numeric")
        object.__setattr__(self, "weights", {n: float(given[n]) for n in names})


def weighted(weights: dict[str, float]) -> Column:
    total = None
    for name, w in weights.items():
        part = F.lit(w) * F.col(name)
        total = part if total is None else total + part
    return total


def score(rows: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Adds the components, difficulty_raw and weights to rows with instruction, structural_change and mask columns.

    Version 2 leaves out rows whose mask_compactness is no number; version 1 has perceptual_change
    from combined_diff_mean and locality from mask_area_frac.
    """
    rows = rows.withColumns({"structural_change": clip01(F.col("structural_change")), "instruction_complexity": complexity(F.col("instruction"))})
    if config.version == 2:
        rows = rows.filter(finite(F.col("mask_compactness"))).withColumn("compactness_score", clip01(1 - clip01(F.col("mask_compactness"))))
    else:
        rows = rows.withColumns({"perceptual_change": clip01(F.col("combined_diff_mean")), "locality": clip01(1 - F.col("mask_area_frac"))})
    shown = F.concat(F.lit("{"), F.concat_ws(", ", *[F.lit(f'"{n}": {w!r}') for n, w in config.weights.items()]), F.lit("}"))
    return rows.withColumn("difficulty_raw", clip01(weighted(config.weights))).withColumn("weights", shown)
