"""Instruction complexity: saturating counts of words of a few kinds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import clip01, let

# The three word sets.
SPATIAL_WORDS = (
    "left", "right", "top", "bottom", "upper", "lower", "center", "centre", "middle", "above", "below", "behind",
    "front", "near", "next", "corner", "edge", "side",
)
CONJUNCTIONS = ("and", "while", "then", "also", "but")
EDIT_VERBS = (
    "add", "remove", "replace", "change", "modify", "transform", "convert", "swap", "shift", "make", "turn", "set",
    "put", "move", "rotate", "delete", "erase", "paint", "color", "recolor", "blur", "sharpen", "lighten", "darken",
    "brighten", "tint",
)


@dataclass(frozen=True)
class ComplexityConfig:
    """Counts at which each feature is full, and the features' weights, which are normalised by their sum."""

    saturation: dict[str, float] = field(default_factory=lambda: {"length": 25, "verbs": 3, "conjunctions": 2, "spatial": 2})
    weights: dict[str, float] = field(default_factory=lambda: {"length": 0.25, "verbs": 0.25, "conjunctions": 0.25, "spatial": 0.25})

    def __post_init__(self) -> None:
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must not be negative")
        if sum(self.weights.values()) <= 0:
            raise ValueError("weights must have a positive sum")
        if any(s <= 0 for s in self.saturation.values()):
            raise ValueError("saturation counts must be positive")


def tokens(text: Column) -> Column:
    """Runs of letters and apostrophes, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z']+)"), 1), F.lower)


def word_counts(words: Column) -> dict[str, Column]:
    """Length, and how many words of each kind there are, repeats included."""
    of = lambda kind: F.size(F.filter(words, lambda w: w.isin(*kind)))
    return {"length": F.size(words), "verbs": of(EDIT_VERBS), "conjunctions": of(CONJUNCTIONS), "spatial": of(SPATIAL_WORDS)}


def complexity(text: Column, config: ComplexityConfig = ComplexityConfig()) -> Column:
    """0 to 1; null, empty and wordless text has 0."""
    total = sum(config.weights.values())

    def value(words: Column) -> Column:
        out = None
        for name, count in word_counts(words).items():
            part = F.lit(config.weights[name] / total) * F.least(F.lit(1.0), count / F.lit(float(config.saturation[name])))
            out = part if out is None else out + part
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(clip01(out))

    return let(tokens(F.coalesce(text, F.lit(""))), value)
