"""Fields read back from generated text: from prose with an optional header, or from a JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BINS, CATEGORIES, SPATIAL

# How a category ({}) is named in prose; with underscores, or with spaces instead.
CATEGORY_PHRASES_BOTH = ("classified as {}", "category {}", "the edit is {}")
CATEGORY_PHRASES_SPACED = ("is an {}", "is a {}")
# Phrases for a place and for a bin, the first that is found decides.
SPATIAL_PHRASES = (
    ("spans the entire image", "whole_image"),
    ("scattered across multiple regions", "scattered"),
    ("scattered across", "scattered"),
    ("upper-left region", "upper_left"),
    ("upper left region", "upper_left"),
    ("upper-right region", "upper_right"),
    ("upper right region", "upper_right"),
    ("lower-left region", "lower_left"),
    ("lower left region", "lower_left"),
    ("lower-right region", "lower_right"),
    ("lower right region", "lower_right"),
    ("centered in the image", "centered"),
    ("alignment failure", "alignment_failed"),
    ("alignment failed", "alignment_failed"),
)
BIN_PHRASES = (
    ("easier than average", "easy"),
    ("harder than average", "hard"),
    ("moderate detection difficulty", "medium"),
    ("moderate difficulty", "medium"),
    ("of moderate", "medium"),
)
HEADER = r"\[category=([\w_]+),\s*scope=([\w_]+),\s*difficulty=(\w+)"
FIELDS = ("category", "spatial_descriptor", "difficulty_bin")


def _first(text: Column, phrases: list[tuple[str, str]]) -> Column:
    found = F.lit(None).cast("string")
    for phrase, value in reversed(phrases):
        found = F.when(F.contains(text, F.lit(phrase)), F.lit(value)).otherwise(found)
    return found


def category_phrases() -> list[tuple[str, str]]:
    """(phrase, category) of all canonical categories in order."""
    out = []
    for name in CATEGORIES:
        spaced = name.replace("_", " ")
        out += [(p.replace("{}", n), name) for p in CATEGORY_PHRASES_BOTH for n in dict.fromkeys((name, spaced))]
        out += [(p.replace("{}", spaced), name) for p in CATEGORY_PHRASES_SPACED]
    return out


def _listed(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value)


def chain_fields(text: Column) -> dict[str, Column]:
    """category, spatial_descriptor and difficulty_bin of prose; null where not found. A header comes first."""
    low = F.lower(text)
    return {
        "category": F.coalesce(_listed(F.regexp_extract(text, HEADER, 1), CATEGORIES), _first(low, category_phrases())),
        "spatial_descriptor": _first(low, list(SPATIAL_PHRASES)),
        "difficulty_bin": F.coalesce(_listed(F.regexp_extract(text, HEADER, 3), BINS), _first(low, list(BIN_PHRASES))),
    }


def label_fields(text: Column) -> dict[str, Column]:
    """The same of the first JSON object in the text; each must be a string of the canonical list."""
    found = F.regexp_extract(text, r"(\{[^}]+\})", 1)
    # as a variant, a number or a list does not pass for a string
    parsed = F.try_parse_json(found)
    allowed = dict(zip(FIELDS, (CATEGORIES, SPATIAL, BINS), strict=True))
    value = lambda n: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{n}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{n}", "string"))
    return {n: _listed(value(n), allowed[n]) for n in FIELDS}


def extract(rows: DataFrame, mode: str = "chain", text: str = "generated_text", prefix: str = "pred_") -> DataFrame:
    """Adds the three fields of ``text`` under ``prefix``; running it again replaces them."""
    found = {"chain": chain_fields, "label_only": label_fields}[mode](F.coalesce(F.col(text), F.lit("")))
    return rows.withColumns({f"{prefix}{n}": c for n, c in found.items()})
