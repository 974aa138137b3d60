"""Scalar helpers whose corner cases (NaN, ties, white space) are stated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once: an expression that names its input several times would copy it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def clip01(x: Column) -> Column:
    """x within [0, 1]; NaN stays NaN and null stays null."""
    return let(x, lambda v: F.when(F.isnan(v) | v.isNull(), v).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))))


def finite(x: Column) -> Column:
    """Whether x is a number: not null, NaN or infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def strip(text: Column) -> Column:
    """Text without white space, of any Unicode kind, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """x with two decimals, rounded as its exact binary value is; the JVM's formats round the shortest decimal.

    Null stays null.
    """
    return pd.Series([None if pd.isna(v) else f"{v:.2f}" for v in x], dtype=object)


def percent(x: Column) -> Column:
    """100 x to the nearest whole number, halves to even."""
    return F.bround(100 * x, 0).cast("bigint")


def rank_of(label: Column) -> Column:
    """easy, medium, hard as 0, 1, 2; null for others."""
    return F.when(label == "easy", 0).when(label == "medium", 1).when(label == "hard", 2)


def matches(predicted: Column, true: Column) -> Column:
    """Whether a prediction equals the truth; without a prediction it does not."""
    return F.coalesce(predicted == true, F.lit(False))


def id_stem(path: Column) -> Column:
    """The file name of a path without its last suffix, other characters than letters, digits, _ and - as one _ a run.

    Null for a blank path. A name with a leading dot and no other keeps it, as a character to replace.
    """
    name = F.regexp_extract(path, r"([^/]+?)/*$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    clean = F.regexp_replace(stem, r"[^A-Za-z0-9_\-]+", "_")
    return F.when(F.length(strip(path)) > 0, F.when(F.length(name) > 0, clean))


def turn_id(split: Column, image: Column, turn: Column) -> Column:
    return F.format_string("magicbrush_%s_%s_t%02d", split, image, turn)


def cache_name(url: Column) -> Column:
    """A file name for a downloaded image: 16 hexadecimal digits of the URL's SHA-1, and its image suffix, else .jpg."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    known = F.when(suffix.isin(".jpg", ".jpeg", ".png", ".webp"), suffix).otherwise(F.lit(".jpg"))
    return F.concat(F.substring(F.sha1(url), 1, 16), known)
