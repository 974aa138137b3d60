"""Label masks of token rows: what stands before an answer, and padding, does not count in training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def marker_end(ids: Column, marker: Column) -> Column:
    """Tokens up to the end of the first place where marker stands in ids; null where it does not."""
    m = F.size(marker)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - m + 1, F.lit(1))), lambda i: F.slice(ids, i, m) == marker)
    return F.get(starts, F.lit(0)) - 1 + m


def label_mask(ids: Column, marker: Column, pad: Column) -> Column:
    """ids with IGNORED up to the marker's end and at padding; an error where the marker is absent."""
    end = F.coalesce(marker_end(ids, marker), F.raise_error(F.lit("the marker is not in a row's tokens")).cast("int"))
    return F.transform(ids, lambda x, i: F.when((i < end) | (x == pad), F.lit(IGNORED)).otherwise(x))


def batch_diagnostics(rows: DataFrame, ids: str = "input_ids", labels: str = "labels", pad: str = "pad_id") -> DataFrame:
    """Adds counts of active and ignored tokens and of padding, its side, and the least and largest id."""
    n_pad = F.size(F.filter(ids, lambda x: x == F.col(pad)))
    left, right = F.get(ids, F.lit(0)) == F.col(pad), F.get(ids, F.size(ids) - 1) == F.col(pad)
    return rows.withColumns(
        {
            "n_active": F.size(F.filter(labels, lambda x: x != IGNORED)),
            "n_ignored": F.size(F.filter(labels, lambda x: x == IGNORED)),
            "n_pad": n_pad,
            "pad_side": F.when(n_pad == 0, "none").when(left & right, "both").when(left, "left").when(right, "right").otherwise("inside"),
            "least_id": F.array_min(ids),
            "largest_id": F.array_max(ids),
        }
    )
