"""Bloom filters of 64-bit hashes, of a stated number of bits, built across partitions.

False positives only let more rows through to exact steps; nothing is ever missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEGMENT = 20  # bits of a position within a segment
_PAGE = 15  # Spark's bitmaps have 2**15 bits


def size_for(expected: int, bits_a_key: int = 16, most: int = 27) -> int:
    """log2 of the bits for so many keys: at most 2**most bits, which bounds what is broadcast."""
    return min(most, max(_SEGMENT, (max(expected, 1) * bits_a_key - 1).bit_length()))


def positions(keys: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two positions of each key; keys must be well mixed in their low 54 bits."""
    mask = np.uint64((1 << log_bits) - 1)
    return keys & mask, (keys >> np.uint64(27)) & mask


class Filter:
    """Test of membership on a packed bit array."""

    def __init__(self, bits: np.ndarray, log_bits: int) -> None:
        self.bits, self.log_bits = bits, log_bits

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in positions(keys, self.log_bits):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(keys: DataFrame, column: str, log_bits: int) -> Filter:
    """The filter of a bigint column. Only its bits come to the driver: at most 2**(log_bits - 3) bytes."""
    mask = (1 << log_bits) - 1
    at = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 27).bitwiseAND(F.lit(mask))))
    pages = keys.select(at.alias("p")).groupBy(F.shiftright("p", _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("bits"))
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    for page, data in pages.collect():
        bits[page << (_PAGE - 3) : (page + 1) << (_PAGE - 3)] = np.frombuffer(data, np.uint8)
    return Filter(bits, log_bits)


def _merge(frame: pd.DataFrame) -> np.ndarray:
    """Times each bit of a segment was set, as 0, 1 or 2 for more."""
    times = np.zeros(1 << _SEGMENT, np.uint8)
    for data in frame["data"]:
        got = np.frombuffer(data, np.uint32)
        at = got >> 1
        times[at] = np.minimum(times[at] + 1 + (got & 1), 2)
    return times


def _packed(times: np.ndarray) -> bytes:
    at = np.flatnonzero(times)
    return ((at << 1) | (times[at] > 1)).astype(np.uint32).tobytes()


def seen_twice(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], log_bits: int) -> Filter:
    """The filter of keys seen at least twice, from two filters: of keys seen once, and seen again.

    ``keys_of`` gives the keys of a batch, each as often as it counts. Each task keeps the two filters
    as one array of 0, 1, 2 a bit and hands on the bits it set, by segment. Segments are merged in two
    steps, 64 shares of tasks first, so what one task merges does not grow with the number of tasks.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << log_bits, np.uint8)
        for batch in batches:
            keys = keys_of(batch)
            a, b = positions(keys, log_bits)
            at, count = np.unique(np.concatenate([a, b[a != b]]), return_counts=True)
            times[at] = np.minimum(times[at] + np.minimum(count, 2), 2)
        share = TaskContext.get().partitionId() % 64
        found = [(s, _packed(times[s << _SEGMENT : (s + 1) << _SEGMENT])) for s in range(1 << (log_bits - _SEGMENT))]
        found = [x for x in found if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([share] * len(found), pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["segment", "share", "data"])

    def step(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [key[0]], "data": [_packed(_merge(frame))]})

    def last(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [key[0]], "data": [np.packbits(_merge(frame) > 1, bitorder="little").tobytes()]})

    parts = df.mapInArrow(gather, "segment int, share int, data binary")
    merged = parts.groupBy("segment", "share").applyInPandas(step, "segment int, data binary")
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    for segment, data in merged.groupBy("segment").applyInPandas(last, "segment int, data binary").collect():
        bits[segment << (_SEGMENT - 3) : (segment + 1) << (_SEGMENT - 3)] = np.frombuffer(data, np.uint8)
    return Filter(bits, log_bits)
