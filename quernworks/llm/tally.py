"""Exact counts of 64-bit codes over all texts, shuffled in little space.

Tasks add up the codes that they see and hand on, for each bucket of a code's first bits, the distinct
next 32 bits, and apart from them how often those seen again were. So a code costs about four bytes in
the shuffle, a hot one no more than others, and a bucket is merged in bounded memory. Codes are cut to
32 bits and those of the bucket: two may, rarely, count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import chunks, given_back, mix, text_buffer

#: Codes that a task counts before it hands counts on; codes that a bucket has on average.
_TALLY, _BUCKET = 9 << 18, 1 << 21


def buckets_for(expected: int) -> int:
    """log2 of the buckets for so many codes."""
    return min(16, max(9, (expected // _BUCKET).bit_length()))


def cut(codes: np.ndarray, log_buckets: int) -> np.ndarray:
    """The name that a code has in the counts, well mixed."""
    return mix(codes >> np.uint64(32 - log_buckets))


def _parts(parts: list[np.ndarray], log_buckets: int) -> pa.RecordBatch:
    top = np.sort(np.concatenate(parts) >> np.uint64(32 - log_buckets)) if parts else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else np.zeros(0, np.int64)
    more = np.diff(np.append(first, len(top))) - 1
    value = top[first]
    edges = np.searchsorted(value, np.arange((1 << log_buckets) + 1, dtype=np.uint64) << np.uint64(32))
    full = np.flatnonzero(np.diff(edges))
    low, again = value.astype(np.uint32), np.flatnonzero(more)
    of = np.searchsorted(again, edges)
    rows = [(low[edges[i] : edges[i + 1]], again[of[i] : of[i + 1]]) for i in full]
    columns = [[x.tobytes() for x, _ in rows], [low[x].tobytes() for _, x in rows], [more[x].astype(np.uint32).tobytes() for _, x in rows]]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "low", "again", "more"])


def counted(texts: DataFrame, codes: Callable[[np.ndarray, np.ndarray], np.ndarray], log_buckets: int, least: int = 2) -> DataFrame:
    """(code, times) of codes counted at least ``least`` times; ``codes`` gives those of a chunk of the column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for lo, hi in chunks(offs):
                parts.append(codes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                size += len(parts[-1])
                if size >= _TALLY:
                    yield _parts(parts, log_buckets)
                    parts, size = [], 0
                    given_back()
        yield _parts(parts, log_buckets)
        del parts
        given_back()

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ints = lambda c: np.frombuffer(b"".join(frame[c]), np.uint32)
        low, times = np.unique(ints("low"), return_counts=True)
        np.add.at(times, np.searchsorted(low, ints("again")), ints("more").astype(np.int64))
        some = times >= least
        code = mix(low[some].astype(np.uint64) | np.uint64(int(key[0]) << 32))
        return pd.DataFrame({"code": code.view(np.int64), "times": times[some]})

    return texts.mapInArrow(count, "bucket int, low binary, again binary, more binary").groupBy("bucket").applyInPandas(total, "code bigint, times bigint")
