"""Substring dedup: passages that an earlier document holds too, by level-wise doubling.

A window of words can only be repeated if both its halves are. Level one finds half-length windows
that two documents hold, level two the full windows whose halves are among them, and `longest_repeats`
goes on, from repeated windows of L words to those of 2L, until no candidate survives.

Level one needs few of the half windows: each full window names the one among its half windows with
the least hash, so equal windows name the same, and of all half windows about one in four is named.
Those that two documents name go into a Bloom filter of a stated size. It only spares shuffling: all
windows that pass it are counted exactly, by a 96-bit hash, at level two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sized, written
from .bloom import filter_of, size_for
from .textops import Words, chunks, sliding_min, text_buffer, windows

LAST = (1 << 63) - 1
WINDOW = 13
_SEED = 0x2545F4914F6CDD1D


def _named_halves(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of k words within a text, and the least hash of the half windows in each."""
    half = -(-k // 2)
    least = sliding_min(windows(h, half), k - half + 1)
    at = np.flatnonzero(words.left()[: len(least)] >= k)
    return at, least[at]


def _halves_seen(base: DataFrame, k: int) -> DataFrame:
    """(half): hashes that windows of at least two ids name."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            ids = batch.column("key").to_numpy()
            for lo, hi in chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at, half = _named_halves(words, words.hashes(), k)
                key = ids[lo:hi][words.doc[at]]
                # neighbouring windows name the same half
                new = np.ones(len(at), bool)
                new[1:] = (half[1:] != half[:-1]) | (key[1:] != key[:-1])
                half, key = half[new], key[new]
                order = np.argsort(half)
                half, key = half[order], key[order]
                first = np.flatnonzero(np.append(True, half[1:] != half[:-1])) if len(half) else np.zeros(0, np.int64)
                low = np.minimum.reduceat(key, first) if len(half) else key
                high = np.maximum.reduceat(key, first) if len(half) else key
                yield pa.RecordBatch.from_arrays([pa.array(half[first].view(np.int64)), pa.array(low), pa.array(high)], names=["half", "low", "high"])

    rows = base.select("key", "text").mapInArrow(name, "half bigint, low bigint, high bigint")
    return rows.groupBy("half").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("half")


def repeated_windows(docs: DataFrame, k: int = WINDOW, halves_a_doc: int = 16) -> DataFrame:
    """(h1, h2, key, tie, at, first): windows of k words that at least two ids hold, wherever they begin.

    key and tie name the document (its id, LAST for null, and the hash of its text), at counts words
    from 0, first is the least id that holds the window.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    halves = written(spark, _halves_seen(base, k), "halves")
    log_bits = size_for(halves.count())
    seen = spark.sparkContext.broadcast(filter_of(halves, "half", log_bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for lo, hi in chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                h = words.hashes()
                at, half = _named_halves(words, h, k)
                at = at[seen.value.test(half)]
                doc = words.doc[at]
                h1 = windows(h, k)[at].view(np.int64)
                h2 = (windows(words.hashes(_SEED), k)[at] >> np.uint64(33)).astype(np.int32)
                take = pa.array(doc + lo)
                place = (at - words.bounds[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column("key").take(take), batch.column("tie").take(take), pa.array(place)], names=["h1", "h2", "key", "tie", "at"])

    found = base.mapInArrow(candidates, "h1 bigint, h2 int, key bigint, tie bigint, at int")
    first = found.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    first = written(spark, first, "window-first")
    return found.join(first, ["h1", "h2"])


def longest_repeats(docs: DataFrame, k: int = WINDOW, **options) -> DataFrame:
    """(doc_id, tie, words): the longest length k, 2k, 4k, ... at which the document shares a window with another id.

    Documents that share none have no row. A window of 2L words is two that stand L apart; its class
    is the pair of theirs, so no text is read again. Ends when no window of a level is shared.
    """
    spark = docs.sparkSession
    level = written(spark, repeated_windows(docs, k, **options).select("key", "tie", "at", F.xxhash64("h1", "h2").alias("class")).distinct(), "level")
    best, length = [], k
    while not level.isEmpty():
        best.append(level.select("key", "tie", F.lit(length).alias("words")).distinct())
        later = level.select("key", "tie", (F.col("at") - length).alias("at"), F.col("class").alias("then"))
        pairs = level.join(later, ["key", "tie", "at"]).select("key", "tie", "at", F.xxhash64("class", "then").alias("class"))
        shared = pairs.groupBy("class").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("class")
        level, length = written(spark, pairs.join(written(spark, shared, "shared"), "class").select("key", "tie", "at", "class"), "level"), 2 * length
    if not best:
        return level.select(F.col("key").alias("doc_id"), "tie", F.lit(0).alias("words"))
    out = best[0]
    for b in best[1:]:
        out = out.unionByName(b)
    return out.groupBy("key", "tie").agg(F.max("words").alias("words")).select(F.nullif("key", F.lit(LAST)).alias("doc_id"), "tie", "words")


def _as_spans(gone: DataFrame, k: int) -> DataFrame:
    """(key, tie, lo, hi): the word ranges that windows beginning at ``at`` cover, merged where they meet."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for at in batch.column("at"):
                at = np.unique(at.values.to_numpy())
                fresh = np.append(True, np.diff(at) > k)
                lows.append(at[fresh])
                highs.append(at[np.append(fresh[1:], True)] + k)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))], names=["key", "tie", "lo", "hi"])

    return gone.mapInArrow(merge, "key bigint, tie bigint, lo array<int>, hi array<int>")


def remove_repeats(docs: DataFrame, k: int = WINDOW, **options) -> DataFrame:
    """Per row doc_id, n_words, n_removed, kept_text and kept_sha256 (of the kept words with single spaces).

    A word goes if a window of k words over it also begins in a document with a smaller id; windows
    are judged on the input. Null texts have no words; a null id counts as one id after all others;
    rows of equal id do not repeat one another; repeated rows are treated alike; texts under k words
    stay whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    gone = repeated_windows(docs, k, **options).filter("key > first").groupBy("key", "tie").agg(F.collect_list("at").alias("at"))
    gone = sized(written(spark, _as_spans(gone, k).withColumnsRenamed({"key": "_key", "tie": "_tie"}), "words-gone"))
    rows = docs.select("doc_id", "text").withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), "_at": F.xxhash64("text")})
    rows = rows.join(gone, (F.col("_id") == F.col("_key")) & (F.col("_at") == F.col("_tie")), "left").select("doc_id", "text", "lo", "hi")
    schema = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("kept_sha256", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            raw, lows, highs = buf.tobytes(), batch.column("lo"), batch.column("hi")
            total, removed, kept = [], [], []
            for i in range(len(offs) - 1):
                words = raw[offs[i] : offs[i + 1]].split()  # of bytes: at the six characters
                n = len(words)
                if lows[i].is_valid:
                    edges = [0, *chain.from_iterable(zip(lows[i].as_py(), highs[i].as_py(), strict=True)), n]
                    words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return rows.mapInArrow(cut, schema)


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
runs as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as run from places),
least as (select run, min(doc_id) as first from runs group by run),
gone as (select distinct doc_id, i + j as p from runs join least using (run), (select unnest(range(13)) as j) where first < doc_id),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d)
select d.doc_id, count(x) as n_words, count(gone.p) as n_removed,
       sha256(coalesce(string_agg(x, ' ' order by words.p) filter (where gone.p is null), '')) as kept_sha256
from d left join words on d.doc_id = words.doc_id left join gone on gone.doc_id = words.doc_id and gone.p = words.p
group by d.doc_id
"""
