"""Line dedup: lines that several documents hold stay in the first only.

Two Bloom filters find suspects: a line's key is suspected when the filter of keys seen again holds
it. Only suspects are shuffled, for exact confirmation by a 128-bit hash and to find the least id that
holds each. A document's confirmed lines then go back to it by its id and the hash of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import sized, written
from .bloom import seen_twice, size_for
from .textops import Words, char_counts, chunks, hash_slices, lines, mix, text_buffer

#: Stands for a null id, after all others.
LAST = (1 << 63) - 1
LEAST_CHARS = 10
_SEED = 0x5851F42D4C957F2D


def _line_keys(buf: np.ndarray, offs: np.ndarray, least: int, seeds: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Which lines have a key of at least ``least`` code points, these keys' hashes, and lines per text."""
    starts, ends, count = lines(buf, offs)
    words = Words(buf, offs, lower=True)
    lo, hi = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    at = np.flatnonzero(hi > lo)
    a, b = words.starts[lo[at]], words.ends[hi[at] - 1]
    long = char_counts(buf, a, b) >= least
    return at[long], [hash_slices(words.buf, a[long], (b - a)[long], s) for s in seeds], count


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of keys within a batch's texts."""
    return mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _keys(batch: pa.RecordBatch, least: int, seeds: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts and hashes of the distinct keys of each text."""
    buf, offs = text_buffer(batch.column("text"))
    docs, hashes = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in seeds]
    for lo, hi in chunks(offs):
        at, found, count = _line_keys(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], least, seeds)
        doc = np.repeat(np.arange(lo, hi), count)[at]
        order = np.lexsort((found[0], doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (found[0][order][1:] != found[0][order][:-1])
        docs.append(doc[order][new])
        for h, f in zip(hashes, found, strict=True):
            h.append(f[order][new])
    return np.concatenate(docs), [np.concatenate(h) for h in hashes]


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, lines_a_doc: int = 16) -> DataFrame:
    """(key, tie, drop): for each document that loses lines, the 64-bit hashes of their keys.

    A document is key, its id or LAST for null, and tie, the hash of its text.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    log_bits = size_for(docs.select("doc_id").count() * lines_a_doc)
    again = spark.sparkContext.broadcast(seen_twice(base.select("text"), lambda batch: _keys(batch, least, (0,))[1][0], log_bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, (h1, h2) = _keys(batch, least, (0, _SEED))
            hit = again.value.test(h1)
            doc = pa.array(doc[hit])
            yield pa.RecordBatch.from_arrays([pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64)), batch.column("key").take(doc), batch.column("tie").take(doc)], names=["h1", "h2", "key", "tie"])

    found = written(spark, base.mapInArrow(suspects, "h1 bigint, h2 bigint, key bigint, tie bigint"), "line-suspects")
    first = found.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    first = written(spark, first, "line-first")
    lost = found.join(sized(first), ["h1", "h2"]).filter("key > first")
    return lost.groupBy("key", "tie").agg(F.collect_set("h1").alias("drop"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, **options) -> DataFrame:
    """``docs`` with text without its dropped lines, and n_lines, n_dropped, kept_sha256.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    ``least`` code points that at least two ids hold lose all their lines except in the least id that
    holds them; other lines stay, joined by \\n. Null and empty texts have one empty line and stay as
    they are; a null id counts as one id after all others; repeated rows of an id are not told apart,
    so their lines stay; an empty table gives no rows. Other columns go through, n_chars
    made to match; a column of a new one's name is replaced.
    """
    spark = docs.sparkSession
    drops = repeated_lines(docs, least, **options).withColumnsRenamed({"key": "__q_key", "tie": "__q_tie", "drop": "__q_drop"})
    drops = written(spark, drops, "line-drops")
    rows = docs.withColumns({"__q_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), "__q_at": F.xxhash64("text")})
    rows = rows.join(sized(drops), (F.col("__q_id") == F.col("__q_key")) & (F.col("__q_at") == F.col("__q_tie")), "left").drop("__q_id", "__q_at", "__q_key", "__q_tie")
    new = ["n_lines", "n_dropped", "kept_sha256"]
    names = [c for c in docs.columns if c not in new]
    schema = docs.select(names).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = batch.column("text"), batch.column("__q_drop")
            buf, offs = text_buffer(texts)
            raw = buf.tobytes()
            n = len(offs) - 1
            kept = [raw[offs[i] : offs[i + 1]] for i in range(n)]
            n_lines = np.array([k.count(b"\n") + 1 for k in kept], np.int64)
            n_dropped = np.zeros(n, np.int64)
            some = []
            of = np.repeat(np.arange(n), np.diff(drop.offsets.to_numpy()))
            wanted = np.sort(_own(drop.flatten().to_numpy().view(np.uint64), of))
            for lo, hi in chunks(offs) if len(of) else ():
                at, (keys,), count = _line_keys(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], least, (0,))
                doc = np.repeat(np.arange(lo, hi), count)[at]
                first = np.append(0, np.cumsum(count))[doc - lo]
                hit = np.isin(_own(keys, doc), wanted)
                doc, place = doc[hit], (at - first)[hit]
                if not len(doc):
                    continue
                edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                for i, gone in zip(doc[edges].tolist(), np.split(place, edges[1:]), strict=True):
                    split, gone = kept[i].split(b"\n"), set(gone.tolist())
                    kept[i] = b"\n".join([x for j, x in enumerate(split) if j not in gone])
                    n_dropped[i] = len(gone)
                    some.append(i)
            columns = {c: batch.column(c) for c in names}
            if some:
                changed = {i: kept[i].decode() for i in some}
                columns["text"] = pa.array([changed.get(i, x) if i in changed else x.as_py() for i, x in enumerate(texts)], texts.type)
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    columns["n_chars"] = pa.array([len(changed[i]) if i in changed else x.as_py() for i, x in enumerate(old)], old.type)
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_lines), pa.array(n_dropped), sha], names=[*names, "n_lines", "n_dropped", "kept_sha256"])

    return rows.select(*names, "__q_drop").mapInArrow(cut, schema)


SQL = r"""
with l as (
  select doc_id, line, i, lower_az(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
k as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
j as (select l.doc_id, l.line, l.i, k.first is not null and l.doc_id > k.first as gone from l left join k using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
""".replace("lower_az(", "translate(").replace("chr(13))) as key", "chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key")
