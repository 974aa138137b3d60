"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words before a word. Candidates are all contexts with a next word
seen a stated number of times. A candidate is retained if its next-word distribution diverges from that
of its suffix, the context without its first word (Kullback-Leibler), and with it all its suffixes. The
distributions are smoothed towards the suffix's, down to the root, the smoothed unigram distribution
with one unseen word; the rest of a state's mass goes to all other words in its suffix's proportions. A
word is scored by the longest suffix of what stands before it that is a state.

The support is a number of sightings, not a share, so the tree grows with the corpus. It lives in
tables that are grouped and joined by hash, and never comes to the driver. A run of d words and one
more is named by its context and its tail, the run without its first word. Only runs whose context and
tail have the support can have it, so each level counts what the level below left: first in little
space by cut codes, which tells nearly all of those without support, then exactly.

A score is a sum over a text's runs: each has a weight, by which it changes what its parts say. Only
the most frequent ones, of a stated number, go to the executors as a list; the others are asked for by
hash ranges of the whole table, and a Bloom filter of them, of bounded size, keeps most unknown runs
out of the requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import freed, sized, written
from .bloom import Filter, filter_of, size_for
from .tally import buckets_for, counted, cut
from .textops import Words, chunks, given_back, join2, text_buffer

#: The end of a text, as a word hash.
END = np.uint64(0xA24BAED4963EE407)
_END = int(END.view(np.int64))


@dataclass
class Tree:
    """words: the words' hashes, ascending, with counts. Level d has, for contexts of d words: contexts
    (codes, ascending) with log_rest and their suffix's place a level below, and edges (context's place
    * words + word) with log_p."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    levels: list[dict[str, np.ndarray]] = field(default_factory=list)

    @property
    def log_z(self) -> float:
        return _log_z(self.total, self.distinct)


def _log_z(total: int, distinct: int) -> float:
    return float(np.log10(total + 0.5 * (distinct + 1)))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in an ascending table, -1 for absent ones."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = -1
    return at


class Tokens:
    """The words of a chunk of texts, lower-cased, each text ended by END; before[i]: tokens of its text before i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        words = Words(buf, offs, lower=True)
        n = len(offs) - 1
        self.bounds = words.bounds + np.arange(n + 1)
        self.hashes = np.empty(self.bounds[-1], np.uint64)
        self.hashes[np.arange(len(words.doc)) + words.doc] = words.hashes()
        self.hashes[self.bounds[1:] - 1] = END
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))
        self.before = np.arange(len(self.hashes)) - self.bounds[self.doc]

    def runs(self, level: int) -> np.ndarray:
        """Codes of the runs of ``level`` words and the token they end at; meaningless where before is under ``level``."""
        out = self.hashes
        for _ in range(level):
            out = longer(out)
        return out


def longer(runs: np.ndarray) -> np.ndarray:
    """Codes of runs one word longer: that of the context, which ends a token earlier, and of the tail."""
    out = runs.copy()
    out[1:] = join2(runs[:-1], runs[1:])
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Tokens]]:
    buf, offs = text_buffer(batch.column("text"))
    for lo, hi in chunks(offs):
        yield lo, hi, Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


#: Distinct words or runs that a task gathers before it hands on their counts.
_GATHER = 1 << 19


class _Gathered:
    """Distinct keys with counts and a witness each, gathered over a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *witness: np.ndarray) -> None:
        _, first, times = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((keys[first], times, *(w[first] for w in witness)))
        self.size += len(first)
        if self.size >= _GATHER and len(self.parts) > 1:
            merged = self._merged()
            self.parts, self.size = [merged], len(merged[0])

    def full(self) -> bool:
        return self.size >= _GATHER

    def _merged(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        keys, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
        times = np.bincount(at, columns[1], len(keys)).astype(np.int64)
        return keys, times, *(w[first] for w in columns[2:])

    def take(self) -> tuple[np.ndarray, ...] | None:
        out = self._merged() if self.parts else None
        self.parts, self.size = [], 0
        return out


def _word_counts(train: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Gathered()
        for batch in batches:
            for _, _, t in _chunks(batch):
                found.add(t.hashes)
                if found.full():
                    yield _longs(*found.take(), names=["code", "times"])
        if (last := found.take()) is not None:
            yield _longs(*last, names=["code", "times"])
        del last, found
        given_back()

    return train.mapInArrow(count, "code bigint, times bigint").groupBy("code").agg(F.sum("times").alias("times"))


def _runs(t: Tokens, level: int, below: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, contexts and tails of the runs of ``level`` words and one more whose context and tail pass ``below``."""
    shorter = t.runs(level - 1)
    known = below.test(shorter)
    at = np.flatnonzero(t.before >= level)
    at = at[known[at] & known[at - 1]]
    context, tail = shorter[at - 1], shorter[at]
    return join2(context, tail), context, tail


def _run_counts(train: DataFrame, level: int, below: Filter, expected: int, support: int) -> DataFrame:
    """(context, tail, times) of runs of ``level`` words and one more that are seen ``support`` times."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(below)
    log_buckets = buckets_for(expected)
    likely = counted(train, lambda buf, offs: _runs(Tokens(buf, offs), level, shared.value)[0], log_buckets, support)
    likely = written(spark, likely, f"pst-likely{level}")
    passed = spark.sparkContext.broadcast(filter_of(likely, "code", size_for(likely.count())))
    freed(likely)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Gathered()
        for batch in batches:
            for _, _, t in _chunks(batch):
                code, context, tail = _runs(t, level, shared.value)
                some = passed.value.test(cut(code, log_buckets))
                found.add(code[some], context[some], tail[some])
                if found.full():
                    yield _longs(*found.take()[1:], names=["times", "context", "tail"])
        if (last := found.take()) is not None:
            yield _longs(*last[1:], names=["times", "context", "tail"])
        del last, found
        given_back()

    runs = train.mapInArrow(count, "times bigint, context bigint, tail bigint")
    return runs.groupBy("context", "tail").agg(F.sum("times").alias("times")).filter(F.col("times") >= support)


def _coded(df: DataFrame) -> DataFrame:
    """``df`` with the code of the run of its columns context and tail."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "tail"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(join2(a, b).view(np.int64))], names=[*batch.schema.names, "code"])

    return df.mapInArrow(code, StructType([*df.schema.fields, StructField("code", LongType())]))


@dataclass
class Tables:
    """The tree as tables: counts (code, times) of words; of each level states (context, log_rest, seen,
    suffix: the code of the context without its first word) and edges (context, tail, word, times, code,
    log_rest, log_parent, log_p)."""

    counts: DataFrame
    total: int
    distinct: int
    levels: list[tuple[DataFrame, DataFrame]]
    #: The written tables that these read.
    scratch: list[DataFrame] = field(default_factory=list)


def _candidates(found: DataFrame, below: DataFrame, pull: float) -> DataFrame:
    """Runs with their smoothed probability, and of their context the rest's factor and the divergence."""
    contexts = below.select(F.col("code").alias("context"), F.col("times").alias("seen"), "suffix")
    tails = below.select(F.col("code").alias("tail"), "word", F.col("log_p").alias("log_parent"))
    edges = found.join(tails, "tail").join(contexts, "context")
    edges = edges.withColumn("log_p", F.log10((F.col("times") + pull * F.pow(F.lit(10.0), "log_parent")) / (F.col("seen") + pull)))
    p, parent = F.pow(F.lit(10.0), "log_p"), F.pow(F.lit(10.0), "log_parent")
    sums = edges.groupBy("context").agg(F.sum(p).alias("own"), F.sum(parent).alias("theirs"), F.sum(p * F.log(p / parent)).alias("gain"))
    rest, theirs = F.greatest(1 - F.col("own"), F.lit(1e-12)), F.greatest(1 - F.col("theirs"), F.lit(1e-12))
    # the sums are dealt by context as the edges are, so this moves no row
    return edges.join(sums.select("context", F.log10(rest / theirs).alias("log_rest"), (F.col("gain") + rest * F.log(rest / theirs)).alias("gain")), "context")


def tables(train: DataFrame, counts: DataFrame, depth: int = 2, support: int = 5, divergence: float = 0.01, pull: float = 10.0) -> Tables:
    """The tree of the ``text`` column of train; counts: (code, times) of all its words.

    ``depth``: words of the longest contexts. ``support``: times a run is seen at least, whatever the size
    of the corpus. ``pull``: the weight of the suffix's distribution, in sightings.
    """
    if depth < 0:
        raise ValueError("contexts have no negative number of words")
    spark = train.sparkSession
    total, distinct = counts.agg(F.sum("times"), F.count(F.lit(1))).first()
    out = Tables(counts, total or 0, distinct, [])
    # all candidates, level by level: of the runs below (code, times, word: the last one, suffix: the tail, log_p)
    root = F.log10(F.col("times") + 0.5) - F.lit(_log_z(out.total, distinct))
    below = counts.filter(F.col("times") >= support).select("code", "times", F.col("code").alias("word"), F.lit(None).cast("bigint").alias("suffix"), root.alias("log_p"))
    below, candidates = written(spark, below, "pst-words"), []
    out.scratch += [counts, below]
    for level in range(1, depth + 1):
        found = _run_counts(train, level, filter_of(below, "code", size_for(below.count())), out.total, support)
        found = written(spark, _coded(found), f"pst-runs{level}")
        freed()
        candidates.append(written(spark, _candidates(found, below, pull), f"pst-edges{level}"))
        freed(found)
        below = candidates[-1].select("code", "times", "word", F.col("tail").alias("suffix"), "log_p")
    # from the longest contexts on: those that diverge, and the suffixes of those retained
    wanted = None
    for edges in reversed(candidates):
        kept = edges.filter(F.col("gain") >= divergence)
        if wanted is not None:
            other = edges.filter(F.col("gain") < divergence)
            forced = written(spark, other.select("context").distinct().join(wanted, "context", "left_semi"), "pst-forced")
            out.scratch.append(forced)
            kept = kept.unionByName(other.join(sized(forced), "context", "left_semi"))
        states = kept.groupBy("context").agg(F.first("log_rest").alias("log_rest"), F.first("seen").alias("seen"), F.first("suffix").alias("suffix"))
        states = written(spark, states, "pst-states")
        wanted = states.select(F.col("suffix").alias("context")).distinct()
        out.levels.insert(0, (states, kept))
        out.scratch += [states, edges]
    return out


def grow(train: DataFrame, counts: DataFrame, **options) -> Tree:
    """The whole tree of ``tables`` on the driver, to look into that of a small corpus; scoring never does this."""
    found = tables(train, counts, **options)
    column = lambda df, *names: [x.to_numpy(zero_copy_only=False) for x in (df.select(*names).toArrow().combine_chunks().column(n) for n in names)]
    code, times = column(found.counts, "code", "times")
    order = np.argsort(code.view(np.uint64))
    tree = Tree(code.view(np.uint64)[order], times[order], found.total, found.distinct)
    for states, edges in found.levels:
        context, log_rest, suffix = column(states.withColumn("suffix", F.coalesce("suffix", F.lit(0))), "context", "log_rest", "suffix")
        order = np.argsort(context.view(np.uint64))
        context, log_rest, suffix = context.view(np.uint64)[order], log_rest[order], suffix.view(np.uint64)[order]
        below = _find(tree.levels[-1]["contexts"], suffix) if tree.levels else np.full(len(suffix), -1)
        at, word, log_p = column(edges, "context", "word", "log_p")
        code = _find(context, at.view(np.uint64)) * len(tree.words) + _find(tree.words, word.view(np.uint64))
        order = np.argsort(code)
        tree.levels.append({"contexts": context, "suffix": below, "log_rest": log_rest, "edges": code[order], "log_p": log_p[order]})
    return tree


def _log_p(tree: Tree, level: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 P(word | state) for places of contexts of ``level`` words (-1: shorter) and places of words."""
    if level == 0:
        return np.log10(tree.counts[word] + 0.5) - tree.log_z
    at = tree.levels[level - 1]
    edge = np.where(state >= 0, _find(at["edges"], state * len(tree.words) + word), -1)
    out = np.where(edge >= 0, at["log_p"][edge] if len(at["log_p"]) else 0.0, 0.0)
    back = np.flatnonzero(edge < 0)
    if len(back):
        rest = np.where(state[back] >= 0, at["log_rest"][state[back]] if len(at["log_rest"]) else 0.0, 0.0)
        shorter = np.where(state[back] >= 0, at["suffix"][state[back]] if len(at["suffix"]) else -1, -1)
        out[back] = rest + _log_p(tree, level - 1, shorter, word[back])
    return out


def _weights(tree: Tables) -> DataFrame:
    """(code, times, kind, known, weight) of all runs that change a score: words, and runs of edges or states.

    kind is 0 for words and 1 for longer runs, known 1 for a word itself, which counts by its times. The
    weights are against what the shorter runs say. A state's rest is a weight of its context, since a
    word always follows one. A code can have two rows, whose weights add up.
    """
    row = lambda df, code, times, kind, known, weight: df.select(F.col(code).alias("code"), F.col(times).alias("times"), F.lit(kind).alias("kind"), F.lit(known).alias("known"), weight.cast("float").alias("weight"))
    out = row(tree.counts, "code", "times", 0, 1, F.lit(0.0))
    for level, (states, edges) in enumerate(tree.levels, 1):
        # log_parent holds the shorter runs' whole score
        out = out.unionByName(row(edges, "code", "times", 1, 0, F.col("log_p") - F.col("log_rest") - F.col("log_parent")))
        out = out.unionByName(row(states, "context", "seen", min(level - 1, 1), 0, F.col("log_rest")))
    return out


def _with_head(weights: DataFrame, most: tuple[int, int]) -> DataFrame:
    """Adds ``head``: the most frequent rows of each kind, at most so many, by whole eighths of a power of two of their times."""
    size = F.floor(F.log2(F.col("times") + F.lit(1)) * 8)
    counts = weights.groupBy("kind", size.alias("size")).count().collect()
    head = F.lit(False)
    for kind, bound in enumerate(most):
        fit, least = 0, None
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r["size"]):
            fit += r["count"]
            if fit > bound:
                break
            least = r["size"]
        if least is not None:
            head = head | ((F.col("kind") == kind) & (size >= least))
    return weights.withColumn("head", head)


def _merged(code: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes, ascending, and the sums of their columns."""
    code, at = np.unique(code, return_inverse=True)
    return code, *(np.bincount(at, x, len(code)) if len(code) else np.zeros(0) for x in columns)


class _Listed:
    """Places of distinct codes, in slots at most half full: a lookup is one or two steps."""

    def __init__(self, code: np.ndarray) -> None:
        self.code, n = code, len(code)
        bits = max(4, (2 * n - 1).bit_length())
        # the slots are made where they are used: they need not travel
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(n, dtype=np.int32), (code >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those not listed."""
        out = np.full(len(codes), -1, np.int64)
        if not len(self.code):
            return out
        left, slot = np.arange(len(codes)), (codes >> self.shift).astype(np.int64)
        while len(left):
            place = self.slots[slot]
            same = self.code[place] == codes[left]
            hit = (place >= 0) & same
            out[left[hit]] = place[hit]
            on = (place >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


_UNSEEN = float(np.log10(0.5))
_LOW = np.uint64((1 << 48) - 1)


def _requests(number: int, code: np.ndarray, at: np.ndarray, size: int, log_buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """(batch, bucket, codes, texts): by the first bits of the codes; of a code its last 48 bits, of a text its place in the batch."""
    if not len(code):
        return []
    bucket = (code >> np.uint64(64 - log_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    low = code[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    at, bucket = at[order].astype(np.uint16 if size <= 1 << 16 else np.uint32), bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(number, int(bucket[a]), low[a:b].tobytes(), at[a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)]


def _answered(requests: DataFrame, tail: DataFrame, log_buckets: int, schema: StructType) -> DataFrame:
    """The texts' rows with what their requests found in the tail table added.

    A request has the codes of one batch of texts whose first bits are its bucket, packed, and the text
    of each; it is answered next to that part of the table. Answers meet again by batch, where the texts'
    rows, packed too, have come the same way. So neither what a task holds nor the number of rows
    depends on how often a code occurs, and the rows of texts go through unchanged.
    """

    def answer(key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        column = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        code, times, weight = _merged(column(given, "code").view(np.uint64) & _LOW, column(given, "times"), column(given, "weight"))
        for batch, codes, at in zip(*(asked.column(c).to_pylist() for c in ("batch", "codes", "texts")), strict=True):
            if codes is None:
                out.append((batch, at, None, None, None))
                continue
            full = np.zeros((len(codes) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(codes, np.uint8).reshape(-1, 6)
            found = _find(code, full.view("<u8").ravel())
            hit = found >= 0
            word = hit & (times[found] > 0) if len(code) else hit
            at = np.frombuffer(at, f"u{len(at) // len(full)}")
            weights = np.where(hit, weight[found], 0.0) if len(code) else np.zeros(len(hit))
            heavy = weights != 0
            parts = (at[heavy].astype(np.uint32 if at.itemsize == 4 else np.uint16), weights[heavy].astype(np.float32), at[word], times[found[word]].astype(np.int64))
            out.append((batch, *(x.tobytes() for x in parts)))
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate((("batch", pa.int64()), *((c, pa.binary()) for c in ("at", "weight", "word", "times"))))})

    def add(key: tuple, answers: pa.Table) -> pa.Table:
        rows, more = None, []
        for at, weight, word, times in zip(*(answers.column(c).to_pylist() for c in ("at", "weight", "word", "times")), strict=True):
            if weight is None:
                rows = pa.ipc.open_stream(at).read_all()
            else:
                more.append((at, weight, word, times))
        n = rows.num_rows
        wide = np.uint16 if n <= 1 << 16 else np.uint32
        joined = [np.frombuffer(b"".join(x), k) for x, k in zip(zip(*more, strict=True), (wide, np.float32, wide, np.int64), strict=True)] if more else [np.zeros(0, np.int64)] * 4
        at, weight, word, times = joined
        root = np.bincount(word, np.log10(times + 0.5) - _UNSEEN, n) if len(word) else np.zeros(n)
        extra = {"n_known": np.bincount(word, minlength=n), "base_score": root, "score": root + (np.bincount(at, weight.astype(float), n) if len(at) else 0)}
        columns = [pa.array(rows.column(c).to_numpy() + extra[c]) if c in extra else rows.column(c) for c in schema.names]
        return pa.table(columns, names=schema.names)

    # of words their times, of others none
    table = tail.select(F.shiftrightunsigned("code", 64 - log_buckets).cast("int").alias("bucket"), "code", (F.col("times") * F.col("known")).alias("times"), "weight")
    answers = requests.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(answer, "batch bigint, at binary, weight binary, word binary, times binary")
    return answers.groupBy("batch").applyInArrow(add, schema)


def score(docs: DataFrame, folds: int = 5, held: int = 1, most_words: int = 1 << 20, most_runs: int = 1 << 20, rounds: int = 2, **options) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id's text, modulo ``folds``, is not ``held``. A null id counts
    as an empty one, a null text as empty (its end alone); repeated rows count each; without training
    rows every word has the one unseen word's probability, 1; an empty table gives no rows. At most
    ``most_words`` words and ``most_runs`` runs are scored from a list, the others by requests to the
    table: this changes the cost, not the scores. Weights of runs are in single precision. Documents are
    scored in ``rounds`` parts, one after the other, so that only one part's requests are on disk.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    base = docs.select("doc_id", (fold == held).alias("held_out"), "text")
    train = base.filter(~F.col("held_out")).select("text")
    counts = written(spark, _word_counts(train), "pst-counts")
    tree = tables(train, counts, **options)
    weights = written(spark, _with_head(_weights(tree), (most_words, most_runs)), "pst-weights")
    freed()
    listed = weights.filter("head").select("code", "times", "kind", "known", "weight").toArrow().combine_chunks()
    code, times, kinds, known, weight = (listed.column(c).to_numpy() for c in ("code", "times", "kind", "known", "weight"))
    lists = []
    for kind in (0, 1):
        of = kinds == kind
        found, count, extra = _merged(code.view(np.uint64)[of], (times * known)[of], weight[of])
        lists.append((found, extra.astype(np.float32), count.astype(np.int64) if kind == 0 else None))
    del listed, code, times, kinds, known, weight
    tail = weights.filter("not head").select("code", "times", "known", "weight")
    n_tail, occurrences = tail.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    log_buckets = buckets_for(occurrences)
    seen = filter_of(tail, "code", size_for(n_tail))
    shared = spark.sparkContext.broadcast((lists, seen))
    freed(*tree.scratch)
    unseen, total_tokens, depth = _UNSEEN - _log_z(tree.total, tree.distinct), tree.total, len(tree.levels)
    schema = base.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, seen = shared.value
        (words, word_weights, times), (runs_, run_weights, _) = lists
        words, runs_ = _Listed(words), _Listed(runs_)
        is_word = times > 0
        roots = np.where(is_word, np.log10(times + 0.5) - _UNSEEN, 0.0)
        made = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches, made):
            size = batch.num_rows
            tokens, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
            root, extra = np.zeros(size), np.zeros(size)
            codes, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi, t in _chunks(batch):
                tokens[lo:hi] = np.diff(t.bounds)
                runs = t.hashes
                for level in range(depth + 1):
                    runs = longer(runs) if level else runs
                    on = np.flatnonzero(t.before >= level)
                    places, weights = (runs_, run_weights) if level else (words, word_weights)
                    asked, doc = runs[on], t.doc[on]
                    place = places.find(asked)
                    hit = place >= 0
                    add = lambda values: np.bincount(doc[hit], values[place[hit]], hi - lo)  # noqa: B023, E731
                    if hit.any():
                        extra[lo:hi] += add(weights)
                        if not level:
                            known[lo:hi] += add(is_word).astype(np.int64)
                            root[lo:hi] += add(roots)
                    other = np.flatnonzero(~hit)
                    other = other[seen.test(asked[other])]
                    codes.append(asked[other])
                    ats.append(doc[other] + lo)
            base_score = root + unseen * tokens
            columns = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (tokens, known, np.full(size, total_tokens, np.int64), base_score, base_score + extra))]
            rows = pa.RecordBatch.from_arrays(columns, names=schema.names)
            packed = pa.BufferOutputStream()
            with pa.ipc.new_stream(packed, rows.schema) as stream:
                stream.write_batch(rows)
            out = _requests(number, np.concatenate(codes), np.concatenate(ats), size, log_buckets)
            out.append((number, number % (1 << log_buckets), None, packed.getvalue().to_pybytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["batch", "bucket", "codes", "texts"])
            out = codes = ats = None
        given_back()

    parts = []
    for turn in range(rounds):
        some = base.filter(F.pmod(F.hash("doc_id", F.length("text")), F.lit(rounds)) == turn)
        requests = some.mapInArrow(walk, "batch bigint, bucket int, codes binary, texts binary")
        parts.append(written(spark, _answered(requests, tail, log_buckets, schema), f"pst-scores{turn}"))
        del requests
        freed()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
