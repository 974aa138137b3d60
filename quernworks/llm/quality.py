"""Quality rules: simple statistics of each text, and robust multivariate outliers among them.

The verdict is by minimum covariance determinant: for each language and source, the mean and
covariance of those three quarters of its documents whose covariance has the least determinant. They
are sought from three deterministic starts (medians and median deviations; mean and covariance of all;
medians and the covariance of directions from them) by concentration steps, each taking the documents
closest to the last estimate, until the determinant falls no more; the least of the three counts.
Documents far beyond, by Mahalanobis distance, are rejected.

A concentration step is two aggregations by group, a mergeable quantile summary of distances and the
sums of first and second moments, so all documents count and no group's rows meet in one task. The
groups and starts that are still falling are stepped together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized, written
from .textops import SPACE, Words, chunks, given_back, hash_slices, lines, mix, text_buffer, windows

REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats"]
#: Least standard deviation of each feature: a smaller one counts as this. In a group without any spread, the
#: limit of ``judge`` is then about a quarter duplicate lines or repeated words, and 2.3 % symbols.
FLOORS = [0.5, 0.1, 0.03, 0.1, 0.1]
#: Least variance along any direction, in units of the floors, so that features which go together can be inverted.
_LEAST_EIGEN = 0.05
_N = len(FEATURES)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def _chunk_statistics(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    words = Words(buf, offs)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flag), offs))

    chars = per_text(((buf & 0xC0) != 0x80) & ~SPACE[buf])
    starts, ends, per_line = lines(buf, offs)
    doc = np.repeat(np.arange(n), per_line)
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    keys = hash_slices(buf, starts[full], (ends - starts)[full])
    order = np.lexsort((keys, doc[full]))
    sorted_lines, sorted_docs = keys[order], doc[full][order]
    again = (sorted_lines[1:] == sorted_lines[:-1]) & (sorted_docs[1:] == sorted_docs[:-1])
    dup_lines = np.bincount(sorted_docs[1:][again], minlength=n)
    # words in windows found twice or more in their text
    runs = windows(words.hashes(), REPEAT_WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(runs):
        at = np.flatnonzero(words.left()[: len(runs)] >= REPEAT_WINDOW)
        at = at[_repeated(mix(runs[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))))]
        edge = np.zeros(len(words.doc) + REPEAT_WINDOW + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + REPEAT_WINDOW, -1)
        repeat = np.bincount(words.doc[np.cumsum(edge)[: len(words.doc)] > 0], minlength=n)
    return [words.count, chars, per_text(_SYMBOL[buf]), per_line, dup_lines, repeat]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, tie (a hash of the text) and the statistics of each text; null is empty."""
    source = docs.select(*keep, F.xxhash64("text").alias("tie"), "text")
    schema = source.drop("text").schema
    for name in STATISTICS:
        schema = schema.add(name, "long", False)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            parts = [_chunk_statistics(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in chunks(offs)]
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "tie"]), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, "tie", *STATISTICS])
            buf = offs = parts = columns = batch = None
        given_back()

    return source.mapInArrow(measure, schema)


def _features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, total: F.sqrt(F.col(c) / F.greatest(F.col(total), F.lit(1)))
    return [
        F.log1p("n_words").alias("f_words"),
        F.log((F.col("word_chars") + 1) / words).alias("f_word_length"),
        share("n_symbols", "word_chars").alias("f_symbols"),
        share("n_dup_lines", "n_lines").alias("f_dup_lines"),
        share("n_repeat_words", "n_words").alias("f_repeats"),
    ]


def chi_square_below(x: float, k: int) -> float:
    """P(X <= x) for k degrees of freedom: the series of the regularised lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _distance() -> Column:
    gap = [F.col(f) - F.get("mean", F.lit(i)) for i, f in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * gap[i] * gap[j] * F.get("inverse", F.lit(i * _N + j)) for i in range(_N) for j in range(i, _N)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with the floors as least variances."""
    unit = cov / np.outer(FLOORS, FLOORS)
    unit = unit + np.diag(np.maximum(1 - np.diag(unit), 0))
    values, vectors = np.linalg.eigh(unit)
    return (vectors * np.maximum(values, _LEAST_EIGEN)) @ vectors.T * np.outer(FLOORS, FLOORS)


def _moments(of: list[Column], name: str) -> list[Column]:
    """Sums of the columns and of their products, as columns name_i and name_i_j."""
    sums = [F.sum(x).alias(f"{name}_{i}") for i, x in enumerate(of)]
    return sums + [F.sum(of[i] * of[j]).alias(f"{name}_{i}_{j}") for i in range(_N) for j in range(i, _N)]


def _covariance(row: dict, name: str, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    n = max(row["n"], 1)
    mean = np.array([row[f"{name}_{i}"] for i in range(_N)]) / n
    cov = np.zeros((_N, _N))
    for i in range(_N):
        for j in range(i, _N):
            cov[i, j] = cov[j, i] = row[f"{name}_{i}_{j}"] / n - (mean[i] * mean[j] if centred else 0)
    return mean, cov


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """The mean, the inverse of the floored covariance, and the logarithm of its determinant."""
    cov = _floored(cov)
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


_ESTIMATES = "gid string, start int, mean array<double>, inverse array<double>, log_det double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["gid", "start", "mean", "inverse", "log_det"])


def _starts(wide: DataFrame) -> DataFrame:
    """Three estimates of each group. Their determinants are not those of a subset, so they are infinite."""
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    centre = sized(written(wide.sparkSession, wide.groupBy("gid").agg(*[middle(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]), "mcd-median"))
    near = wide.join(centre, "gid")
    spread = near.groupBy("gid").agg(*[middle(F.abs(F.col(f) - F.col(f"m_{i}"))).alias(f"d_{i}") for i, f in enumerate(FEATURES)])
    near = near.join(sized(written(wide.sparkSession, spread, "mcd-spread")), "gid")
    z = [(F.col(f) - F.col(f"m_{i}")) / F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FLOORS[i])) for i, f in enumerate(FEATURES)]
    near = near.withColumns({f"z_{i}": x for i, x in enumerate(z)})
    length = F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, _N)), F.col("z_0") * F.col("z_0")))
    near = near.withColumn("away", F.greatest(length, F.lit(1e-12)))
    known = [F.first(f"{c}_{i}").alias(f"{c}_{i}") for c in "md" for i in range(_N)]
    sums = near.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), *known, *_moments([F.col(f) for f in FEATURES], "x"), *_moments([F.col(f"z_{i}") / F.col("away") for i in range(_N)], "u"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                median = np.array([row[f"m_{i}"] for i in range(_N)])
                scale = np.maximum([1.4826 * row[f"d_{i}"] for i in range(_N)], FLOORS)
                turned = _covariance(row, "u", False)[1] * np.outer(scale, scale) * _N
                for start, (mean, cov) in enumerate([(median, np.diag(scale**2)), _covariance(row, "x", True), (median, turned)]):
                    out.append((row["gid"], start, *_estimate(mean, cov)[:2], math.inf))
            yield _frame(out)

    return sums.mapInPandas(solve, _ESTIMATES)


def concentrated(wide: DataFrame, share: float = 0.75, most_steps: int = 20) -> DataFrame:
    """(gid, mean, inverse): the estimate of least determinant of each group; ``wide`` has gid and FEATURES.

    A step that does not lower the logarithm of the determinant by at least 0.001 (the quantile summary
    is exact to a thousandth) ends its start, which keeps the lower one; so do ``most_steps`` steps.
    """
    spark = wide.sparkSession
    scale = share / chi_square_below(chi_square_quantile(share, _N), _N + 2)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.to_dict("records"):
                mean, cov = _covariance(row, "x", True)
                made.append((row["gid"], row["start"], *_estimate(mean, cov * scale)))
            yield _frame(made)

    going, ended = written(spark, _starts(wide), "mcd-start"), []
    for step in range(most_steps):
        near = wide.join(sized(going), "gid").withColumn("distance", _distance()).select("gid", "start", "distance", *FEATURES)
        bound = sized(written(spark, near.groupBy("gid", "start").agg(F.percentile_approx("distance", share, 1000).alias("bound")), f"mcd-bound{step}"))
        inner = near.join(bound, ["gid", "start"]).filter("distance <= bound")
        sums = inner.groupBy("gid", "start").agg(F.count(F.lit(1)).alias("n"), *_moments([F.col(f) for f in FEATURES], "x"))
        old = going.select("gid", "start", F.struct("mean", "inverse", "log_det").alias("old"))
        new = sums.mapInPandas(solve, _ESTIMATES).join(old, ["gid", "start"])
        falls = F.col("log_det") < F.col("old.log_det") - 1e-3
        best = lambda c: F.when(falls, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c)
        new = written(spark, new.select("gid", "start", best("mean"), best("inverse"), best("log_det"), falls.alias("falls")), f"mcd-step{step}")
        ended.append(new.filter("not falls").drop("falls"))
        left = new.filter("falls").drop("falls")
        left._scratch = new._scratch
        going = left
        if going.isEmpty():
            break
    ended.append(going)
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return written(spark, out.groupBy("gid").agg(F.min_by(F.struct("mean", "inverse"), F.struct("log_det", "start")).alias("best")).select("gid", "best.*"), "mcd-best")


def robust_distances(rows: DataFrame, least_rows: int = 200, **options) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance from the row's group; rows have FEATURES, lang, source.

    Groups are language and source; those of under ``least_rows`` documents are judged with all of their
    language, or where that is small too, with all documents. Null language or source is a value.
    """
    spark = rows.sparkSession
    word = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = rows.withColumn("g2", F.concat(word("lang"), F.lit("\x01"), word("source"))).withColumn("g1", word("lang"))
    sizes = rows.groupBy("g2", "g1").agg(F.count(F.lit(1)).alias("n2"))
    langs = sizes.groupBy("g1").agg(F.sum("n2").alias("n1"))
    groups = sizes.join(langs, "g1").select("g2", F.when(F.col("n2") >= least_rows, F.concat(F.lit("2"), F.col("g2"))).when(F.col("n1") >= least_rows, F.concat(F.lit("1"), F.col("g1"))).otherwise(F.lit("0")).alias("gid"))
    groups = written(spark, groups, "mcd-groups")
    named = rows.join(sized(groups), "g2").drop("g2", "g1")
    # a small group is judged with all of its language, so the larger group's estimates use all its rows
    wide = rows.select("g1", "g2", *FEATURES).withColumn("gid", F.explode(F.array(F.concat(F.lit("2"), F.col("g2")), F.concat(F.lit("1"), F.col("g1")), F.lit("0")))).drop("g1", "g2")
    used = sized(written(spark, groups.select("gid").distinct(), "mcd-used"))
    found = concentrated(wide.join(used, "gid"), **options)
    return named.join(sized(found), "gid").withColumn("distance", _distance()).drop("mean", "inverse", "gid")


def judge(docs: DataFrame, least_words: int = 20, most_repeats: int = 30, tail: float = 1e-4, **options) -> DataFrame:
    """The statistics of each document with base_failed, distance and kept.

    base_failed: under ``least_words`` words, or over ``most_repeats`` percent of words in repeated
    windows. kept: not base_failed, and the distance is within the chi-square quantile that a share
    ``tail`` of regular documents exceeds. Null texts are empty and fail; repeated rows count each and
    are judged alike; an empty table gives no rows.
    """
    base = statistics(docs, ["doc_id", "lang", "source"])
    base = written(docs.sparkSession, base.select("*", *_features()), "quality")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = base.withColumn("base_failed", failed)
    fit = robust_distances(rows, **options)
    limit = chi_square_quantile(1 - tail, _N)
    return fit.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit)).drop(*FEATURES)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects, whatever the names of its other columns."""
    out = judge(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__q_id"), F.col("tie").alias("__q_tie")).distinct()
    out = sized(written(docs.sparkSession, out, "quality-rejected"))
    rows = docs.withColumn("__q_at", F.xxhash64("text"))
    return rows.join(out, F.col("doc_id").eqNullSafe(F.col("__q_id")) & (F.col("__q_at") == F.col("__q_tie")), "left_anti").drop("__q_at")
