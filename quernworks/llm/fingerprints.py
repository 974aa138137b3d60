"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the ascending list of the k smallest distinct hashes of a text's shingles of five words
(52-bit hashes; with fewer words the whole sequence is one shingle; no word, no hash). Sketches of
parts merge into the sketch of the union, and estimate resemblance, containment and the number of
distinct shingles. Sketches shorter than k hold all hashes, and their estimates are exact.
"""

from __future__ import annotations

import json
from collections import Counter
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
K = 128
_SPAN = 1 << 52
_LAST = (1 << 63) - 1


def word_hashes(text: Column) -> Column:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, shingle: int = SHINGLE) -> Column:
    """52-bit hashes of all runs of ``shingle`` words; ``hashes`` must be a plain column."""
    n = F.size(hashes)
    runs = F.transform(
        F.slice(hashes, 1, F.greatest(n - (shingle - 1), F.lit(0))),
        lambda h, i: F.shiftrightunsigned(F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, shingle)]), 12),
    )
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.lit(0), hashes), 12))
    return F.when(n >= shingle, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Adds the sketch of column ``text`` as array<bigint> ``out``; null counts as empty.

    Only hashes under a bound that about 4k of them pass are sorted; where fewer than k distinct ones
    pass (many repeats), all are. Each step is a column of its own, so that none is computed twice.
    """
    steps = df.withColumn("_wh", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    steps = steps.withColumn("_sh", shingle_hashes(F.col("_wh"), shingle)).drop("_wh")
    bound = (F.lit(float(_SPAN)) * (4.0 * k) / F.greatest(F.size("_sh"), F.lit(1))).cast("bigint")
    steps = steps.withColumn("_cut", bound).withColumn("_few", _smallest(F.filter("_sh", lambda h: h < F.col("_cut")), k))
    enough = (F.size("_few") >= k) | (F.size("_sh") <= 4 * k)
    return steps.withColumn(out, F.when(enough, F.col("_few")).otherwise(_smallest(F.col("_sh"), k))).drop("_sh", "_cut", "_few")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def with_resemblance(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Adds the estimate of |A n B| / |A u B| from sketch columns a and b; 1 for two empty sets, 0 for one."""
    steps = df.withColumn("_u", merged(F.col(a), F.col(b), k)).withColumn("_i", F.array_intersect(a, b))
    share = F.size(F.array_intersect("_u", "_i")) / F.greatest(F.size("_u"), F.lit(1))
    return steps.withColumn(out, F.when(F.size("_u") == 0, F.lit(1.0)).otherwise(share)).drop("_u", "_i")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact under k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(_SPAN)) / F.get(a, F.lit(k - 1)))


def with_containment(df: DataFrame, a: str, b: str, out: str, k: int = K) -> DataFrame:
    """Adds the estimate of |A n B| / |A|, 0 to 1; 1 for an empty A."""
    steps = with_resemblance(df, a, b, "_r", k).withColumn("_m", merged(F.col(a), F.col(b), k))
    shared = F.col("_r") * distinct_shingles(F.col("_m"), k) / F.greatest(distinct_shingles(F.col(a), k), F.lit(1.0))
    return steps.withColumn(out, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared))).drop("_r", "_m")


def merge_parts(df: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """The merged sketch of all rows of each key, in two steps: first within ``salts`` shares of a key.

    Each step explodes to at most k hashes a row and keeps the k smallest distinct ones, counted by
    distinct values, so no key's rows meet in one place before they have been reduced.
    """
    # an inner explode would have its sketches not empty by a filter below them, which computes them once more an element
    rows = df.select(*keys, F.explode_outer(sketch).alias("_h")).filter("_h is not null").distinct()
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_h"))).filter(F.col("_r") <= k)
    out = ranked.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))
    return df.select(*keys).distinct().join(out, keys, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def as_text(sketch: Column) -> Column:
    """A sketch as text: lower-case hexadecimal hashes with commas between."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.hex(h)), ","))


def _listed(pairs: list[tuple[int, int]], step: int) -> Column:
    """Pairs of key and tie as one constant: lists of ``step`` each."""
    lists = [[{"k": k, "t": t} for k, t in pairs[i : i + step]] for i in range(0, len(pairs), step)]
    return F.from_json(F.lit(json.dumps(lists)), "array<array<struct<k:bigint,t:bigint>>>")


def range_of(key: Column, tie: Column, starts: list[tuple[int, int]]) -> Column:
    """The index of the range that holds (key, tie), by its start: a search in two steps over ascending starts; -1 before all."""
    step = max(1, ceil(sqrt(len(starts))))
    here = F.struct(key.alias("k"), tie.alias("t"))
    below = lambda cuts, of: F.size(F.filter(cuts, lambda c: of(c) <= here)) - 1
    lists = _listed(starts, step)
    part = F.greatest(below(lists, lambda c: F.get(c, F.lit(0))), F.lit(0))
    return (part * step + below(F.get(lists, part), lambda c: c)).cast("int")


def range_starts(rows: DataFrame, rows_per_range: int, most: int) -> list[tuple[int, int]]:
    """The first (key, tie) of each of about as many ranges as the rows need, at most ``most``, ascending.

    Cuts between keys come from a mergeable quantile summary. A key that fills several ranges is cut by
    its ties, which are hashes. Then the first row of each range is looked up, so a start is always a row.
    """
    n, least = rows.agg(F.count(F.lit(1)), F.min("key")).first()
    if not n:
        return []
    want = min(most, max(1, ceil(n / rows_per_range)))
    cuts = [least]
    if want > 1:
        cuts += rows.agg(F.percentile_approx("key", [i / want for i in range(1, want)], 20 * want)).first()[0]
    times = Counter(cuts)
    tie = lambda i, of: -(1 << 63) + (1 << 64) * i // of
    pairs = sorted((k, tie(i, m)) for k, m in times.items() for i in range(m))
    firsts = rows.groupBy(range_of(F.col("key"), F.col("tie"), pairs).alias("range")).agg(F.min(F.struct("key", "tie")).alias("first"))
    return sorted((r.first.key, r.first.tie) for r in firsts.select("first").collect())


def fingerprint_edits(docs: DataFrame, k: int = K, rows_per_range: int = 2048, most_ranges: int = 1 << 16) -> DataFrame:
    """Fingerprints each document and its edited text, and compares it with that and the next document.

    The edited text has the last quarter replaced by the first as many code points of the next
    document by ascending doc_id, after the last the first. Documents go once to ranges of doc_id;
    the first document of each range also goes, as a guard row, to the end of the range before.
    Null texts are empty, null ids come last, equal ids are ordered by the hash of their text, and
    split by it where they are many; an empty table gives no rows. Other columns are not used. At most
    ``most_ranges`` ranges are made, and their starts come to the driver; ranges grow beyond that.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tie", F.xxhash64("text"))
    starts = range_starts(base.select("key", "tie"), rows_per_range, most_ranges) or [(0, 0)]
    at = base.withColumn("bucket", range_of(F.col("key"), F.col("tie"), starts))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guard"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(starts))).alias("b"), F.lit(True).alias("guard"))
    step = max(1, ceil(sqrt(len(starts))))
    start = F.get(F.get(_listed(starts, step), F.expr(f"bucket div {step}").cast("int")), F.col("bucket") % step)
    is_start = start == F.struct(F.col("key").alias("k"), F.col("tie").alias("t"))
    at = at.withColumn("to", F.explode(F.when(is_start, F.array(own, before)).otherwise(F.array(own))))
    at = at.select("key", "text", F.col("to.b").alias("bucket"), F.col("to.guard").alias("guard"), "tie")
    order = Window.partitionBy("bucket").orderBy("guard", "key", "tie")
    near = at.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    near = near.withColumn("edited", F.when(F.col("guard"), F.lit("")).otherwise(F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), cut))))
    near = with_sketch(with_sketch(near, "text", "sketch", k=k), "edited", "edited_sketch", k=k)
    near = near.withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("guard"))
    near = with_resemblance(near, "sketch", "edited_sketch", "near_edited", k)
    near = with_resemblance(near, "sketch", "next_sketch", "near_next", k)
    return near.select(
        F.nullif(F.col("key"), F.lit(_LAST)).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
