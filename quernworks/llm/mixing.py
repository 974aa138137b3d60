"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled (ordered by a seeded hash) and laid end to end; every
``block_words`` words of that row make a block. The schedule's slot j has the golden-ratio point
frac(j * phi), which falls into one source's interval of the cumulated weights; the r-th slot of a
source takes its block r, beginning again after the last, until the source's target is reached. Slots
that the finite schedule falls short of a target (its discrepancy, some log of its length) come last.

All ranks and positions are sums over bounded pieces: of at most 65,536 slots, and of hash ranges of
a source of about 512 documents; sums of pieces are added up 4096 at a time. So a source that holds
most rows is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .textops import SPACE

WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fraction in units of 2**-31, odd, so that the points of a period all differ.
_PHI, _PERIOD = 1327217885, 1 << 31
_CELLS = 4096
_SLOTS_A_CHUNK = 1 << 16
_DOCS_A_BUCKET = 512


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _offsets(sums: DataFrame, at: str, value: str) -> DataFrame:
    """Adds ``offset``: the sum of ``value`` over the source's rows with a lesser ``at``; 4096 of them are summed up in one place, then their sums."""
    rows = sums.withColumn("high", F.shiftright(at, 12))
    before = lambda c, by, order: F.coalesce(F.sum(c).over(_before(Window.partitionBy(*by).orderBy(order))), F.lit(0))
    tops = rows.groupBy("sid", "high").agg(F.sum(value).alias("all")).withColumn("base", before("all", ["sid"], "high")).drop("all")
    rows = rows.withColumn("inner", before(value, ["sid", "high"], at)).join(tops, ["sid", "high"])
    return rows.withColumn("offset", F.col("base") + F.col("inner")).drop("high", "base", "inner")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0) -> DataFrame:
    """One row per source: sid (its rank by code point, null last), source_size, weight, target.

    Targets share the sum of all sizes by weight; one over ``ceiling`` times its source's size stops
    there, and the excess is shared by weight among the others until none is above. That is the level
    L with target = min(ceiling * size, L * weight): sources are capped in ascending order of
    ceiling * size / weight for as long as the level of the rest is at least that.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights)))
    per = per.withColumn("cap", ceiling * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = everything.orderBy("ratio", "sid")
    sums = lambda c: F.sum(c).over(everything) - F.coalesce(F.sum(c).over(_before(order)), F.lit(0.0))
    per = per.withColumn("place", F.row_number().over(order))
    spent = F.coalesce(F.sum("cap").over(_before(order)), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - spent) / sums("weight"))
    per = per.withColumn("capped", F.col("level") >= F.col("ratio"))
    free = lambda c: F.when(~F.col("capped"), F.col(c))
    shared = F.min_by(free("level"), free("place")).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("weight"))
    return per.select("sid", "source", "source_size", "weight", target.alias("target"))


def _slots(sources: DataFrame, block_words: int) -> DataFrame:
    """(sid, block, part, pass_): the slots of the schedule; part: words taken of the block, slot: its place."""
    spark = sources.sparkSession
    goal = F.least(F.round("target").cast("bigint"), 3 * F.col("source_size"))
    plan = sources.withColumn("goal", goal).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("bigint")).filter("goal > 0")
    whole = F.expr("goal div source_size")
    plan = plan.withColumn("need", whole * F.col("blocks") + F.ceil((F.col("goal") - whole * F.col("source_size")) / block_words).cast("bigint"))
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    share = lambda c: F.floor(c / F.sum("need").over(Window.partitionBy(F.lit(0))) * _PERIOD).cast("bigint")
    low = F.coalesce(F.sum("need").over(_before(order)), F.lit(0))
    plan = plan.withColumn("lo", share(low)).withColumn("hi", share(low + F.col("need")))
    plan = written(spark, plan.select("sid", "source_size", "goal", "blocks", "need", "lo", "hi"), "mix-plan")
    total = plan.agg(F.sum("need")).first()[0] or 0
    width = _PERIOD // _CELLS
    cells = plan.filter("hi > lo").select("sid", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(_PERIOD)) * _PHI, F.lit(_PERIOD)).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    hits = points.join(written(spark, cells, "mix-cells"), "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    hits = hits.select("sid", "slot", F.expr(f"slot div {_SLOTS_A_CHUNK}").alias("chunk"))
    counts = hits.groupBy("sid", "chunk").count()
    counts = written(spark, counts, "mix-counts")
    offsets = _offsets(counts, "chunk", "count")
    inner = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hits.withColumn("inner", inner).join(offsets.drop("count"), ["sid", "chunk"]).select("sid", "slot", (F.col("offset") + F.col("inner")).alias("rank"))
    got = plan.join(counts.groupBy("sid").agg(F.sum("count").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = got.filter("got < need").select("sid", F.lit(total).cast("bigint").alias("slot"), F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    slots = ranked.unionByName(late).join(plan.select("sid", "source_size", "goal", "blocks", "need"), "sid").filter("rank < need")
    slots = slots.withColumn("block", F.expr("rank % blocks")).withColumn("round", F.expr("rank div blocks"))
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    taken = F.col("round") * F.col("source_size") + F.col("block") * block_words
    return slots.select("sid", "block", "slot", "round", length.alias("length"), F.least(length, F.col("goal") - taken).alias("part"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block_words: int = 1024, seed: int = 17) -> DataFrame:
    """What the mix takes of each document: doc_id, tie (hash of its text), source, size, source_size, target, taken.

    Sizes are words. A source's taken words sum up to its target, rounded; no document's are over three
    times its size, as no target is over three times its source. Null or empty texts have size 0 and
    give nothing; a null source is a source; repeated rows count each; an empty table gives no rows.
    Reruns agree: the shuffle is by hash, ties in it by id and text.
    """
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), word_count(F.col("text")).alias("size"))
    sizes = written(spark, sizes.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "tie")), "mix-sizes")
    sources = written(spark, source_targets(sizes, weights), "mix-sources")
    rows = sizes.count()
    bits = max(0, min(40, (rows // _DOCS_A_BUCKET).bit_length()))
    placed = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("doc_id", "tie", "d.source", "size", "source_size", "target", "sid", "at", F.shiftrightunsigned("at", 64 - bits).alias("bucket") if bits else F.lit(0).cast("bigint").alias("bucket"))
    full = placed.filter("size > 0")
    sums = full.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = _offsets(written(spark, sums, "mix-buckets"), "bucket", "words").drop("words")
    inner = F.coalesce(F.sum("size").over(_before(Window.partitionBy("sid", "bucket").orderBy("at", "doc_id", "tie"))), F.lit(0))
    laid = full.withColumn("inner", inner).join(sums, ["sid", "bucket"]).withColumn("a", F.col("offset") + F.col("inner")).drop("inner", "offset", "bucket", "at")
    blocks = laid.withColumn("block", F.explode(F.expr(f"sequence(a div {block_words}, (a + size - 1) div {block_words})")))
    uses = _slots(sources, block_words).groupBy("sid", "block").agg(
        F.count(F.when(F.col("part") == F.col("length"), 1)).alias("whole"),
        F.coalesce(F.max(F.when(F.col("part") < F.col("length"), F.col("part"))), F.lit(0)).alias("part"),
    )
    met = blocks.join(uses, ["sid", "block"])
    x = F.greatest(F.col("a") - F.col("block") * block_words, F.lit(0))
    y = F.least(F.col("a") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    met = met.withColumn("words", F.col("whole") * (y - x) + F.greatest(F.least(y, F.col("part")) - x, F.lit(0)))
    taken = met.groupBy("sid", "a").agg(F.sum("words").alias("taken"))
    out = laid.join(taken, ["sid", "a"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    columns = ["doc_id", "tie", "source", "size", "source_size", "target", "taken"]
    return out.select(columns).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as it is taken whole, then its first words taken once more.

    Columns as in ``docs``, whatever their names; the last row of a document may be a beginning of its
    text, with n_chars to match where there is that column. Rows of which nothing is taken go, so those
    of null or empty texts do. Rows of equal id and text count as one document of all their words, with
    the other columns of one of them; a null id or source is a value; an empty table gives no rows.
    """
    found = mix(docs, **options).groupBy("doc_id", "tie").agg(F.sum("taken").alias("__q_taken"), F.first("size").alias("__q_size"), F.count(F.lit(1)).alias("__q_many")).filter("__q_taken > 0")
    found = written(docs.sparkSession, found.withColumnsRenamed({"doc_id": "__q_id", "tie": "__q_tie"}), "mix-taken")
    rows = docs.withColumn("__q_at", F.xxhash64("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__q_id")) & (F.col("__q_at") == F.col("__q_tie"))).drop("__q_id")
    extra = ["__q_taken", "__q_size"]
    one = F.max_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__q_row")
    repeated = rows.filter("__q_many > 1").groupBy("doc_id", "__q_tie").agg(one, *[F.first(c).alias(c) for c in extra]).select("__q_row.*", *extra)
    rows = rows.filter("__q_many = 1").select(*docs.columns, *extra).unionByName(repeated)
    rows = rows.withColumn("__q_copy", F.explode(F.expr("sequence(0, (__q_taken - 1) div __q_size)")))
    rows = rows.withColumn("__q_words", F.least(F.col("__q_taken") - F.col("__q_copy") * F.col("__q_size"), F.col("__q_size"))).drop("__q_taken", "__q_copy")
    schema = docs.schema
    counted = "n_chars" in schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, words = batch.column("__q_size").to_numpy(), batch.column("__q_words").to_numpy()
            columns = {n: batch.column(n) for n in schema.fieldNames()}
            short = np.flatnonzero(words < size)
            if len(short):
                texts = columns["text"].to_pylist()
                for i in short:
                    raw = np.frombuffer(texts[i].encode(), np.uint8)
                    full = ~SPACE[raw]
                    ends = np.flatnonzero(full & ~np.append(full[1:], False)) + 1
                    texts[i] = raw[: ends[words[i] - 1]].tobytes().decode()
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
                if counted:
                    kind = batch.schema.field("n_chars").type
                    values = columns["n_chars"].to_pylist()
                    for i in short:
                        values[i] = len(texts[i])
                    columns["n_chars"] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(cut, schema)
