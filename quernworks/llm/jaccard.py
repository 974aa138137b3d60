"""N-gram Jaccard join and its components, exact, by prefixes of tokens and of token combinations.

A document's set is its distinct shingles. All sets are ordered by one order: tokens that no other set
holds, rare ones, then frequent ones by classes of their frequency, within each by hash. Two linked
sets of x and y tokens differ in few, so what they share must begin early in that order:

- Rare tokens are indexed singly, in the prefix of n - ceil(t n) + 1 tokens: the first shared token of a
  pair stands there in both sets.
- Frequent tokens are indexed in combinations of two neighbours, in an extended prefix. If a pair shares
  no rare token, all its rare tokens are errors; r of x's own and at most E = n (1 - t) / t in all. The
  frequent tokens of both, merged, have at most E - r errors, and as t is at least 0.75 at least so many
  shared tokens and two more; so two shared tokens are neighbours among the first 2 (E - r) + 2, with
  nothing between them in either set. That makes a number of keys linear in the set, for every set.

Which tokens are rare only decides the order: the counts are exact but for hash collisions, and what
goes to the executors of them, a Bloom filter of stated size and a list of at most MOST_FREQUENT tokens,
may be coarse without harm to the result.

Equal sets are one class. A place in the order bounds what a pair can share, and pairs that could not
link by it are never made. The classes that share a key are not all compared with each other: all are
verified against one, the hub, which has the fewest tokens of its own; classes that end up in the hub's
component need no more, and the others are compared with those of other components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freed, sized, written
from .bloom import Filter, filter_of, size_for
from .components import component_labels
from .tally import buckets_for, counted, cut
from .textops import Words, chunks, given_back, join2, mix, text_buffer, windows

LAST = (1 << 63) - 1
SHINGLE = 5
#: Tokens of at least so many sets are frequent, or of more, where there are more than MOST_FREQUENT of them.
FREQUENT = 16
MOST_FREQUENT = 1 << 20


class ShingleSets:
    """The distinct shingle hashes of a chunk of texts: of text i tokens[bounds[i]:bounds[i+1]], ascending."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> None:
        words = Words(buf, offs, lower=True)
        h = words.hashes()
        n = len(offs) - 1
        runs = windows(h, k)
        at = np.flatnonzero(words.left()[: len(runs)] >= k)
        docs, tokens = [words.doc[at]], [runs[at]]
        for few in range(1, k):
            some = np.flatnonzero(words.count == few)
            if len(some):
                docs.append(some)
                tokens.append(windows(h, few)[words.bounds[some]])
        doc, token = np.concatenate(docs), np.concatenate(tokens)
        order = np.argsort(token)
        small = doc[order].astype(np.uint16 if n < 65536 else np.int64)
        order = order[np.argsort(small, kind="stable")]
        doc, token = doc[order], token[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
        self.doc, self.tokens = doc[new], token[new]
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        self.size = np.diff(self.bounds)
        sums = np.zeros(len(self.tokens) + 1, np.uint64)
        np.cumsum(mix(self.tokens.copy()), out=sums[1:])
        total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        #: The class of a set; 0 for the empty set alone.
        self.sig = np.where(self.size > 0, mix(total + self.size.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)

    def first_of_class(self) -> np.ndarray:
        """Texts that are the first of their class here, without the empty set."""
        _, at = np.unique(self.sig, return_index=True)
        at.sort()
        return at[self.size[at] > 0]

    def of(self, texts: np.ndarray) -> np.ndarray:
        """Which tokens are of the given texts."""
        pick = np.zeros(len(self.size), bool)
        pick[texts] = True
        return pick[self.doc]


class Order:
    """Classes of tokens: 0 for those no other set holds, 1 for rare ones, more for frequent ones."""

    def __init__(self, log_buckets: int, shared: Filter, codes: np.ndarray, levels: np.ndarray) -> None:
        self.log_buckets, self.shared, self.codes, self.levels = log_buckets, shared, codes, levels

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        code = cut(tokens, self.log_buckets)
        some = np.flatnonzero(self.shared.test(code))
        out[some] = 1
        if len(self.codes):
            code = code[some]
            at = np.searchsorted(self.codes, code)
            at[at == len(self.codes)] = 0
            hit = self.codes[at] == code
            out[some[hit]] = 1 + self.levels[at[hit]]
        return out


def index_keys(sets: ShingleSets, texts: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, rare, place): keys of the given texts' sets, each text's tokens before its frequent ones, and the key's place.

    A key of one token has a place before ``rare``, one of two tokens has a place from it on.
    """
    keep = sets.of(texts)
    doc, token = sets.doc[keep], sets.tokens[keep]
    kind = order.classes(token)
    size = sets.size
    fresh = np.bincount(doc[kind == 0], minlength=len(size))
    rare = fresh + np.bincount(doc[kind == 1], minlength=len(size))
    single = size - -(-size * percent // 100) + 1
    errors = size * (100 - percent) // percent
    keep = (kind > 0) & (fresh <= np.maximum(single, errors))[doc]
    doc, token, kind = doc[keep], token[keep], kind[keep]
    at = np.lexsort((token, kind, doc))
    doc, token, kind = doc[at], token[at], kind[at]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc) + fresh[doc]
    alone = np.flatnonzero((kind == 1) & (place < single[doc]))
    paired = np.flatnonzero((kind[:-1] > 1) & (doc[:-1] == doc[1:]) & ((place - rare[doc])[:-1] <= 2 * (errors - rare)[doc][:-1]))
    at = np.concatenate([alone, paired])
    keys = np.concatenate([token[alone], join2(token[paired], token[paired + 1])])
    return doc[at], keys, rare[doc[at]], place[at]


def _each_chunk(base: DataFrame, schema: str, make: Callable[[ShingleSets, dict], pa.RecordBatch | None]) -> DataFrame:
    """Runs make(sets, columns of the chunk) over all chunks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for lo, hi in chunks(offs):
                sets = ShingleSets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield make(sets, {c: batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "text"})
            buf = offs = sets = batch = None
        given_back()

    return base.mapInArrow(run, schema)


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _class_tokens(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The tokens of the classes of a chunk; a copy of a text in another chunk counts again."""
    sets = ShingleSets(buf, offs)
    return sets.tokens[sets.of(sets.first_of_class())]


def token_order(texts: DataFrame, n_tokens: int, frequent: int = FREQUENT, most: int = MOST_FREQUENT) -> Order:
    """The order of tokens, from exact counts: a Bloom filter of those shared, and a list of at most ``most`` frequent ones."""
    log_buckets = buckets_for(n_tokens)
    counts = written(texts.sparkSession, counted(texts, _class_tokens, log_buckets), "jaccard-tokens")
    level = F.floor(F.log2("times")).cast("int")
    steps = counts.filter(F.col("times") >= frequent).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    fit, least = 0, None
    for at, n in steps:
        fit += n
        if fit > most:
            break
        least = at
    head = counts.filter((F.col("times") >= frequent) & (level >= least)) if least is not None else counts.limit(0)
    head = head.select("code", level.alias("level")).toArrow().combine_chunks()
    codes, levels = head.column("code").to_numpy().view(np.uint64), head.column("level").to_numpy().astype(np.int64)
    at = np.argsort(codes)
    order = Order(log_buckets, filter_of(counts, "code", size_for(counts.count(), 8)), codes[at], levels[at])
    freed(counts)
    return order


def _possible(percent: int, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether two sets of (n, rare, place) that meet at a key could link, if it is the first key they share.

    Before a single token nothing is shared. Before a pair, no rare token is, and shared tokens stand
    apart: each is followed by an error, so there are at most a third of the frequent tokens of both.
    """
    before = lambda s: F.greatest(s("place") - s("rare"), F.lit(0))
    apart = F.least(F.floor((before(x) + before(y)) / 3), before(x), before(y))
    most = apart + F.least(x("n") - x("place"), y("n") - y("place"))
    return most * (100 + percent) >= percent * (x("n") + y("n"))


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets of shared tokens."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            shared = np.empty(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("da"), batch.column("db"), strict=True)):
                x, y = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared[i] = (y[at] == x).sum() if len(x) else 0
            linked = pa.array(100 * shared >= percent * (total - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(linked), batch.column("b").filter(linked)], names=["a", "b"])

    side = lambda k: sets.withColumnsRenamed({"sig": k, "n": f"n{k}", "data": f"d{k}"})
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "da", "nb", "db")
    return both.mapInArrow(compare, "a bigint, b bigint")


def _pairs(percent: int, rows: DataFrame, others: DataFrame, differ: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``rows`` (as x) and ``others`` (as y) that meet at a key and could link."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    meet = (x("key") == y("key")) & (x("sig") != y("sig")) & _possible(percent, x, y)
    met = rows.alias("x").join(others.alias("y"), meet if differ is None else meet & differ)
    return met.select(F.least(x("sig"), y("sig")).alias("a"), F.greatest(x("sig"), y("sig")).alias("b")).distinct()


class Index:
    """What a join needs: rows (key, tie, n_shingles, sig) of all documents, posts (key, sig, n, rare, place)
    of the classes that can link, and sets (sig, n, data) of their tokens that several sets hold."""

    def __init__(self, docs: DataFrame, percent: int, **options) -> None:
        if not 75 <= percent <= 100:
            raise ValueError("combinations of two neighbours meet from 75 percent on")
        spark = docs.sparkSession
        base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
        texts = base.select("text")
        self.percent = percent
        rows = _each_chunk(base, "key bigint, tie bigint, n_shingles bigint, sig bigint", lambda s, c: _batch(key=c["key"], tie=c["tie"], n_shingles=s.size.astype(np.int64), sig=s.sig))
        self.rows = written(spark, rows, "jaccard-rows")
        n_tokens = self.rows.agg(F.sum("n_shingles")).first()[0] or 0
        order: Broadcast = spark.sparkContext.broadcast(token_order(texts, n_tokens, **options))

        def entries(sets: ShingleSets, _: dict) -> pa.RecordBatch:
            doc, key, rare, place = index_keys(sets, sets.first_of_class(), order.value, percent)
            return _batch(key=key.view(np.int64), sig=sets.sig[doc], n=sets.size[doc].astype(np.int32), rare=rare.astype(np.int32), place=place.astype(np.int32))

        posts = every = written(spark, _each_chunk(texts, "key bigint, sig bigint, n int, rare int, place int", entries).distinct(), "jaccard-posts")
        # without keys of one class alone, and classes that could not link with the least set of the key
        keys = posts.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("low")).filter("many > 1")
        able = F.col("n") - F.least("place", "rare")
        posts = posts.join(keys, "key").filter(able * (100 + percent) >= percent * (F.col("n") + F.col("low")))
        self.posts = written(spark, posts.drop("many", "low"), "jaccard-able")
        freed(every)
        wanted = written(spark, self.posts.select("sig").distinct(), "jaccard-wanted")
        mark = spark.sparkContext.broadcast(filter_of(wanted, "sig", size_for(wanted.count())))

        def fetch(sets: ShingleSets, _: dict) -> pa.RecordBatch:
            at = sets.first_of_class()
            at = at[mark.value.test(sets.sig[at].view(np.uint64))]
            keep = sets.of(at)
            doc, token = sets.doc[keep], sets.tokens[keep]
            some = order.value.classes(token) > 0
            doc, token = doc[some], token[some]
            edges = np.searchsorted(doc, np.arange(len(sets.size) + 1))
            data = pa.array([token[edges[i] : edges[i + 1]].tobytes() for i in at], pa.binary())
            return _batch(sig=sets.sig[at], n=sets.size[at].astype(np.int64), data=data)

        found = _each_chunk(texts, "sig bigint, n bigint, data binary", fetch).join(wanted, "sig", "left_semi")
        self.sets = written(spark, found.groupBy("sig", "n").agg(F.first("data").alias("data")), "jaccard-sets")
        freed(wanted)


def jaccard_links(docs: DataFrame, percent: int = 75, **options) -> tuple[DataFrame, DataFrame]:
    """The whole join: rows (key, tie, n_shingles, sig) of all documents, sig being the class of equal
    sets, and every link (a, b), a < b, between classes.

    The output can have as many links as a family of near copies has pairs; use jaccard_components where
    only the groups are wanted.
    """
    index = Index(docs, percent, **options)
    tried = written(docs.sparkSession, _pairs(percent, index.posts, index.posts, F.col("x.sig") < F.col("y.sig")), "jaccard-tried")
    return index.rows, _verified(index.sets, tried, percent)


def jaccard_components(docs: DataFrame, percent: int = 75, **options) -> DataFrame:
    """Rows (key, tie, n_shingles, sig, label, least, component) of all documents.

    key is the id (LAST for null) and tie the hash of the text; label is the least class reachable, null
    for the empty set, least the least key of an equal set and component the least key reachable: ids
    may be null or equal, so only the label tells components apart.
    """
    spark = docs.sparkSession
    index = Index(docs, percent, **options)
    posts, rows = index.posts, index.rows
    hubs = posts.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("place", "sig", "n", "rare")).alias("hub")).filter("many > 1")
    hubs = written(spark, hubs.select("key", "many", "hub.*"), "jaccard-hubs")
    tried = written(spark, _pairs(percent, posts, hubs), "jaccard-tried")
    links = written(spark, _verified(index.sets, tried, percent), "jaccard-star")
    labels = component_labels(links)

    # what is not in its hub's component, against what of the key is in another one
    named = posts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    named = labelled = written(spark, named.join(hubs.filter("many > 2").select("key", F.col("sig").alias("hub")), "key"), "jaccard-named")
    of_hub = named.filter("sig = hub").select("key", F.col("label").alias("hub_label"))
    named = written(spark, named.filter("sig != hub").join(of_hub, "key").withColumn("out", F.col("label") != F.col("hub_label")), "jaccard-out")
    differ = (F.col("x.label") != F.col("y.label")) & (~F.col("y.out") | (F.col("x.sig") < F.col("y.sig")))
    rest = written(spark, _pairs(percent, named.filter("out"), named, differ).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    more = written(spark, _verified(index.sets, rest, percent), "jaccard-more")
    if not more.isEmpty():
        labels = component_labels(links.union(more))

    classes = rows.filter("n_shingles > 0").groupBy("sig").agg(F.min("key").alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("label", "sig").alias("label"))
    classes = written(spark, classes, "jaccard-classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    of = written(spark, classes.join(least, "label").select("sig", "label", "least", "component"), "jaccard-of")
    freed(posts, index.sets, hubs, tried, links, labelled, named, rest, more, classes)
    return rows.join(of, "sig", "left").withColumns({c: F.coalesce(c, "key") for c in ("least", "component")})


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row doc_id, n_shingles, component_id, class_id: the least ids reachable and of an equal set.

    Lower-cases A-Z. Rows link when 100 * intersection >= percent * union of their sets. Null, empty and
    wordless texts have an empty set and link with nothing, not with each other either; texts under five
    words have their whole sequence as the one shingle; rows of equal id are rows of their own; a null
    id stands after all others; other columns are not read; an empty table gives no rows.
    """
    out = jaccard_components(docs, percent)
    back = lambda c, name: F.nullif(c, F.lit(LAST)).alias(name)
    return out.select(back("key", "doc_id"), "n_shingles", back("component", "component_id"), back("least", "class_id"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component: that of the least id, of rows of equal id one.

    A null id stands after all others. Documents with an empty set all stay, repeated ones too.
    """
    spark = docs.sparkSession
    out = jaccard_components(docs, percent)
    full = out.filter("n_shingles > 0")
    stays = full.groupBy("label").agg(F.min(F.struct("key", "tie")).alias("stay"))
    marked = full.groupBy("label", "key", "tie").agg(F.count(F.lit(1)).alias("__q_many")).join(stays, "label")
    marked = marked.select(F.col("key").alias("__q_key"), F.col("tie").alias("__q_tie"), (F.struct("key", "tie") != F.col("stay")).alias("__q_gone"), "__q_many")
    marked = written(spark, marked.filter("__q_gone or __q_many > 1"), "jaccard-marked")
    marks = {"__q_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), "__q_at": F.xxhash64("text")}
    same = (F.col("__q_id") == F.col("__q_key")) & (F.col("__q_at") == F.col("__q_tie"))
    kept = docs.withColumns(marks).join(sized(marked), same, "left").filter("not coalesce(__q_gone, false)").drop("__q_key", "__q_tie", "__q_gone")
    if marked.filter("not __q_gone").isEmpty():
        return kept.drop("__q_id", "__q_at", "__q_many")
    once = kept.filter("__q_many is not null").dropDuplicates(["__q_id", "__q_at"])
    return kept.filter("__q_many is null").unionByName(once).drop("__q_id", "__q_at", "__q_many")


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
sets as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as shingle from places),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as shared from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from both_ join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, edges.b from reach join edges on edges.a = reach.r),
whole as (select doc_id, string_agg(shingle, chr(10) order by shingle) as s from sets group by doc_id),
classes as (select doc_id, min(doc_id) over (partition by s) as class_id from whole)
select reach.doc_id, coalesce(max(n), 0)::bigint as n_shingles, min(r) as component_id, coalesce(max(class_id), reach.doc_id) as class_id
from reach left join sizes on sizes.doc_id = reach.doc_id left join classes on classes.doc_id = reach.doc_id group by reach.doc_id
"""
