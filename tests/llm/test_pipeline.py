"""Each stage is judged on what the one before kept."""

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from quernworks.llm import mixing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf).cache()
        rows = out.collect()
        seen[name] = len(rows)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            texts = dict(before)
            stays = {r.doc_id for r in rows}
            failed = {d for d, t in texts.items() if (q := brute.quality(t))[0] < 20 or 100 * q[4] > 30 * q[0]}
            assert not stays & failed and len(stays) >= 0.8 * (len(texts) - len(failed))
        elif name == "line_dedup":
            want = {d: s for d, _, _, s in brute.line_dedup(before)}
            assert {r.doc_id: brute.sha(r.text) for r in rows} == want
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _, c in brute.components(before) if d == c)
        elif name == "source_mixing":
            words = {}
            for r in rows:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text))
            want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            assert words == want
        else:
            assert {r.doc_id for r in rows} == {d for d, _ in before}
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == seen["packing"]


def word(i):
    return "".join("aeioulmnrst"[(i * 7 + k * k * 3 + i // 11) % 11] for k in range(3 + i % 6))


def odd_rows():
    """Nulls in every column, repeated rows, ties, empty and very long texts, beside plain ones."""
    plain = lambda k, n: " ".join(word(k * 1000 + i) for i in range(n))
    rows = [(i, "\n".join(plain(i * 3 + j, 12) for j in range(3 + i % 4)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(None, plain(500, 40), None, None), (None, plain(501, 40), "en", None), (61, None, "en", "s0"), (62, "", None, "s1"), (None, None, None, None)]
    rows += [(70, plain(502, 60), "en", "s2")] * 4 + [(71, plain(502, 60) + " tail", "en", "s2"), (72, plain(503, 60) + "\n" + plain(504, 12), "de", "s1"), (73, plain(505, 60) + "\n" + plain(504, 12), "de", "s1")]
    rows.append((80, " ".join(f"{word(i)}{i}" for i in range(30_000)), "en", "s1"))
    return [(d, t, la, s, None if t is None else len(t), i, "tie", "clash") for i, (d, t, la, s) in enumerate(rows)]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, __at bigint, tie string, taken string"
CLASH = ["key", "sig", "_id", "_tie", "_at", "_copy", "_words", "_size", "distance", "kept", "component", "bucket", "label", "size"]


def test_odd_rows_go_through_every_stage(spark, sf):
    docs = spark.createDataFrame(odd_rows(), ODD).withColumns({c: F.lit("x") for c in CLASH})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf).cache()
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == columns
        if name == "quality_rules":
            assert set(after) <= set(before) and (None, None) not in after and (61, None) not in after and sum(d == 70 for d, _ in after) in (0, 4)
        elif name == "line_dedup":
            assert len(after) == len(before)
        elif name == "near_duplicates":
            stays = Counter(d for d, _ in after)
            assert stays[70] == 1 and not stays[71] and stays[None] == sum(d is None for d, _ in before)
        else:
            taken = Counter()
            for d, t in after:
                taken[d, ] += len(brute.words(t))
            want = Counter()
            for r in mixing.mix(docs).collect():
                want[r.doc_id, ] += r.taken
            assert +taken == +want
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_empty_tables_go_through_every_stage(spark, sf):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ODD.replace(" bigint", "").replace(" string", "").split(", ") and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_repeated_rows_emit_all_the_words_that_the_mix_takes(spark):
    rows = [(1, "a b c d e f g", "s")] * 3 + [(2, "h i j", "s"), (2, "h i j", "s"), (None, "k l m n", None), (3, "o p", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block in (2, 1024):
        taken = mixing.mix(docs, block_words=block).agg(F.sum("taken")).first()[0]
        assert sum(len(r.text.split()) for r in mixing.mixed_documents(docs, block_words=block).collect()) == taken
