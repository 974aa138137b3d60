import math

import pytest
from pyspark.sql import functions as F

from quernworks.functions import category, chain, complexity, exact, extract, labels
from quernworks.schemas import CATEGORIES, conform, json_map


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_clip_keeps_nan_and_null(spark):
    rows = spark.createDataFrame([(-1.0,), (0.4,), (2.0,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in rows.select(exact.clip01(F.col("x"))).collect()]
    assert got[:3] == [0.0, 0.4, 1.0] and math.isnan(got[3]) and got[4] is None


def test_two_decimals_rounds_the_binary_value(spark):
    values = [0.125, 2.675, 0.285, 0.005, 1.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(exact.two_decimals("x")).collect()
    assert [r[0] for r in rows] == [None if v is None else f"{v:.2f}" for v in values]


@pytest.mark.parametrize(
    ("path", "stem"),
    [("a/foo bar.png", "foo_bar"), ("foo!.png", "foo_"), ("[bracketed].jpg", "_bracketed_"), ("   ", None), ("", None), ("x/a.tar.gz", "a_tar"), ("a/b/", "b"), (".hidden", "_hidden")],
)
def test_id_stem(spark, path, stem):
    assert one(spark, exact.id_stem(F.lit(path))) == stem


def test_cache_name(spark):
    import hashlib

    for url, suffix in (("http://x.y/a.PNG?z=1", ".png"), ("http://x.y/a", ".jpg"), ("http://x.y/a.gif", ".jpg"), ("http://x.png", ".jpg")):
        assert one(spark, exact.cache_name(F.lit(url))) == hashlib.sha1(url.encode()).hexdigest()[:16] + suffix


def test_complexity(spark):
    score = lambda t: one(spark, complexity.complexity(F.lit(t).cast("string")))
    assert score(None) == score("") == score("?!,") == 0.0
    assert score("make it red") == pytest.approx(0.25 * 3 / 25 + 0.25 / 3)
    assert score("add a hat and then remove the dog near the left edge while " + "word " * 30) == pytest.approx(0.25 + 0.25 * 2 / 3 + 0.25 + 0.25)
    with pytest.raises(ValueError):
        complexity.ComplexityConfig(weights={"length": 0, "verbs": 0, "conjunctions": 0, "spatial": 0})


def triplets(spark, rows):
    return spark.createDataFrame(rows, "triplet_id string, source_dataset string, instruction string, metadata string")


def test_every_label_is_mapped(spark):
    import json

    texts = [t for ts in category.LABELS.values() for t in ts]
    assert len(texts) == 35
    rows = [(str(i), "Pico-Banana", "", json.dumps({"source_edit_type": f" {t.title()} "}, ensure_ascii=False)) for i, t in enumerate(texts)]
    got = {r.triplet_id: r for r in category.classify(triplets(spark, rows)).collect()}
    want = [c for c, ts in category.LABELS.items() for _ in ts]
    assert [got[str(i)].category for i in range(35)] == want and all(r.confidence == 1.0 for r in got.values())


def test_rules_first_match_and_fallback(spark):
    cases = {
        "make it snowing": ("scene_transformation", "rule:weather"),
        "erase the background": ("object_removal", "rule:remove"),
        "illuminate the room": ("other", "no-rule-matched:illuminate the room"),
        "turn the big dog into a cat": ("object_replacement", "rule:turn-into"),
        "make the\rred": ("attribute_change", "rule:color"),
        "": ("other", "no-rule-matched:"),
    }
    rows = triplets(spark, [(t, "magicbrush", t, "{bad") for t in cases] + [("null", "magicbrush", None, None), ("odd", "pico_banana", "x", '{"source_edit_type": "never heard of"}')])
    got = {r.triplet_id: r for r in category.classify(rows).collect()}
    assert {t: (got[t].category, got[t].rationale) for t in cases} == cases
    assert (got["null"].source, got["odd"].rationale, got["odd"].confidence) == ("fallback", "unmapped:never heard of", 0.5)
    counts = {r.category: r.n for r in category.category_counts(category.classify(rows)).collect()}
    assert set(counts) == set(CATEGORIES) and sum(counts.values()) == len(cases) + 2 and counts["photometric"] == 0


def chain_row(spark, **changes):
    row = {"instruction": "add a dog", "mask_area_frac": 0.125, "spatial_descriptor": "centered", "structural_change": 0.285, "compactness_score": 0.2, "category": "object_addition", "confidence": 0.8, "source": "rule_based", "edit_scope": "local", "difficulty_bin": "easy", "difficulty_raw": 0.125, "instruction_complexity": 0.5} | changes
    return chain.with_chain(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())))


def test_chain_round_trips_through_extraction(spark):
    for where in chain.SPATIAL_PROSE:
        row = extract.extract(chain_row(spark, spatial_descriptor=where).withColumnRenamed("chain", "generated_text")).first()
        assert (row.pred_category, row.pred_spatial_descriptor, row.pred_difficulty_bin) == ("object_addition", where, "easy")
    row = chain_row(spark).first()
    assert row.header == "[category=object_addition, scope=local, difficulty=easy, source=rule_based]"
    assert "roughly 12% of" in row.chain and "(SSIM-based score = 0.28)" in row.chain and "(confidence 0.80)" in row.chain and row.chain.count("\n") == 5
    long = chain_row(spark, instruction="x" * 300).first().chain
    assert '"' + "x" * 197 + '..."' in long
    assert chain_row(spark, instruction="  ").first().chain.startswith(chain.NO_INSTRUCTION)


def test_label_only_extraction(spark):
    texts = ['say {"category": "text_edit", "spatial_descriptor": "centered", "difficulty_bin": "hard"}', '{"category": 3, "difficulty_bin": "easy"}', "{broken", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, generated_text string")
    got = [tuple(r)[2:] for r in extract.extract(rows, "label_only").orderBy("i").collect()]
    assert got == [("text_edit", "centered", "hard"), (None, None, "easy"), (None,) * 3, (None,) * 3, (None,) * 3]


def test_label_mask(spark):
    rows = spark.createDataFrame([([5, 8, 9, 3, 8, 9, 0], [8, 9], 0)], "ids array<int>, marker array<int>, pad int")
    assert rows.select(labels.label_mask(F.col("ids"), F.col("marker"), F.col("pad"))).first()[0] == [-100, -100, -100, 3, 8, 9, -100]
    with pytest.raises(Exception, match="marker"):
        rows.select(labels.label_mask(F.col("ids"), F.array(F.lit(7)), F.col("pad"))).collect()


def test_tolerant_json_and_schemas(spark):
    rows = spark.createDataFrame([('{"a": 1.5}',), ("{bad",), (None,)], "w string")
    assert [r[0] for r in rows.select(json_map(F.col("w"))).collect()] == [{"a": 1.5}, {}, {}]
    old = conform(spark.createDataFrame([("t", 0.5)], "triplet_id string, mask_area_frac double"), "mask_artifacts").first()
    assert old.combined_diff_mean == 0.0 and math.isnan(old.mask_compactness)
    with pytest.raises(ValueError, match="rationale"):
        conform(spark.createDataFrame([("t",)], "triplet_id string"), "categories")
