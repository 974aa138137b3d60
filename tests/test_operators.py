import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernworks.operators import bootstrap, calibrate, dedup, joins, sampling, scores, stats


def test_keep_first_last_and_collisions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in dedup.keep_last(rows, ["k"], ["at"]).collect()} == {("a", "y"), ("b", "z"), (None, "n")}
    assert {(r.k, r.v) for r in dedup.keep_first(rows, ["k"], ["at"]).collect()} == {("a", "x"), ("b", "z"), (None, "n")}
    assert {r.k for r in dedup.resolve_collisions(rows, "k", ["at"]).collect()} == {"b", None}
    report = dedup.collision_report(rows, "k", "at").first()
    assert (report.n_collisions, report.n_records, report.examples[0].k) == (1, 2, "a")
    with pytest.raises(RuntimeError):
        dedup.assert_unique(rows, ["k"])
    with pytest.raises(ValueError):
        dedup.resolve_collisions(rows, "k", ["at"], "other")


def test_tertiles(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(300)], "id int, s double")
    counts = {r.difficulty_bin: r["count"] for r in stats.with_tertile_bins(rows, "s").groupBy("difficulty_bin").count().collect()}
    assert counts == {"easy": 100, "medium": 100, "hard": 100}
    same = rows.withColumn("s", F.lit(0.5))
    assert {r[0] for r in stats.with_tertile_bins(same, "s").select("difficulty_bin").distinct().collect()} == {"easy"}
    nan = rows.withColumn("s", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("s")))
    assert {r[0] for r in stats.with_tertile_bins(nan, "s").select("difficulty_bin").distinct().collect()} == {"medium"}


def test_sweep_and_candidates(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(10)], "v double")
    sweep = stats.threshold_sweep(rows, "v", [0.2, 0.4, 0.6, 0.8])
    assert [r.rate for r in sweep.orderBy("threshold").collect()] == [0.8, 0.6, 0.4, 0.2]
    got = {r.target: r.threshold for r in stats.candidate_thresholds(sweep, [0.5, 0.3, 0.1]).collect()}
    assert got == {"0.50": 0.6, "0.30": 0.8, "0.10": None}


def test_overlap_summary_of_no_rows(spark):
    empty = spark.createDataFrame([], "iou double, dice double")
    row = stats.overlap_summary(empty).first()
    assert row.n == 0 and row.mean_iou is None and row.bin4 == 0
    one = stats.overlap_summary(spark.createDataFrame([(1.0, 1.0)], "iou double, dice double")).first()
    assert one.bin4 == 1 and one.frac_iou_06 == 1.0


def test_scores(spark):
    rows = spark.createDataFrame([("a", "add a dog", 0.5, 0.25, 0.3, 0.4), ("b", None, 2.0, float("nan"), 0.3, 0.4)], "triplet_id string, instruction string, structural_change double, mask_compactness double, combined_diff_mean double, mask_area_frac double")
    (got,) = scores.score(rows).collect()
    assert got.compactness_score == 0.75 and got.difficulty_raw == pytest.approx(0.55 * 0.5 + 0.25 * 0.75 + 0.2 * got.instruction_complexity)
    v1 = {r.triplet_id: r for r in scores.score(rows, scores.ScoreConfig(version=1)).collect()}
    assert v1["b"].structural_change == 1.0 and v1["b"].difficulty_raw == pytest.approx(0.3 + 0.3 * 0.3 + 0.2 * 0.6)
    assert got.weights == '{"structural_change": 0.55, "compactness_score": 0.25, "instruction_complexity": 0.2}'
    with pytest.raises(ValueError):
        scores.ScoreConfig(weights={"structural_change": 1})
    with pytest.raises(TypeError):
        scores.ScoreConfig(weights=dict.fromkeys(scores.WEIGHTS_V2, "x"))


def test_bootstrap(spark):
    same = np.linspace(0, 1, 50)
    got = bootstrap.paired_bootstrap(same, same, 100, 0)
    assert (got["delta"], got["ci_low"], got["ci_high"], got["p_value_one_sided"]) == (0, 0, 0, 1.0)
    assert bootstrap.paired_bootstrap(same, same + 1, 100, 0)["p_value_one_sided"] == 0
    assert math.isnan(bootstrap.paired_bootstrap(same[:0], same[:0], 10, 0)["delta"])
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(same, same[:1], 10, 0)
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 7) + 0.5 + (i % 3) * 0.1, "g" if i % 2 else "h") for i in range(60)], "id int, a double, b double, g string")
    exact = {r.group: r for r in bootstrap.grouped_bootstrap(rows, "a", "b", "id", "g", 300).collect()}
    spread = {r.group: r for r in bootstrap.poisson_bootstrap(rows, "a", "b", "id", "g", 300).collect()}
    assert set(exact) == set(spread) == {"(all)", "g", "h"}
    for k in exact:
        assert exact[k].delta == pytest.approx(spread[k].delta) and abs(exact[k].ci_low - spread[k].ci_low) < 0.03 and exact[k].n == spread[k].n


def test_calibration_finds_the_component_that_ranks(spark):
    names = list(scores.WEIGHTS_V1)
    rng = np.random.default_rng(0)
    x = rng.random((90, 4))
    labels = {str(i): ("easy", "medium", "hard")[min(2, int(x[i, 2] * 3))] for i in range(90)}
    rows = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(x)], "triplet_id string, " + ", ".join(f"{n} double" for n in names))
    found = calibrate.calibrate(rows, labels)
    assert found["rho"] > found["baseline_rho"] and found["weights"]["locality"] > 0.7 and sum(found["weights"].values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        calibrate.calibrate(rows, {"1": "odd"})


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(100)], "id int, s string")
    a, b = (sorted(r.id for r in sampling.stratified(rows, ["s"], 5, "id", seed).collect()) for seed in (1, 1))
    assert a == b and len(a) == 15 and 0 not in a
    assert a != sorted(r.id for r in sampling.stratified(rows, ["s"], 5, "id", 2).collect())
    assert sampling.sample_rows(rows, -1, "id").count() == 100 and sampling.sample_rows(rows, 7, "id").count() == 7


def test_join_counts(spark):
    t = lambda ids: spark.createDataFrame([(i,) for i in ids], "triplet_id int")
    row = joins.join_counts(t([1, 2, 3, 4]), {"a": t([1, 2, 2]), "b": t([2, 3])}, "triplet_id").first()
    assert (row.n, row.n_without_a, row.n_without_b, row.n_joined) == (4, 2, 2, 1)


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    a, b = calibrate.average_ranks(np.array([1, 1, 2, 3.0])), calibrate.average_ranks(np.array([2, 1, 3, 3.0]))
    assert stats.spearman(rows, "a", "b").first().rho == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_quantiles_by_ranges_equal_numpy(spark):
    """Groups over the bound for one task: hot values, ties, NaN, nulls, one value, none."""
    rng = np.random.default_rng(4)
    groups = {
        "many": rng.normal(size=5000), "hot": np.where(rng.random(4000) < 0.6, 7.0, rng.integers(0, 30, 4000)), "one": np.full(900, 3.5),
        "wide": np.concatenate([rng.random(2000) * 1e-9, [1e12]]), "nan": np.where(rng.random(1000) < 0.7, np.nan, rng.random(1000)), "few": rng.random(5),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("many", None), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = (0.0, 0.25, 1 / 3, 0.5, 0.999, 1.0)
    for most in (100, 1 << 18):
        found = {r.g: r[1:] for r in stats.exact_quantiles(df, ["g"], "x", ps, most=most, bins=16).collect()}
        for g, xs in groups.items():
            full = np.sort(xs)  # NaN last
            at = [(len(full) - 1) * p for p in ps]
            want = [full[int(h)] if h == int(h) else full[int(h)] + (full[int(h) + 1] - full[int(h)]) * (h - int(h)) for h in at]
            assert np.allclose(found[g], want, rtol=1e-9, atol=1e-15, equal_nan=True), (most, g)
        assert found["none"] == (None,) * len(ps) and found[None][3] == 1.5
    ranked = stats.with_average_rank(df.filter("g = 'hot'"), "x", "r").select("x", "r").distinct().collect()
    xs = np.sort(groups["hot"])
    assert all(r.r == (np.searchsorted(xs, r.x, "left") + np.searchsorted(xs, r.x, "right") + 1) / 2 for r in ranked)


def test_reports_as_text(spark):
    df = spark.createDataFrame([("local", 3, 0.25), ("global", 12, None), ("odd", 1, 1.0)], "s string, n int, x double")
    assert stats.text_table(df.orderBy("n")).split("\n") == ["s        n       x", "------  --  ------", "odd      1  1.0000", "local    3  0.2500", "global  12"]
    counted = {r.scope: r["count"] for r in stats.with_scopes(df, "s").groupBy("scope").count().collect()}
    assert counted == {"all": 3, "local": 1, "global": 1}
