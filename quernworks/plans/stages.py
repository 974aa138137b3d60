"""The stages of the curation pipeline over artifact tables: ingest, masks, difficulty, category, reasoning, sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import category, chain, extract
from ..functions.exact import matches
from ..image.masks import MaskConfig, compare_masks, generate_masks
from ..operators import joins, sampling, scores, stats
from ..operators.dedup import assert_unique, keep_last
from ..sources import files
from ..schemas import difficulty_version


def masks_stage(triplets: DataFrame, images: DataFrame, config: MaskConfig = MaskConfig()) -> DataFrame:
    """Mask artifacts with compactness, place, structural change and the mask itself: later stages need no image."""
    return generate_masks(files.image_pairs(triplets, images), config)


def difficulty_stage(triplets: DataFrame, masks: DataFrame, config: scores.ScoreConfig = scores.ScoreConfig(), order: list[str] | None = None) -> DataFrame:
    """Scores of all triplets that have a mask, with tertile bins over all of them. Keys are made unique first."""
    if order:
        masks = keep_last(masks, ["triplet_id"], order)
    rows = joins.lookup_join(triplets.select("triplet_id", "instruction"), masks, "triplet_id")
    return stats.with_tertile_bins(scores.score(rows, config), "difficulty_raw")


def difficulty_counts(triplets: DataFrame, masks: DataFrame, done: DataFrame | None = None, config: scores.ScoreConfig = scores.ScoreConfig()) -> DataFrame:
    """One row about a scoring run: n_triplets, n_skipped, n_duplicates, n_unmatched, n_failed, n_scored.

    Rows of triplets that ``done`` holds are skipped; further rows of an id are duplicates; ids without a
    mask are unmatched; those with one whose score is null or NaN have failed.
    """
    ids = triplets.groupBy("triplet_id").agg(F.count(F.lit(1)).alias("rows"), F.first("instruction").alias("instruction"))
    old = (done if done is not None else triplets.limit(0)).select("triplet_id").distinct().withColumn("old", F.lit(True))
    has = masks.select("triplet_id").distinct().withColumn("has", F.lit(True))
    good = scores.score(joins.lookup_join(ids.select("triplet_id", "instruction"), masks, "triplet_id"), config)
    good = good.filter(F.col("difficulty_raw").isNotNull() & ~F.isnan("difficulty_raw")).select("triplet_id").distinct().withColumn("good", F.lit(True))
    rows = ids.join(old, "triplet_id", "left").join(has, "triplet_id", "left").join(good, "triplet_id", "left")
    new = F.col("old").isNull()
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_triplets"), F.coalesce(F.sum(F.when(new, 0).otherwise(F.col("rows"))), F.lit(0)).alias("n_skipped"),
        F.coalesce(F.sum(F.when(new, F.col("rows") - 1).otherwise(0)), F.lit(0)).alias("n_duplicates"), some(new & F.col("has").isNull()).alias("n_unmatched"),
        some(new & F.col("has").isNotNull() & F.col("good").isNull()).alias("n_failed"), some(new & F.col("good").isNotNull()).alias("n_scored"),
    )


def category_stage(triplets: DataFrame, **options) -> DataFrame:
    return category.classify(triplets, **options)


def reasoning_stage(triplets: DataFrame, masks: DataFrame, difficulty: DataFrame, categories: DataFrame) -> DataFrame:
    """Explanations of triplets that all three tables have; the difficulty table must be of version 2."""
    if difficulty_version(difficulty) != "difficulty_v2":
        raise ValueError("explanations need compactness_score: score with version 2")
    sides = [
        masks.select("triplet_id", "mask_area_frac", "edit_scope", "spatial_descriptor"),
        difficulty.select("triplet_id", "structural_change", "compactness_score", "instruction_complexity", "difficulty_raw", "difficulty_bin"),
        categories.select("triplet_id", "category", "confidence", "source"),
    ]
    rows = joins.join_all(triplets.select("triplet_id", "instruction"), sides, "triplet_id")
    return chain.with_chain(rows).select("triplet_id", "header", "chain", "template_version", "category", "difficulty_bin", "spatial_descriptor")


def training_rows(triplets: DataFrame, reasoning: DataFrame, per_cell: int, seed: int = 0, mode: str = "chain", keep_other: bool = False) -> DataFrame:
    """A stratified sample by category and bin in a shuffled order, with prompts and targets."""
    rows = triplets.join(reasoning, "triplet_id")
    if not keep_other:
        rows = rows.filter(F.col("category") != "other")
    rows = sampling.stratified(rows, ["category", "difficulty_bin"], per_cell, "triplet_id", seed)
    goal = chain.target(mode, F.col("chain"), F.col("category"), F.col("spatial_descriptor"), F.col("difficulty_bin"))
    rows = rows.withColumns({"prompt": chain.prompt(F.col("instruction")), "target": goal})
    return sampling.shuffled(rows, "triplet_id", seed)


def evaluate_predictions(truth: DataFrame, generated: DataFrame, mode: str = "chain") -> DataFrame:
    """Per row the fields read from generated text, the true ones, and whether they agree."""
    rows = extract.extract(generated.join(truth, "triplet_id"), mode)
    pairs = {"category": "category", "spatial": "spatial_descriptor", "bin": "difficulty_bin"}
    return rows.withColumns({f"{n}_match": matches(F.col(f"pred_{c}"), F.col(c)) for n, c in pairs.items()})


def evaluate_masks(triplets: DataFrame, artifacts: DataFrame, images: DataFrame) -> DataFrame:
    """(triplet_id, iou, dice, gt_area_frac, auto_area_frac, edit_scope) of triplets that have a provided mask.

    Both masks are files of ``images`` (path, content); the provided one is resized to the generated
    one. A missing file gives nulls. ``stats.overlap_summary`` of this, by scope, is the report.
    """
    given = triplets.filter(F.col("provided_mask_path").isNotNull()).select("triplet_id", "provided_mask_path")
    rows = joins.lookup_join(given, artifacts.select("triplet_id", "mask_path", "edit_scope"), "triplet_id")
    file = lambda path, content: images.select(F.col("path").alias(path), F.col("content").alias(content))
    rows = rows.join(file("mask_path", "mask_a"), "mask_path", "left").join(file("provided_mask_path", "mask_b"), "provided_mask_path", "left")
    found = compare_masks(rows).select("triplet_id", "iou", "dice", F.col("area_b").alias("gt_area_frac"), F.col("area_a").alias("auto_area_frac"))
    return found.join(rows.select("triplet_id", "edit_scope"), "triplet_id")


def mask_report(compared: DataFrame, path: str) -> dict:
    """Writes ``evaluate_masks`` rows beside the JSON report of their summary, of all and by scope, and returns it."""
    rows = compared.filter("iou is not null")
    nested = stats.overlap_summary(rows, "edit_scope")
    fields = [c for c in nested.columns if c != "edit_scope"]
    by = nested.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("edit_scope", F.struct(*fields))))).alias("scopes"))
    files.write_rows_beside(compared, path)
    return files.write_report(by.select(F.col("scopes")["(all)"].alias("all"), F.map_filter("scopes", lambda k, _: k != "(all)").alias("by_scope")), path)


def sampled_overlaps(pairs: DataFrame, overlaps: Callable[[DataFrame], DataFrame], most: int = 5000, seed: int = 0) -> DataFrame:
    """(subset, n, n_sampled_from, mean, median, q25, q75) of two runs' masks: where both are local, and where just one is global.

    ``pairs`` has triplet_id and edit_scope_a, edit_scope_b; ``overlaps`` gives (triplet_id, iou) of some
    of its rows. At most ``most`` rows of a subset are compared, by the seed's order; all for -1. Rows
    without both masks are not counted in n; a subset without rows has no row.
    """
    a, b = F.col("edit_scope_a"), F.col("edit_scope_b")
    subset = F.when((a == "local") & (b == "local"), "both_local").when((a == "global") != (b == "global"), "disputed")
    rows = pairs.withColumn("subset", subset).filter("subset is not null")
    sizes = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n_sampled_from"))
    some = rows if most < 0 else sampling.stratified(rows, ["subset"], most, "triplet_id", seed)
    found = some.select("triplet_id", "subset").join(overlaps(some.drop("subset")).select("triplet_id", "iou"), "triplet_id").filter("iou is not null")
    quarters = [stats.quantile("iou", p).alias(n) for p, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))]
    return found.groupBy("subset").agg(F.count("iou").alias("n"), F.avg("iou").alias("mean"), *quarters).join(sizes, "subset").select("subset", "n", "n_sampled_from", "mean", "median", "q25", "q75")


def compare_masks_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' masks side by side: segments and means."""
    pairs = joins.pair_runs(assert_unique(a, ["triplet_id"]), assert_unique(b, ["triplet_id"]), "triplet_id", ["edit_scope", "mask_area_frac", "combined_diff_mean"])
    return stats.segment_summary(pairs, "a", "b")
