"""Registered queries that go through files, PNG bytes and pixel kernels, with their SQL.

Images are small grids made from the driver's tables. They are encoded, stored or decoded as real ones
are, so these queries also hold the readers and writers against SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..image import kernels, png
from ..operators import dedup, grids, joins
from ..session import scratch_path, table
from ..sources import files, manifest
from . import stages, synthetic
from .registry import _OVERLAP_SQL, _RUNS_SQL, _SHUFFLE, _runs, query, rounded


def _on_grids(rows: DataFrame, column: str, make: Callable[[np.ndarray], object], kind: str, side: int = 8) -> DataFrame:
    """vec_id and ``out``: a kernel's result for each grid, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "out": [make(np.asarray(x).reshape(-1, side)) for x in frame[column]]})

    return rows.select("vec_id", column).mapInPandas(run, f"vec_id bigint, out {kind}")


# ---- kernels ----
_LIN = "case when {0} > 0.04045::double then pow(({0} + 0.055::double) / 1.055::double, 2.4::double) else {0} / 12.92::double end"
_F = "case when {0} > 0.008856::double then cbrt({0}) else 7.787::double * {0} + 16.0::double / 116.0::double end"


@query(f"""with p as (select p_partkey, p_partkey % 256 / 255.0::double as r, p_size * 5 % 256 / 255.0::double as g, length(p_name) * 7 % 256 / 255.0::double as b from part),
l as (select p_partkey, {_LIN.format('r')} as r, {_LIN.format('g')} as g, {_LIN.format('b')} as b from p),
t as (select p_partkey, (0.412453::double * r + 0.357580::double * g + 0.180423::double * b) / 0.95047::double as x,
  0.212671::double * r + 0.715160::double * g + 0.072169::double * b as y, (0.019334::double * r + 0.119193::double * g + 0.950227::double * b) / 1.08883::double as z from l),
f as (select p_partkey, {_F.format('x')} as x, {_F.format('y')} as y, {_F.format('z')} as z from t)
select p_partkey, round(116 * y - 16, 4) as l, round(500 * (x - y), 4) as a, round(200 * (y - z), 4) as b from f""")
def lab_colors(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.length("p_name") * 7 % 256).alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lab = kernels.lab(frame[["r", "g", "b"]].to_numpy().astype(np.uint8))
            yield pd.DataFrame({"p_partkey": frame["p_partkey"], "l": lab[:, 0], "a": lab[:, 1], "b": lab[:, 2]})

    found = rows.mapInPandas(run, "p_partkey bigint, l double, a double, b double")
    return found.select("p_partkey", *[(F.round(c, 4) + 0.0).alias(c) for c in ("l", "a", "b")])


@query(f"""with recursive {synthetic.GRIDS_SQL}, lim as (select vec_id, nd, list_min(nd) as lo, list_max(nd) as hi from norm),
bins as (select vec_id, lo, hi, least(floor((x - lo) / (hi - lo) * 256)::int, 255) as k from (select vec_id, lo, hi, unnest(nd) as x from lim)),
hist as (select vec_id, lo, hi, k, count(*)::double as n, lo + (hi - lo) * (k + 0.5::double) / 256 as c from bins group by all),
cum as (select vec_id, k, sum(n) over w as w1, sum(n * c) over w as s1, sum(n) over (partition by vec_id) as w, sum(n * c) over (partition by vec_id) as s, c,
  lead(k) over (partition by vec_id order by k) as next_k, lo, hi from hist window w as (partition by vec_id order by k rows unbounded preceding)),
cut as (select vec_id, k, c, round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / nullif(w - w1, 0), 2), 9) as v from cum where next_k is not null)
select vec_id, round(min_by(c, k), 6) as threshold from (select *, max(v) over (partition by vec_id) as best from cut) where v = best group by vec_id""")
def otsu_thresholds(spark, sf):
    return _on_grids(synthetic.normalized_pairs(spark, sf), "nd", lambda x: kernels.otsu(x), "double").select("vec_id", F.round("out", 6).alias("threshold"))


def _cross(kind: str, old: str, new: str) -> str:
    """SQL of one erosion or dilation of 8 x 8 cells by the cross of radius 1; what lies outside never changes a cell."""
    near = "b.vec_id = a.vec_id and abs(b.i // 8 - a.i // 8) + abs(b.i % 8 - a.i % 8) <= 1"
    return f"{new} as (select a.vec_id, a.i, bool_{kind}(b.v) as v from {old} a join {old} b on {near} group by 1, 2)"


@query(f"""with recursive {synthetic.GRIDS_SQL}, c0 as (select vec_id, unnest(range(64)) as i, unnest(list_transform(nd, lambda x: x > 0.3)) as v from norm),
{_cross('and', 'c0', 'c1')}, {_cross('or', 'c1', 'c2')}, {_cross('or', 'c2', 'c3')}, {_cross('and', 'c3', 'c4')}
select vec_id, i, v from c4""")
def mask_opened_closed(spark, sf):
    rows = synthetic.normalized_pairs(spark, sf)
    found = _on_grids(rows, "nd", lambda x: kernels.closed(kernels.opened(x > 0.3, 1), 1).ravel().tolist(), "array<boolean>")
    return found.select("vec_id", F.posexplode("out").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")


@query(f"""with recursive {synthetic.GRIDS_SQL} select vec_id, i, nd[1 + (i // 5 * 2 + 1) * 8 // 10 * 8 + (i % 5 * 2 + 1) * 8 // 10] > 0.3 as v from norm, (select unnest(range(25)) as i)""")
def mask_resized(spark, sf):
    found = _on_grids(synthetic.normalized_pairs(spark, sf), "nd", lambda x: kernels.resize(x > 0.3, 5, 5, nearest=True).ravel().tolist(), "array<boolean>")
    return found.select("vec_id", F.posexplode("out").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")


def _ssim_sql() -> str:
    """Mean of the similarity over the four full 7 x 7 windows of two 8 x 8 grids, with sample variances."""
    c1, c2 = "0.0001::double", "0.0009::double"
    win = "select vec_id, oy, ox, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as vxy from cells, (select unnest(range(2)) as oy), (select unnest(range(2)) as ox) where i // 8 between oy and oy + 6 and i % 8 between ox and ox + 6 group by 1, 2, 3"
    return f"win as ({win}), sim as (select vec_id, avg((2 * mx * my + {c1}) * (2 * vxy + {c2}) / ((mx * mx + my * my + {c1}) * (vx + vy + {c2}))) as s from win group by 1)"


@query(f"with recursive {synthetic.GRIDS_SQL}, cells as (select vec_id, unnest(range(64)) as i, unnest(nd) as x, unnest(ne) as y from norm), {_ssim_sql()} select vec_id, round(s, 6) as ssim from sim")
def ssim_of_grids(spark, sf):
    rows = synthetic.normalized_pairs(spark, sf).select("vec_id", F.concat("nd", "ne").alias("both"))
    return _on_grids(rows, "both", lambda x: kernels.ssim(x[:8], x[8:]), "double").select("vec_id", F.round("out", 6).alias("ssim"))


# ---- masks as files ----
def _mask_files(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triplets and artifacts that name mask files, and the files, of the embeddings' signs; a third has no provided mask."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", grids.above(F.col("embedding"), 0).alias("mask"))
    name = lambda i: F.concat(F.lit("/masks/"), i.cast("string"), F.lit(".png"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [png.encode(np.repeat(np.asarray(m, bool).reshape(-1, 8, 1), 3, axis=2)) for m in frame["mask"]]})

    images = rows.select(name(F.col("vec_id")).alias("path"), "mask").mapInPandas(run, "path string, content binary")
    odd = rows.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("triplet_id"), name(F.col("vec_id")).alias("given"))
    triplets = odd.select("triplet_id", F.when(F.col("triplet_id") % 3 != 0, F.col("given")).alias("provided_mask_path"))
    scope = F.when(F.col("label") % 2 == 0, "local").otherwise("global")
    artifacts = rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("triplet_id"), name(F.col("vec_id")).alias("mask_path"), scope.alias("edit_scope"))
    as_text = lambda df: df.withColumn("triplet_id", F.col("triplet_id").cast("string"))
    return as_text(triplets), as_text(artifacts), images


@query(f"""with {_OVERLAP_SQL}, area as (select vec_id, len(list_filter(x, lambda v: v)) / 64.0::double as ax, len(list_filter(y, lambda v: v)) / 64.0::double as ay from raw)
select vec_id::varchar as triplet_id, round(iou, 6) as iou, round(dice, 6) as dice, ay as gt_area_frac, ax as auto_area_frac, edit_scope from ov join area using (vec_id) where vec_id % 3 <> 0""")
def mask_evaluation(spark, sf):
    return rounded(stages.evaluate_masks(*_mask_files(spark, sf)), "iou", "dice")


_SAMPLED = 40


@query(f"""with {_RUNS_SQL}, sub as (select *, case when sa = 'local' and sb = 'local' then 'both_local' when (sa = 'global') <> (sb = 'global') then 'disputed' end as subset from runs),
ranked as (select subset, least(ca, cb) / greatest(ca, cb, 0.01::double) as iou, count(*) over (partition by subset) as size, row_number() over (partition by subset order by {_SHUFFLE.format(0, 'triplet_id')}, triplet_id) as r from sub where subset is not null)
select subset, count(iou) as n, any_value(size) as n_sampled_from, round(avg(iou), 6) as mean, round(quantile_cont(iou, 0.5), 6) as median, round(quantile_cont(iou, 0.25), 6) as q25, round(quantile_cont(iou, 0.75), 6) as q75
from ranked where r <= {_SAMPLED} group by subset""")
def sampled_iou(spark, sf):
    a, b = _runs(spark, sf)
    pairs = joins.pair_runs(a, b, "triplet_id", ["edit_scope", "combined_diff_mean"])
    like = F.least("combined_diff_mean_a", "combined_diff_mean_b") / F.greatest("combined_diff_mean_a", "combined_diff_mean_b", F.lit(0.01))
    return rounded(stages.sampled_overlaps(pairs, lambda rows: rows.select("triplet_id", like.alias("iou")), _SAMPLED), "mean", "median", "q25", "q75")


# ---- manifests, turns, shards ----
@query("""with s as (select s_suppkey as k, s_name, row_number() over (order by s_suppkey) + count(*) filter (where s_suppkey % 3 = 0) over (order by s_suppkey rows between unbounded preceding and 1 preceding) as line from supplier),
o as (select *, case when k % 5 = 0 then concat('dup', k // 10) else k::varchar end as stem from s where k % 17 <> 0), c as (select *, count(*) over (partition by stem) as n from o)
select concat('picobanana_', stem) as triplet_id, concat('real/', k % 7, '.png') as real_name, concat('edit/', stem, '.png') as edited_name, concat('make ', s_name) as instruction, line::varchar as manifest_line_no,
concat('http://example.org/', k, '.jpg') as url from c where n = 1 and k % 11 <> 0 and k % 13 <> 0 and (k % 19 <> 0 or k % 5 = 0)""")
def manifest_scan(spark, sf):
    """A manifest with blank and malformed lines, names that collide, texts and images that lack, and its images, as files."""
    root = scratch_path(spark, "manifest")
    k = F.col("s_suppkey")
    stem = F.when(k % 5 == 0, F.concat(F.lit("dup"), F.expr("cast(s_suppkey div 10 as string)"))).otherwise(k.cast("string"))
    rows = table(spark, sf, "supplier").select("s_suppkey", stem.alias("stem"), F.when(k % 13 == 0, "real/none.png").otherwise(F.concat(F.lit("real/"), (k % 7).cast("string"), F.lit(".png"))).alias("local_input_image"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("make "), F.col("s_name"))).alias("text"))
    line = F.to_json(F.struct(F.concat(F.lit("http://example.org/"), k.cast("string"), F.lit(".jpg")).alias("open_image_input_url"), "text", F.concat(F.lit("edit/"), "stem", F.lit(".png")).alias("output_image"), "local_input_image"))
    line = F.concat(F.when(k % 17 == 0, "{broken").otherwise(line), F.when(k % 3 == 0, "\n").otherwise(""))
    rows.orderBy("s_suppkey").select(line.alias("value")).coalesce(1).write.text(f"{root}/lines")
    image = F.lit(png.encode(np.zeros((2, 2, 3), np.uint8)))
    files.write_images(rows.filter((k % 19 != 0) | (k % 5 == 0)).select(F.col("stem").alias("triplet_id")).distinct().withColumn("content", image), f"{root}/data/edit", "content").count()
    files.write_images(spark.range(7).select(F.col("id").cast("string").alias("triplet_id"), image.alias("content")), f"{root}/data/real", "content").count()
    found = manifest.manifest_triplets(spark, manifest.ManifestConfig(f"{root}/lines", f"{root}/data"))
    name = lambda c: F.regexp_extract(c, "/data/(.*)$", 1)
    kept = lambda c: F.get_json_object("metadata", f"$.{c}")
    return found.select("triplet_id", name("real_path").alias("real_name"), name("edited_path").alias("edited_name"), "instruction", kept("manifest_line_no").alias("manifest_line_no"), kept("open_image_input_url").alias("url"))


@query("""select concat('magicbrush_dev_', s_suppkey, '_t', lpad((s_suppkey % 3 + 1)::varchar, 2, '0')) as triplet_id, 'dev' as split, s_suppkey % 3 = 0 as source_is_authentic, s_suppkey as row_index,
(select count(*) from (select unnest(range(16)) as i) where (i + s_suppkey) % 3 = 0) / 16.0::double as area from supplier""")
def turn_masks_written(spark, sf):
    """Turns with color masks, black where edited: their images written, and the stored masks read again."""
    root = scratch_path(spark, "turns")
    k = F.col("s_suppkey")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            masks = [(np.arange(16) + x) % 3 == 0 for x in frame["row_index"]]
            pixels = [np.repeat(np.where(m, 0, 90).astype(np.uint8).reshape(4, 4, 1), 3, axis=2) for m in masks]
            yield frame.assign(source_img=png.encode(np.zeros((4, 4, 3), np.uint8)), target_img=png.encode(np.ones((4, 4, 3), np.uint8)), mask_img=[png.encode(x) for x in pixels])

    base = table(spark, sf, "supplier").select(k.cast("string").alias("img_id"), (k % 3 + 1).cast("int").alias("turn_index"), F.col("s_name").alias("instruction"), k.cast("bigint").alias("row_index"))
    turns = base.mapInPandas(draw, "img_id string, turn_index int, instruction string, row_index bigint, source_img binary, target_img binary, mask_img binary")
    manifest.turn_images(turns, "dev", root).count()
    triplets = manifest.turn_triplets(turns, "dev", root.removeprefix("file://"))
    images = files.read_images(spark, root)
    artifacts = triplets.select("triplet_id", F.col("provided_mask_path").alias("mask_path"), F.lit("local").alias("edit_scope"))
    areas = stages.evaluate_masks(triplets, artifacts, images).select("triplet_id", F.col("gt_area_frac").alias("area"))
    kept = lambda c: F.get_json_object("metadata", f"$.{c}")
    return triplets.join(areas, "triplet_id").select("triplet_id", kept("split").alias("split"), kept("source_is_authentic").cast("boolean").alias("source_is_authentic"), kept("row_index").cast("bigint").alias("row_index"), "area")


@query("select o_orderkey % 4 as shard, case when o_orderkey % 4 < 2 then 1 else 2 end as run, count(*) as n, round(sum(o_totalprice), 2) as price from orders group by 1, 2")
def shards_resumed(spark, sf):
    """A run that writes two of four shards, then one over all that skips them."""
    folder = scratch_path(spark, "shards")
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("shard"), "o_totalprice")
    files.write_by_shard(rows.filter("shard < 2").withColumn("run", F.lit(1)), folder)
    files.write_by_shard(rows.withColumn("run", F.lit(2)), folder)
    back = spark.read.parquet(folder).groupBy(F.col("shard").cast("bigint").alias("shard"), "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return back.select("shard", "run", "n", "price")


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events
where user_id not in (select user_id from events where value > 250 and user_id is not null)) where r = 1""")
def dedup_after_done_shards(spark, sf):
    rows = table(spark, sf, "events")
    done = rows.filter("value > 250").select("user_id")
    return dedup.first_of_rest(rows, done, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"""with recursive {synthetic.MASKS_SQL}, t as (select concat('part_', p_partkey) as triplet_id, case when p_partkey % 10 = 0 then 2 else 1 end as n, p_partkey % 9 = 0 as old from part)
select sum(n)::bigint as n_triplets, coalesce(sum(n) filter (where old), 0)::bigint as n_skipped, coalesce(sum(n - 1) filter (where not old), 0)::bigint as n_duplicates,
count(*) filter (where not old and m.triplet_id is null) as n_unmatched, 0::bigint as n_failed, count(*) filter (where not old and m.triplet_id is not null) as n_scored from t left join masks m using (triplet_id)""")
def scoring_counters(spark, sf):
    rows = synthetic.triplets(spark, sf)
    masks = synthetic.mask_artifacts(spark, sf).withColumn("structural_change", F.col("combined_diff_mean"))
    return stages.difficulty_counts(rows.unionByName(rows.filter("p_partkey % 10 = 0")), masks, rows.filter("p_partkey % 9 = 0"))
