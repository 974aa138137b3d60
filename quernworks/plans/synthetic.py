"""Triplets and mask grids made from the driver's tables, as expressions that Spark and DuckDB both read.

The tables' own texts hold hardly any edit words, so instructions are sentences around part names, with
cases for every rule, for none, and for empty, null, accented and carriage-return texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids
from ..session import table

# Sentences by p_partkey % 34; {p} is the part's name, {r} a carriage return, None null.
SENTENCES = [
    "paint it in the style of {p}", "turn the {p} into a cartoon", "make it snowing over the {p}", "show the {p} in winter",
    "decorate the {p} for christmas", "put the {p} at sunset", "make the {p} brighter", "remove the {p} from the left corner",
    "change the background behind the {p}", "replace the {p} and then the cup", "swap the {p} with a dog", "turn the {p} into stone",
    "add a {p} near the edge", "give him a {p}", "the man is wearing a {p}", "write a caption below the {p}",
    "recolor the {p} to something blue", "let the {p} be red", "the {p} should be bigger", "a {p} of leather",
    "rotate the {p} while zoom is on", "nothing to see here about the {p}", "", None,
    "una {p} más allá, señor", "make the {p}{r}more red", "ADD A {p} BUT ALSO A HAT", "illuminate the {p}",
    "give the dog another {p}", "   blank around the {p}   ", "make the top {p} blue and move the bottom one, then blur it", "have a large {p} be green now",
    "flip the {p}", "erase text on the {p}",
]
# Label values by p_partkey % 9; {q} is an apostrophe. None: text that is no JSON.
LABELS = ["Zoom in", "  Add a new object to the scene ", "change an object{q}s attribute (e.g., color/material)", "modern ↔ historical style/look", "an unheard-of label", "  ", None, "Change age / gender", "remove an existing object"]


def _text(template: str | None) -> str:
    if template is None:
        return "cast(null as string)"
    parts = []
    for i, piece in enumerate(template.split("{p}")):
        if i:
            parts.append("p_name")
        for j, bit in enumerate(piece.split("{r}")):
            if j:
                parts.append("chr(13)")
            for k, x in enumerate(bit.split("{q}")):
                if k:
                    parts.append("chr(39)")
                if x:
                    parts.append(f"'{x}'")
    return f"concat({', '.join(parts)})" if parts else "''"


def _choice(key: str, texts: list[str]) -> str:
    whens = " ".join(f"when {i} then {t}" for i, t in enumerate(texts))
    return f"case {key} % {len(texts)} {whens} end"


TRIPLETS = {
    "triplet_id": "concat('part_', cast(p_partkey as string))",
    "source_dataset": "case when p_partkey % 2 = 0 then 'Pico-Banana' else 'magicbrush' end",
    "real_path": "concat('/images/real/', cast(p_partkey as string), '.png')",
    "edited_path": "concat('/images/edited/', cast(p_partkey as string), '.png')",
    "instruction": _choice("p_partkey", [_text(s) for s in SENTENCES]),
    "provided_mask_path": "case when p_partkey % 3 = 0 then concat('/masks/', cast(p_partkey as string), '.png') else null end",
    "metadata": _choice("p_partkey", ["'{not json'" if x is None else f"concat('{{\"source_edit_type\": \"', {_text(x)}, '\"}}')" for x in LABELS]),
}
TRIPLETS_SQL = f"select {', '.join(f'{v} as {k}' for k, v in TRIPLETS.items())}, p_partkey from part"
#: The value at which normalised grids are cut.
CUT = 0.5


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(*[F.expr(v).alias(k) for k, v in TRIPLETS.items()], "p_partkey")


def grid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, d, e): two 8 x 8 maps from each even embedding and the next, |x - y| and |x + y|."""
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    pairs = rows.filter("vec_id % 2 = 0").join(other, "vec_id")
    plus = F.zip_with(grids.doubles(F.col("embedding")), grids.doubles(F.col("y")), lambda a, b: F.abs(a + b))
    return pairs.select("vec_id", "label", grids.difference(F.col("embedding"), F.col("y")).alias("d"), plus.alias("e"))


def normalized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, nd, ne): both maps normalised."""
    rows = grids.with_normalized(grid_pairs(spark, sf_dir), "d", "nd")
    return grids.with_normalized(rows, "e", "ne").drop("d", "e")


def mask_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask columns of the pairs' mean maps, for the triplet of the same number."""
    rows = normalized_pairs(spark, sf_dir).withColumn("g", grids.combine_mean(F.col("nd"), F.col("ne")))
    strongest = grids.strongest({"d": grids.mean(F.col("nd")), "e": grids.mean(F.col("ne"))})
    rows = grids.with_shape(grids.route(rows.withColumn("diff_strongest_signal", strongest), "g", CUT), "mask", 8)
    return rows.select(F.concat(F.lit("part_"), F.expr("vec_id div 2").cast("string")).alias("triplet_id"), "vec_id", "label", *[F.round(c, 6).alias(c) for c in ("mask_area_frac", "confidence", "combined_diff_mean", "mask_compactness")], "edit_scope", "spatial_descriptor", "diff_strongest_signal")


GRIDS_SQL = """
pair as (select a.vec_id, a.label, list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double)) as d,
  list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double + b.embedding[i]::double)) as e
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
tops as (select *, list_aggregate(d, 'quantile_cont', 0.99) as td, list_aggregate(e, 'quantile_cont', 0.99) as te from pair),
norm as (select vec_id, label, list_transform(d, lambda x: least(greatest(x / td, 0.0::double), 1.0::double)) as nd,
  list_transform(e, lambda x: least(greatest(x / te, 0.0::double), 1.0::double)) as ne from tops)"""
MASKS_SQL = GRIDS_SQL + f""",
comb as (select *, list_transform(range(1, 65), lambda i: (nd[i] + ne[i]) / 2) as g from norm),
stat as (select *, list_avg(g) as mean_g, sqrt(greatest(list_sum(list_transform(g, lambda x: x * x)) / 64 - list_avg(g) * list_avg(g), 0)) as std_g,
  list_transform(g, lambda x: x > {CUT}) as cutm from comb),
part_ as (select *, len(list_filter(cutm, lambda x: x)) / 64.0::double as area0, list_sum(list_filter(g, lambda x: x > {CUT})) as over_s, list_sum(g) as all_s from stat),
routed as (select *, case when std_g < 1e-4 then mean_g >= 0.5 else mean_g >= 0.4 end as whole from part_),
masked as (select vec_id, label, nd, ne, mean_g, area0,
  case when whole then 'global' when std_g < 1e-4 then 'ambiguous' when area0 >= 0.9 then 'global' when area0 <= 0.005 then 'ambiguous' else 'local' end as edit_scope,
  case when whole then least(greatest(mean_g, 0), 1) when std_g < 1e-4 then 0 when area0 in (0, 1) then 0
    else least(greatest(over_s / (area0 * 64) - (all_s - over_s) / (64 - area0 * 64), 0), 1) end as confidence,
  case when whole or (std_g >= 1e-4 and area0 >= 0.9) then list_transform(g, lambda x: true) when std_g < 1e-4 then list_transform(g, lambda x: false) else cutm end as mask
  from routed),
cells as (select vec_id, i // 8 as y, i % 8 as x from (select vec_id, mask, unnest(range(64)) as i from masked) where mask[i + 1]),
reach as (select vec_id, y, x, y as ty, x as tx from cells
  union select r.vec_id, r.y, r.x, c.y, c.x from reach r join cells c on c.vec_id = r.vec_id and abs(c.y - r.ty) + abs(c.x - r.tx) = 1),
sizes as (select vec_id, y, x, count(*) as n, min(ty * 8 + tx) as comp from reach group by all),
shape as (select vec_id, count(*) as area, max(n) as largest, count(distinct comp) as comps, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) as box, avg(y) / 8 as cy, avg(x) / 8 as cx from sizes group by vec_id),
masks as (select concat('part_', vec_id // 2) as triplet_id, vec_id, label, round(len(list_filter(mask, lambda x: x)) / 64.0::double, 6) as mask_area_frac, edit_scope,
  round(confidence, 6) as confidence, round(mean_g, 6) as combined_diff_mean,
  round(coalesce(sqrt(area / box::double * (largest / area::double)), 0), 6) as mask_compactness,
  case when edit_scope = 'global' then 'whole_image' when area is null then 'alignment_failed' when comps > 1 and largest / area::double < 0.3 then 'scattered'
    when abs(cy - 0.5) <= 0.25 and abs(cx - 0.5) <= 0.25 then 'centered'
    else concat(case when cy < 0.5 then 'upper' else 'lower' end, case when cx < 0.5 then '_left' else '_right' end) end as spatial_descriptor,
  case when list_avg(nd) >= list_avg(ne) then 'd' else 'e' end as diff_strongest_signal
  from masked left join shape using (vec_id))"""
