"""Table schemas, canonical values, and readers that fill absent columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# The canonical categories, bins, scopes and spatial descriptors, in their order.
CATEGORIES = (
    "object_addition", "object_removal", "object_replacement", "attribute_change", "style_transfer", "photometric",
    "scene_transformation", "background_change", "text_edit", "geometric", "human_centric", "other",
)
BINS = ("easy", "medium", "hard")
SCOPES = ("local", "global", "ambiguous", "alignment_failed")
SPATIAL = ("whole_image", "upper_left", "upper_right", "lower_left", "lower_right", "centered", "scattered", "alignment_failed")

DDL = {
    "triplets": "triplet_id STRING, source_dataset STRING, real_path STRING, edited_path STRING, instruction STRING, provided_mask_path STRING, metadata STRING",
    "mask_artifacts": "triplet_id STRING, mask_path STRING, mask_area_frac DOUBLE, edit_scope STRING, registration_ok BOOLEAN, confidence DOUBLE, diff_strongest_signal STRING, combined_diff_mean DOUBLE, mask_compactness DOUBLE",
    "difficulty_v1": "triplet_id STRING, structural_change DOUBLE, perceptual_change DOUBLE, locality DOUBLE, instruction_complexity DOUBLE, difficulty_raw DOUBLE, difficulty_bin STRING, weights STRING",
    "difficulty_v2": "triplet_id STRING, structural_change DOUBLE, compactness_score DOUBLE, instruction_complexity DOUBLE, difficulty_raw DOUBLE, difficulty_bin STRING, weights STRING",
    "categories": "triplet_id STRING, category STRING, confidence DOUBLE, source STRING, rationale STRING",
    "reasoning": "triplet_id STRING, header STRING, chain STRING, template_version STRING, category STRING, difficulty_bin STRING, spatial_descriptor STRING",
    "manifest": "open_image_input_url STRING, text STRING, output_image STRING, edit_type STRING, summarized_text STRING, local_input_image STRING",
    "turns": "img_id STRING, turn_index INT, instruction STRING, source_img BINARY, target_img BINARY, mask_img BINARY",
}
#: What a column that an older table lacks is read as; else null.
_DEFAULT_VALUES = {"combined_diff_mean": 0.0, "mask_compactness": float("nan")}
_REQUIRED = {"categories": ("triplet_id", "category", "confidence", "source", "rationale")}


def schema(name: str) -> StructType:
    return _parse_datatype_string(DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of table ``name``, in order and typed; absent ones get their default, else null.

    Categories must have all of their columns: a missing one is an error that names it.
    """
    missing = [c for c in _REQUIRED.get(name, ()) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {sorted(df.columns)}")
    made: list[Column] = []
    for f in schema(name).fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(_DEFAULT_VALUES.get(f.name))
        made.append(value.cast(f.dataType).alias(f.name))
    return df.select(made)


def difficulty_version(df: DataFrame) -> str:
    """Which difficulty table this is, by its columns."""
    if "compactness_score" in df.columns:
        return "difficulty_v2"
    if "locality" in df.columns:
        return "difficulty_v1"
    raise ValueError(f"no difficulty table: {sorted(df.columns)}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Reads a folder of Parquet files with drifting columns as table ``name``."""
    return conform(spark.read.option("mergeSchema", True).parquet(path), name)


def json_map(text: Column) -> Column:
    """A JSON object of numbers as a map; null or malformed text is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.create_map().cast("map<string,double>"))


def json_field(text: Column, name: str) -> Column:
    """A top-level JSON field as text; null where the text is no JSON or has no such field."""
    return F.get_json_object(text, f"$.{name}")
