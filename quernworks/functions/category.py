"""Edit categories of instructions: by dataset label where there is one, else by the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, json_field
from .exact import strip

# The labels of the labelled dataset, lower-cased, by category.
LABELS = {
    "object_addition": ["add a new object to the scene"],
    "object_removal": ["remove an existing object"],
    "object_replacement": ["replace one object category with another"],
    "attribute_change": ["change an object's attribute (e.g., color/material)", "change the size/shape/orientation of an object"],
    "style_transfer": ["strong artistic style transfer (e.g., van gogh/anime/etc.)", "modern ↔ historical style/look", "photo to cartoon/sketch/comic"],
    "photometric": ["add film grain or vintage filter", "change overall color tone (warm ↔ cool)"],
    "scene_transformation": [
        "apply seasonal transformation (summer ↔ winter)",
        "adjust global lighting (golden hour/fluorescent)",
        "change weather conditions (sunny/rainy/snowy)",
        "add new scene context/background",
    ],
    "text_edit": [
        "add new (handwritten/printed/etc) text",
        "replace text in signs/posters/billboards",
        "translate written text into other languages",
        "change font style or color of visible text if there is text",
    ],
    "geometric": ["zoom in", "outpainting (extend canvas beyond boundaries)", "relocate an object (change its position/spatial relation)"],
    "human_centric": [
        "clothing edit (change color/outfit)",
        "change age / gender",
        "add/remove/replace accessories (glasses, hats, jewelry, masks)",
        "modify expressions (smile, frown, neutral)",
        "pose tweak (minor plausible change)",
        "funko-pop–style toy figure of the person",
        "lego-minifigure rendition of the person",
        "line-art ink sketch of the person",
        "simpsonize the person (yellow-skin cartoon style)",
        "sticker-ify the person with bold outline and white border",
        "convert person to 2d anime/manga style (identity-preserving)",
        "convert person to pixar/disney-like 3d cartoon look",
        "convert person to western comic cel-shaded style",
        "caricature with mild feature exaggeration (keep identity)",
    ],
}
_COLORS = "red|blue|green|yellow|black|white|gold|silver|purple|orange|pink|brown|gray|grey"
# Fixed values: (tag, category, confidence, pattern), the first that is found decides.
RULES = [
    ("style-of", "style_transfer", 0.85, r"\b(style of|in the style|artistic|van gogh|monet|picasso)\b"),
    ("style-keyword", "style_transfer", 0.80, r"\b(cartoon|comic|sketch|painting|anime|watercolor|oil paint)\b"),
    ("weather", "scene_transformation", 0.70, r"\b(weather|rain(?:ing|y)?|snow(?:ing|y)?|fog(?:gy)?|cloud(?:y|s)?|sunny|storm(?:y|ing)?|wind(?:y)?)\b"),
    ("season", "scene_transformation", 0.70, r"\b(season|winter|summer|autumn|fall|spring)\b"),
    ("holiday", "scene_transformation", 0.75, r"\b(christmas|halloween|easter|thanksgiving|hanukkah|diwali|valentine|new year)\b"),
    ("time-of-day", "scene_transformation", 0.70, r"\b(night(?:time)?|day(?:time)?|morning|evening|sunset|sunrise|dusk|dawn|midnight|noon)\b"),
    ("lighting", "scene_transformation", 0.65, r"\b(lighting|illuminat|shadow|dark(?:er|en)?|bright(?:er|en)?)\b"),
    ("remove", "object_removal", 0.85, r"\b(remove|delete|erase|get rid of|take off|take out)\b"),
    ("background", "background_change", 0.75, r"\b(background|backdrop)\b"),
    ("replace", "object_replacement", 0.85, r"\breplace\b"),
    ("swap", "object_replacement", 0.80, r"\bswap\b"),
    ("turn-into", "object_replacement", 0.70, r"\bturn\b\s+(?:\w+\s+){1,3}into\b"),
    ("add", "object_addition", 0.80, r"\b(add|insert|put|place)\b"),
    ("give", "object_addition", 0.75, r"\bgive\b\s+(?:him|her|it|them|the\s+\w+)\b"),
    ("wear-hold", "object_addition", 0.65, r"\b(wear(?:ing|s)?|hold(?:ing|s)?)\b"),
    ("text-keyword", "text_edit", 0.70, r"\b(text|sign|label|caption|word|letter)\b"),
    ("color", "attribute_change", 0.80, rf"\b(make|change|recolor|repaint).*\b(color|{_COLORS})\b"),
    ("frame-color", "attribute_change", 0.70, rf"\b(let|have|make|is now|are now)\b\s+(?:\w+\s+){{0,3}}\b({_COLORS})\b"),
    ("size", "attribute_change", 0.70, r"\b(bigger|smaller|larger|taller|shorter|longer|wider|thinner|thicker|fatter|skinnier|huge|tiny|massive)\b"),
    ("material", "attribute_change", 0.75, r"\b(material|texture|wooden|metal|plastic|glass|leather|fabric)\b"),
    ("geometric-op", "geometric", 0.85, r"\b(crop|zoom|rotate|flip|mirror)\b"),
]
LABELLED_SOURCE = "pico_banana"


def label_table(spark, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(label, label_category): one row a label, of a size the code fixes."""
    rows = [(text, category) for category, texts in (labels or LABELS).items() for text in texts]
    return spark.createDataFrame(rows, "label string, label_category string")


def _first_rule(text: Column, rules: list[tuple]) -> Column:
    """The first fitting rule as (category, confidence, source, rationale); null where none fits.

    Unicode word characters, case ignored, and only \\n ends a line for the dot.
    """
    made = None
    for tag, category, confidence, pattern in rules:
        verdict = F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit("rule_based").alias("source"), F.lit(f"rule:{tag}").alias("rationale"))
        fits = F.regexp_like(text, F.lit(f"(?iUd){pattern}"))
        made = F.when(fits, verdict) if made is None else made.when(fits, verdict)
    return made


def classify(triplets: DataFrame, labels: dict[str, list[str]] | None = None, rules: list[tuple] | None = None, unknown_confidence: float = 0.5) -> DataFrame:
    """One category row per triplet: triplet_id, category, confidence, source, rationale.

    Rows of the labelled dataset with a non-blank source_edit_type go by its label, others by rules.
    Null instructions count as empty. The label table is broadcast: the code fixes its size.
    """
    field = json_field(F.col("metadata"), "source_edit_type")
    labelled = (F.lower(F.regexp_replace("source_dataset", "-", "_")) == LABELLED_SOURCE) & (F.length(strip(field)) > 0)
    rows = triplets.withColumn("_raw", F.when(F.coalesce(labelled, F.lit(False)), field))
    rows = rows.withColumn("_label", F.lower(strip(F.col("_raw"))))
    table = label_table(triplets.sparkSession, labels)
    rows = rows.join(F.broadcast(table), rows["_label"] == table["label"], "left")
    text = F.coalesce("instruction", F.lit(""))
    result = lambda category, confidence, source, rationale: F.struct(category.alias("category"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), rationale.alias("rationale"))
    by_label = F.when(F.col("label").isNotNull(), result(F.col("label_category"), 1.0, "dataset_label", F.concat(F.lit("label:"), "_raw"))).otherwise(
        result(F.lit("other"), unknown_confidence, "dataset_label", F.concat(F.lit("unmapped:"), F.substring("_raw", 1, 80)))
    )
    fallback = result(F.lit("other"), 0.2, "fallback", F.concat(F.lit("no-rule-matched:"), F.substring(text, 1, 60)))
    verdict = F.when(F.col("_raw").isNotNull(), by_label).otherwise(F.coalesce(_first_rule(text, rules or RULES), fallback))
    return rows.select("triplet_id", verdict.alias("v")).select("triplet_id", "v.category", "v.confidence", "v.source", "v.rationale")


def category_counts(categories: DataFrame) -> DataFrame:
    """Counts of all canonical categories, zeros included."""
    spark = categories.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return names.join(categories.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("n"))


def source_counts(categories: DataFrame) -> DataFrame:
    """Counts by how the category was found, and the share of ``other`` among all."""
    other = categories.agg(F.avg(F.when(F.col("category") == "other", 1.0).otherwise(0.0)).alias("fraction_other"))
    return categories.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(other))
