"""Explanations in six numbered sentences, their headers, and training targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import percent, strip, two_decimals

TEMPLATE_VERSION = "v1.0"
# What edits of a category typically show.
PRIORS = {
    "object_addition": "boundary discontinuities at the edge of the inserted region, and lighting or shadow inconsistencies between the new object and its surrounding scene",
    "object_removal": "inpainting artifacts where the removed object used to be, such as blurred or repeated texture patches that disagree with the surrounding context",
    "object_replacement": "boundary mismatches at the silhouette of the new object, plus scale or perspective inconsistencies if the replacement does not match the original object's geometry",
    "attribute_change": "color or texture discontinuities along the object's boundary where the edited region meets its preserved surroundings, often without changes elsewhere in the image",
    "style_transfer": "global texture and brushstroke patterns inconsistent with natural photography, applied uniformly across the image regardless of original content",
    "photometric": "a global histogram shift or noise overlay applied uniformly to all pixels, with the underlying image content semantically unchanged from the original",
    "scene_transformation": "globally consistent changes in lighting, color temperature, or weather effects that affect the whole scene coherently rather than any single object",
    "background_change": "a sharp transition between a preserved foreground subject and a newly-introduced background, sometimes with mismatched lighting or perspective at the boundary",
    "text_edit": "font or rendering artifacts in the modified text region — inconsistent letter spacing, mismatched typefaces, or rendering noise distinct from the original photographic text",
    "geometric": "canvas-level transformations such as cropped boundaries, scaled content, or extrapolated regions outside the original frame, rather than localized object edits",
    "human_centric": "subject-localized stylization or attribute changes confined to a person, with the surrounding scene preserved; identity-preserving transformations often introduce distinctive rendering artifacts around the face and hair",
    "other": "edit characteristics depend on the specific operation; without a confirmed category, look broadly for any local boundary discontinuities or global statistical shifts",
}
# Where an edit lies, in words.
SPATIAL_PROSE = {
    "whole_image": "spans the entire image",
    "upper_left": "is concentrated in the upper-left region",
    "upper_right": "is concentrated in the upper-right region",
    "lower_left": "is concentrated in the lower-left region",
    "lower_right": "is concentrated in the lower-right region",
    "centered": "is centered in the image",
    "scattered": "is scattered across multiple regions of the image",
    "alignment_failed": "could not be localized due to image alignment failure",
}
# The sentences; {} stands for what a row says.
NO_INSTRUCTION = "1. No explicit instruction text is available; the edit must be inferred from visual evidence alone."
COMPACT = ("well-concentrated in a single coherent region", "moderately concentrated", "diffuse or split across multiple sub-regions")
MAGNITUDE = ("minor", "moderate", "substantial")
EVIDENCE_LABEL = "based on the dataset's curated edit-type label"
EVIDENCE_UNMAPPED = "from the dataset label, though that label is not in our canonical mapping"
EVIDENCE_RULE = "inferred from the instruction text via a rule-based keyword match (confidence {})"
EVIDENCE_NONE = "could not be determined confidently from the available signals; treated as an unspecified edit type"
EASY = "easier than average to detect, given clear local geometry and a low-complexity instruction"
HARD = "harder than average to detect, given diffuse geometry or a high-complexity instruction"
MEDIUM = "of moderate detection difficulty"
PROMPT = 'You are a forensic image-edit detector. Given a (real, edited) image pair and the edit instruction, produce a structured analysis of the edit.\n\nInstruction: "{}"'


def filled(template: str, *values: Column) -> Column:
    """The template with its {} filled in; null if a value is."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(part)]
    return F.concat(*pieces)


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table's text for key, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def header(category: Column, scope: Column, bin_: Column, source: Column) -> Column:
    return filled("[category={}, scope={}, difficulty={}, source={}]", category, scope, bin_, source)


def step_instruction(instruction: Column) -> Column:
    text = strip(F.coalesce(instruction, F.lit("")))
    short = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) > 0, filled('1. The edit instruction states: "{}".', short)).otherwise(F.lit(NO_INSTRUCTION))


def _thirds(x: Column, low: float, high: float, phrases: tuple[str, str, str]) -> Column:
    return F.when(x < low, F.lit(phrases[0])).when(x > high, F.lit(phrases[2])).otherwise(F.lit(phrases[1]))


def evidence(source: Column, confidence: Column, shown: Column) -> Column:
    labelled = F.when(confidence >= 0.99, F.lit(EVIDENCE_LABEL)).otherwise(F.lit(EVIDENCE_UNMAPPED))
    return F.when(source == "dataset_label", labelled).when(source == "rule_based", filled(EVIDENCE_RULE, shown)).otherwise(F.lit(EVIDENCE_NONE))


def with_chain(rows: DataFrame) -> DataFrame:
    """Adds header, chain and template_version to rows that hold a triplet's instruction, mask, difficulty and category.

    Numbers are shown with two decimals by one Arrow function, which formats exactly; the rest is
    plain expressions. An unknown spatial descriptor gives a null chain.
    """
    shown = {"struct": "structural_change", "conf": "confidence", "raw": "difficulty_raw", "comp": "instruction_complexity"}
    rows = rows.withColumns({f"_{k}": two_decimals(F.col(c).cast("double")) for k, c in shown.items()})
    prior = F.coalesce(_lookup(PRIORS, F.col("category")), F.lit(PRIORS["other"]))
    bin_phrase = F.when(F.col("difficulty_bin") == "easy", F.lit(EASY)).when(F.col("difficulty_bin") == "hard", F.lit(HARD)).otherwise(F.lit(MEDIUM))
    steps = [
        step_instruction(F.col("instruction")),
        filled("2. The mask of changed pixels covers roughly {}% of the image and {}.", percent(F.col("mask_area_frac")), _lookup(SPATIAL_PROSE, F.col("spatial_descriptor"))),
        filled("3. Structural change relative to the original is {} (SSIM-based score = {}), and the edit region is {}.", _thirds(F.col("structural_change"), 0.25, 0.55, MAGNITUDE), F.col("_struct"), _thirds(F.col("compactness_score"), 0.3, 0.6, COMPACT)),
        filled("4. The edit is classified as {}, {}.", F.col("category"), evidence(F.col("source"), F.col("confidence"), F.col("_conf"))),
        filled("5. Edits of this type typically exhibit {}.", prior),
        filled("6. Overall, this triplet is {} (difficulty score = {}, instruction complexity = {}).", bin_phrase, F.col("_raw"), F.col("_comp")),
    ]
    whole = steps[0]
    for s in steps[1:]:
        whole = F.concat(whole, F.lit("\n"), s)
    rows = rows.withColumn("header", header(F.col("category"), F.col("edit_scope"), F.col("difficulty_bin"), F.col("source")))
    return rows.withColumn("chain", whole).withColumn("template_version", F.lit(TEMPLATE_VERSION)).drop(*[f"_{k}" for k in shown])


def target(mode: str, chain: Column, category: Column, spatial: Column, bin_: Column) -> Column:
    """What a model learns to answer: the chain, or a JSON object of the three labels."""
    if mode == "chain":
        return chain
    if mode == "label_only":
        quoted = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
        return F.concat(F.lit("{"), quoted("category", category), F.lit(", "), quoted("spatial_descriptor", F.coalesce(spatial, F.lit("centered"))), F.lit(", "), quoted("difficulty_bin", bin_), F.lit("}"))
    raise ValueError(f"no such target: {mode}")


def prompt(instruction: Column) -> Column:
    return filled(PROMPT, F.coalesce(instruction, F.lit("")))
