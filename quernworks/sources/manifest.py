"""Manifests of image-edit records as triplets: JSON lines, or tables of turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import cache_name, id_stem, strip, turn_id
from ..image import kernels, png
from ..operators.dedup import collision_report, resolve_collisions
from ..schemas import conform, schema
from .files import download, write_images


@dataclass(frozen=True)
class ManifestConfig:
    manifest: str
    root: str
    on_collision: str = "drop_all"
    max_records: int | None = None
    cache: str | None = None
    download_missing: bool = False


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, from 1, blank lines left out.

    Lines are numbered by counts of the pieces they were read in: one pass counts, one numbers.
    """
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))  # a row a piece, not a line
    local = F.col("at") - F.shiftleft(F.col("part").cast("bigint"), 33)
    numbered = lines.join(F.broadcast(offsets), "part").select((F.col("before") + local + 1).alias("line_no"), "value")
    return numbered.filter(F.length(strip(F.col("value"))) > 0)


def parsed(lines: DataFrame, table: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """Rows of the well-formed lines, and the malformed lines."""
    kind = schema(table).add("_corrupt", "string")
    rows = lines.withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.filter(~bad).select("line_no", "r.*").drop("_corrupt"), rows.filter(bad).select("line_no", "value")


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below root, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = root.rstrip("/").removeprefix("file://")
    return files.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), f"^{base}/", "").alias("path"))


def _absolute(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/").removeprefix("file://") + "/"), path)


# What the metadata of a triplet keep of its line, by the column that has it.
_AUDIT = {
    "source_edit_type": "edit_type", "summarized_text": "summarized_text", "open_image_input_url": "open_image_input_url",
    "manifest_line_no": "line_no", "source_output_image": "output_image", "source_local_input_image": "local_input_image",
}


def manifest_triplets(spark: SparkSession, config: ManifestConfig, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """Triplets of a JSON-lines manifest, in line order up to ``max_records`` of those that remain.

    Ids are file-name stems; colliding stems are resolved before rows are checked, so a row that is
    itself no good still counts. Rows need an edited image that exists, a text, and a real image that
    exists, or that was downloaded to the cache under its URL's name; with ``download_missing``, those
    that neither folder has are fetched to the cache first (``fetch`` may stand for the network). The
    metadata keep what the manifest said.
    """
    lines, _ = parsed(numbered_lines(spark, config.manifest))
    rows = lines.withColumn("stem", id_stem(F.col("output_image"))).filter(F.col("stem").isNotNull())
    rows = resolve_collisions(rows, "stem", ["line_no"], config.on_collision)
    rows = rows.filter((F.length("output_image") > 0) & (F.length("text") > 0))
    files = file_listing(spark, config.root)
    rows = rows.join(files.withColumnRenamed("path", "output_image"), "output_image", "left_semi")
    local = files.select(F.col("path").alias("local_input_image"), F.lit(True).alias("here"))
    rows = rows.join(local, "local_input_image", "left")
    real = F.when(F.col("here"), _absolute(config.root, F.col("local_input_image")))
    if config.cache and config.download_missing:
        lacking = rows.filter(F.col("here").isNull() & (F.length("open_image_input_url") > 0)).select(F.col("open_image_input_url").alias("url"))
        download(lacking, config.cache, fetch=fetch).filter("file is null").count()  # runs it; files that are there stay
    if config.cache:
        cached = file_listing(spark, config.cache).select(F.col("path").alias("cached"), F.lit(True).alias("got"))
        rows = rows.withColumn("cached", cache_name(F.col("open_image_input_url"))).join(cached, "cached", "left")
        real = F.coalesce(real, F.when(F.col("got"), _absolute(config.cache, F.col("cached"))))
    extra = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in _AUDIT.items()]), {"ignoreNullFields": "false"})
    out = rows.select(
        "line_no", F.concat(F.lit("picobanana_"), "stem").alias("triplet_id"), F.lit("pico_banana").alias("source_dataset"), real.alias("real_path"),
        _absolute(config.root, F.col("output_image")).alias("edited_path"), F.col("text").alias("instruction"), extra.alias("metadata"),
    ).filter(F.col("real_path").isNotNull())
    if config.max_records is not None:
        out = out.orderBy("line_no").limit(config.max_records)
    return conform(out, "triplets")


def manifest_collisions(spark: SparkSession, manifest: str) -> DataFrame:
    lines, _ = parsed(numbered_lines(spark, manifest))
    return collision_report(lines.withColumn("stem", id_stem(F.col("output_image"))), "stem", "line_no")


def _turns(turns: DataFrame, split: str, single_turn_only: bool) -> DataFrame:
    """The turns that make triplets, with their ids; ``row_index``, where there is none, is unknown."""
    if split not in ("train", "dev"):
        raise ValueError(f"no such split: {split}")
    rows = turns if "row_index" in turns.columns else turns.withColumn("row_index", F.lit(None).cast("bigint"))
    rows = rows.filter((F.length("img_id") > 0) & F.col("turn_index").isNotNull() & (F.length("instruction") > 0) & F.col("source_img").isNotNull() & F.col("target_img").isNotNull())
    if single_turn_only:
        rows = rows.filter("turn_index = 1")
    return rows.withColumn("triplet_id", turn_id(F.lit(split), F.col("img_id"), F.col("turn_index")))


def turn_triplets(turns: DataFrame, split: str, root: str, single_turn_only: bool = False, max_records: int | None = None) -> DataFrame:
    """Triplets of a table of editing turns with images as bytes; image files are named below ``root``.

    Turns without an image, an instruction, an image id or an index are left out. The first turn's
    source is an authentic image; later ones were edited before. ``turn_images`` writes the files.
    """
    rows = _turns(turns, split, single_turn_only)
    file = lambda kind: F.concat(F.lit(root.rstrip("/") + "/"), F.col("triplet_id"), F.lit(f"__{kind}.png"))
    extra = F.to_json(F.struct("img_id", "turn_index", F.lit(split).alias("split"), (F.col("turn_index") == 1).alias("source_is_authentic"), "row_index"), {"ignoreNullFields": "false"})
    out = rows.select(
        "triplet_id", F.lit("magicbrush").alias("source_dataset"), file("real").alias("real_path"), file("edited").alias("edited_path"), "instruction",
        F.when(F.col("mask_img").isNotNull(), file("mask")).alias("provided_mask_path"), extra.alias("metadata"),
    )
    if max_records is not None:
        out = out.orderBy("triplet_id").limit(max_records)
    return conform(out, "triplets")


def turn_images(turns: DataFrame, split: str, folder: str, single_turn_only: bool = False, overwrite: bool = False) -> DataFrame:
    """Writes the images that ``turn_triplets`` names below ``folder``; (triplet_id, mask_path) of the files when it runs.

    Masks come as color with the edited region black or transparent, and are stored white for edited.
    """
    rows = _turns(turns, split, single_turn_only)

    def masks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=[png.encode(kernels.provided_mask(png.decode(x))) for x in frame["content"]])

    of = lambda column, kind: rows.select(F.concat("triplet_id", F.lit(f"__{kind}")).alias("triplet_id"), F.col(column).alias("content"))
    mask = of("mask_img", "mask").filter("content is not null").mapInPandas(masks, "triplet_id string, content binary")
    every = of("source_img", "real").unionByName(of("target_img", "edited")).unionByName(mask)
    return write_images(every, folder, "content", overwrite)


ADAPTERS = {"pico_banana": manifest_triplets, "magicbrush": turn_triplets}
