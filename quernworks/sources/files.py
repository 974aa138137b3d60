"""Reading and writing artifact tables, shards, images, labels and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..image import png
from ..operators.dedup import with_position
from ..schemas import read_table


def shard_paths(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a folder in name order, in whatever file system it is; an error for none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath().toString()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "part-*.parquet")) or [])
    if not found:
        raise FileNotFoundError(f"no part-*.parquet in {folder}")
    return found


def select_shards(paths: list[str], indices: list[int] | None) -> list[str]:
    """The shards at these places; all for None."""
    if indices is None:
        return paths
    odd = [i for i in indices if not 0 <= i < len(paths)]
    if odd:
        raise IndexError(f"shards {odd} of {len(paths)}")
    return [paths[i] for i in indices]


def read_shards(spark: SparkSession, folder: str, table: str | None = None, indices: list[int] | None = None, positions: bool = False) -> DataFrame:
    """Shards as one table; with ``positions``, the order columns that keep-last needs."""
    if table and indices is None and not positions:
        return read_table(spark, folder, table)
    df = spark.read.option("mergeSchema", True).parquet(*select_shards(shard_paths(spark, folder), indices))
    return with_position(df) if positions else df


def append_rows(df: DataFrame, folder: str, most_rows: int = 10_000) -> None:
    """Adds files of at most ``most_rows`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", most_rows).parquet(folder)


def write_by_shard(df: DataFrame, folder: str, shard: str = "shard", overwrite: bool = False) -> int:
    """Writes a folder a shard. Shards that are there are skipped, or with ``overwrite`` replaced; returns how many were written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    rows = df if overwrite else df.filter(~F.col(shard).cast("string").isin(there))
    new = rows.select(shard).distinct().count()
    if new:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(folder)
    return new


def replace_table(df: DataFrame, folder: str) -> None:
    """Writes beside the folder, then swaps: rows may come from the folder itself."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    here, new, old = (jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + x) for x in ("", ".new", ".old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def write_report(row: DataFrame, path: str) -> dict:
    """A one-row table as an indented JSON file; also returned."""
    found = json.loads(row.toJSON().first() or "{}")
    spark = row.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(found, indent=2).encode()))
    out.close()
    return found


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def describe(df: DataFrame, n: int = 3, width: int = 100) -> dict:
    """Schema, row count and the first rows, with long strings cut."""
    rows = [{k: v[:width] if isinstance(v, str) else v for k, v in r.asDict().items()} for r in df.limit(n).collect()]
    return {"columns": dict(df.dtypes), "rows": df.count(), "sample": rows}


def read_labels(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of hand-given labels; other values than easy, medium and hard are an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    labels = json.loads(text)
    odd = {k: v for k, v in labels.items() if v not in ("easy", "medium", "hard")}
    if odd:
        raise ValueError(f"labels must be easy, medium or hard: {odd}")
    return labels


def _png_of_pixels(images: DataFrame) -> DataFrame:
    """(path, content): images that the JVM has decoded, as PNG bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for height, width, channels, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                # blue, green, red, and maybe alpha
                contents.append(png.encode(pixels[..., 0] if channels == 1 else pixels[..., [2, 1, 0, 3][:channels]]))
            yield pd.DataFrame({"path": frame["origin"], "content": contents})

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "path string, content binary")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): image files below a folder as PNG bytes, one row a file.

    PNG files are taken as they are; JPEG files are decoded by Spark's image source, and those that it
    cannot read are left out. There is no reader of WebP here; such files come as they are.
    """
    read = lambda kind, names: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    plain = read("binaryFile", "*.{png,PNG,webp,WEBP}").load(folder).select("path", "content")
    jpeg = read("image", "*.{jpg,jpeg,JPG,JPEG}").option("dropInvalid", True).load(folder)
    both = plain.unionByName(_png_of_pixels(jpeg))
    return both.select(F.regexp_replace("path", r"^file:/*(?=/)", "").alias("path"), "content")


def image_pairs(triplets: DataFrame, images: DataFrame) -> DataFrame:
    """(triplet_id, real, edited): triplets with the bytes of both images; those that lack one go."""
    real = images.select(F.col("path").alias("real_path"), F.col("content").alias("real"))
    edited = images.select(F.col("path").alias("edited_path"), F.col("content").alias("edited"))
    return triplets.join(real, "real_path").join(edited, "edited_path").select("triplet_id", "real", "edited")


def write_rows_beside(rows: DataFrame, report: str) -> str:
    """Writes the rows behind a report ``x.json`` as the Parquet folder ``x.per_triplet.parquet`` and returns its path."""
    path = report.removesuffix(".json") + ".per_triplet.parquet"
    rows.write.mode("overwrite").parquet(path)
    return path


def write_images(rows: DataFrame, folder: str, content: str = "mask_png", overwrite: bool = True) -> DataFrame:
    """Writes (triplet_id, content) as files by temporary names; returns (triplet_id, mask_path) when it runs.

    ``folder`` is a URI that executors can write. A file that is there and not empty stays unless
    ``overwrite``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            paths = []
            for name, data in zip(frame["triplet_id"], frame[content], strict=True):
                path = f"{root}/{name}.png"
                there = store.get_file_info(path)
                if overwrite or not (there.type == fs.FileType.File and there.size):
                    with store.open_output_stream(path + ".partial") as out:
                        out.write(data)
                    store.move(path + ".partial", path)
                paths.append(path)
            yield pd.DataFrame({"triplet_id": frame["triplet_id"], "mask_path": paths})

    return rows.select("triplet_id", content).mapInPandas(run, "triplet_id string, mask_path string")


def download(urls: DataFrame, folder: str, timeout: float = 15.0, fetch=None) -> DataFrame:
    """(url, file): fetched files under their cache names; null where a fetch failed. Files that are there stay."""
    from ..functions.exact import cache_name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.request import urlopen

        from pyarrow import fs

        get = fetch or (lambda url: urlopen(url, timeout=timeout).read())  # noqa: S310
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            files = []
            for url, name in zip(frame["url"], frame["name"], strict=True):
                path = f"{root}/{name}"
                try:
                    if not store.get_file_info(path).size:
                        data = get(url)
                        with store.open_output_stream(path + ".partial") as out:
                            out.write(data)
                        store.move(path + ".partial", path)
                    files.append(path)
                except Exception:
                    files.append(None)
            yield pd.DataFrame({"url": frame["url"], "file": files})

    named = urls.select("url", cache_name(F.col("url")).alias("name")).distinct()
    return named.mapInPandas(run, "url string, file string")
