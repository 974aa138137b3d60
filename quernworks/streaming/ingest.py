"""Incremental ingestion: new files of a folder as they come, each row once, with resumable progress.

The same expressions as in batch run here; only the source and the sink differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def new_rows(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema(table)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_key(rows: DataFrame, key: str, seen_at: str, delay: str = "1 day") -> DataFrame:
    """Each key's first row; keys are remembered for ``delay`` of event time, so state is bounded."""
    return rows.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([key])


def run_available(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Transforms what has arrived since the last run, appends it, and returns when all is done."""
    out = transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_rates(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and kind, final once the watermark has passed."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, window), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def refresh_tertiles(rows: DataFrame, score: str, target: str, checkpoint: str) -> None:
    """After each batch, writes the tertile bounds over all scores stored so far."""

    def each(batch: DataFrame, _: int) -> None:
        batch.select(score).write.mode("append").parquet(f"{target}/scores")
        scores = batch.sparkSession.read.parquet(f"{target}/scores")
        scores.agg(F.count(score).alias("n"), F.percentile(score, F.lit(1 / 3)).alias("q33"), F.percentile(score, F.lit(2 / 3)).alias("q66")).write.mode("overwrite").parquet(f"{target}/bounds")

    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
