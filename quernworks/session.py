"""Session helpers: building a session, table paths, and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quernworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, which any Spark file system may hold."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and everything runs in one process, as in tests, a local folder is set for
    the session; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), f"quernworks-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared scratch folder; it is removed when the driver's process ends."""
    path = f"{scratch_root(spark)}/quern-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` cut off from its lineage: written to the shared scratch folder and read again.

    The files outlive any executor, and their size is known to the planner, which may then
    broadcast a small table and shuffles a large one.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def freed(*tables: DataFrame) -> None:
    """Removes the files of tables from ``written`` that nothing reads any more, and shuffles of finished jobs.

    Spark drops a shuffle's files when the driver's JVM collects what refers to it, so it is told to; what
    ran last is held until something else has run.
    """
    for df in tables:
        drop_path(df.sparkSession, df._scratch)
        _written[:] = [(spark, path) for spark, path in _written if path != df._scratch]
    gc.collect()
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.range(1).collect()
        spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # a session that has ended cannot remove its scratch; another one's may still go
            continue


def sized(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A table from ``written``, to be broadcast if its files are small, else joined by a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if path_size(df.sparkSession, df._scratch) <= most_bytes else df
