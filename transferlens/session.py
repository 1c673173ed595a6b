"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Of written steps. Keys are hex digits, which take half the bytes of Spark's default here.
CODEC = "zstd"
# Bytes of a written step after which the shuffle files behind it are worth deleting at once.
LARGE_STEP = 16 << 20


def build_session(app_name: str = "transferlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so a missing setting is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    active = sc.getCheckpointDir()
    if folder:
        if active is None:
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if active is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="transferlens-"))
        active = sc.getCheckpointDir()
    return active.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet (with the writer's ``options``) and read them back.

    Unlike a checkpoint the table stays columnar, so later steps prune columns and push filters
    down, and Spark knows its size. ``discard`` deletes the written table again.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.options(**{"compression": CODEC, **options}).parquet(path)
    if _size(df.sparkSession, path) >= LARGE_STEP:
        forget_shuffles(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_step = path
    return back


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reread(df: DataFrame, **conf: str) -> DataFrame:
    """What ``materialise`` wrote for this table, read by a session of its own with other settings; ``conf`` keys use ``__`` for dots."""
    spark, path = df.sparkSession, df._written_step
    other = spark.newSession()
    settings = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and spark.conf.isModifiable(k)}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        other.conf.set(key, value)
    back = other.read.schema(df.schema).parquet(path)
    back._written_step, df._written_step = path, None
    return back


def _size(spark: SparkSession, path: str) -> int:
    java_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(java_path).getLength()


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these very tables, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_written_step", None)
        if path:
            java_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            java_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(java_path, True)
            df._written_step = None


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism or os.cpu_count() or 1)
