"""Session settings, and shipping this package to executors that don't have it installed."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and laptops; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the session, once."""
    context = spark.sparkContext
    if getattr(context, "_concordia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="concordia-"), "concordia.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._concordia_shipped = True


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one on a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_concordia_scratch"):
        context._concordia_scratch = tempfile.mkdtemp(prefix="concordia-")
    return f"file://{context._concordia_scratch}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Have checkpoints written to the shared folder, where the session doesn't say another."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the process ends."""
    path = f"{scratch(spark)}/concordia/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path, for `remove` once nothing reads it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder, for results that several branches use."""
    return put(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before the process
        return
