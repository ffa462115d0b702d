"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset a local master gets a temporary folder, created once and stored in the
    session.  Any other master raises: its executors would not see a folder of the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("reeltally.scratch.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("reeltally.scratch.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below :func:`base_dir`."""
    return f"{base_dir(spark)}/reeltally-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that :func:`shared_dir` named."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: fixed rows that survive lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, app: str = "reeltally") -> SparkSession:
    """Session for tests and the single-machine bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
