"""Running a bounded or continuous stream into a table of per-batch outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reeltally.plans.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int | None = None, recursive: bool = False) -> DataFrame:
    """Parquet data at ``path`` (a folder, with those below it if ``recursive``, or one file) as a stream; the trigger size bounds one micro-batch."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", str(recursive).lower())
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    # As a glob the path may also name a single file.
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, *, mode: str = "update", path: str | None = None) -> DataFrame:
    """Runs everything available and returns the rows written, with their ``batch``.

    Each micro-batch overwrites its own folder, so a replayed batch is never counted twice.
    """
    spark = stream.sparkSession
    base = path or shared_dir(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(_with_batch(stream.schema)).option("basePath", f"{base}/out").parquet(f"{base}/out")


def _with_batch(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("batch", "long")


def use_rocksdb(spark: SparkSession) -> None:
    """State store that the stateful processors need; set on the cluster session where it is managed."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKSDB:
        spark.conf.set(key, ROCKSDB)
