"""Media-shaped views of the driver tables.

The driver data holds no media, so each view derives one operator input from it by plain
expressions that the oracle views repeat in SQL.  Row numbers go through blocks, so a
hot file never becomes one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.plans.blocks import numbered
from reeltally.plans.session import shared_dir
from reeltally.streaming.runner import open_stream


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").withColumn("t_us", micros)


def packets(spark: SparkSession, sf: str, *, keep_id: bool = False) -> DataFrame:
    e = events(spark, sf)
    i = F.col("event_id")
    p = e.select(
        (F.col("user_id") % 10).alias("file_id"),
        F.expr("(user_id div 10) % 3").alias("stream_index"),
        i,
        F.when(i % 11 != 0, F.col("t_us")).alias("pts_us"),
        F.when(i % 13 != 0, F.col("t_us") - 40000).alias("dts_us"),
        F.when(i % 17 != 0, 1000000 * (1 + i % 3)).alias("duration_us"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        (F.col("event_type") == "signup").alias("is_key"),
        F.when(F.col("event_type") == "signup", "K__").otherwise("___").alias("flags"),
        F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("hash"),
    )
    p = numbered(p, order=["event_id"])
    return p if keep_id else p.drop("event_id")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("file_id"),
        "o_orderkey",
        F.sha2("o_orderstatus", 256).alias("hash"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 10000).alias("score_centi"),
    )
    n = numbered(o, keys=["file_id"], order=["o_orderkey"])
    jitter = F.when(F.col("o_orderkey") % 101 == 0, 900).otherwise(0)
    return n.select(
        "file_id",
        F.lit(0).cast("long").alias("stream_index"),
        "ordinal",
        "o_orderkey",
        (F.col("ordinal") * 41708 + jitter).alias("t_us"),
        F.lit(41708).cast("long").alias("duration_us"),
        "hash",
        "score_centi",
    )


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def rung_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One encoded sample per line item: bytes, whole seconds, frames and a centi-score."""
    return lineitem(spark, sf).select(
        F.col("l_suppkey").alias("file_id"),
        (18 + 4 * F.col("l_linenumber")).cast("long").alias("crf"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
        F.col("l_quantity").cast("long").alias("seconds"),
        (F.col("l_quantity").cast("long") * 24).alias("frames"),
        F.when(F.col("l_tax") < 0.075, 9900 - 100 * F.col("l_linenumber") - F.round(F.col("l_discount") * 100).cast("long"))
        .cast("long")
        .alias("score_centi"),
    )


def arriving(rows: DataFrame, *, parts: int = 4) -> DataFrame:
    """``rows`` as a stream with one micro-batch for each value of ``arrival`` (from 0), of ``parts`` files each.

    One job writes all files; rows of nulls see to it that there are as many for every arrival.  The source takes files by
    their time, which is set to the order of arrivals.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    d = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts).cast("long")))
    last = rows.agg(F.max("arrival")).first()[0] or 0
    fill = spark.range((last + 1) * parts).select(F.expr(f"id div {parts}").alias("arrival"), F.expr(f"id % {parts}").alias("part"))
    d.unionByName(fill, allowMissingColumns=True).repartition("arrival", "part").write.partitionBy("arrival", "part").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(root, True)
    while files.hasNext():
        file = files.next().getPath()
        found = re.search(r"/arrival=([0-9]+)/", file.toString())
        if found:
            fs.setTimes(file, 1_000_000_000_000 + 1000 * int(found[1]), -1)
    return open_stream(spark, path, rows.drop("arrival").schema, files_per_trigger=parts, recursive=True)
