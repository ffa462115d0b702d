"""Connected components of an edge table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reeltally.plans.session import discard, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for the ends of ``edges`` (``a``, ``b``: long).

    Each round takes the smallest label among a node's neighbours, then the label of that label, so the distance to the smallest
    node at least halves; it ends when no label changes.  Every round is written, and the one before removed.
    """
    spark = edges.sparkSession

    def saved(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, _ = saved(both)
    labels, path = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("changed", F.lit(True)))
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = new.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label"))
        fresh, fresh_path = saved(new.select("node", "label", (F.col("old") != F.col("label")).alias("changed")))
        discard(spark, path)
        labels, path = fresh, fresh_path
    return labels.select("node", "label")
