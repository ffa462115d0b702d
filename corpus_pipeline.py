"""A corpus from raw documents to packed training windows.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's documents, the last one
the packed pieces.  Between stages the rows are written and read again, so each stage's decisions are fixed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.exact_dedup import drop_exact_duplicates
from reeltally.llm.near_dedup import drop_near_duplicates
from reeltally.llm.packing import pack_documents
from reeltally.llm.repeats import remove_repeats
from reeltally.llm.toxicity import held_out, score_toxicity, train
from reeltally.plans.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_toxicity(docs, train(docs, labels), score="__score", predicted="__toxic")
    return scored.where("__toxic = 0").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays."""
    return drop_near_duplicates(docs, weights="unit")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings go; of a character that is cut in two the rest goes with it.  All rows stay."""

    @F.pandas_udf("string")
    def text_of(kept: pd.Series) -> pd.Series:
        return pd.Series([data.decode("utf-8", "ignore") for data in kept])

    left = remove_repeats(docs, kept="__kept", spans="__spans")
    text = F.when(F.size("__spans") > 0, text_of("__kept")).otherwise(F.col("text"))
    left = left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens; a row for each piece, without its ids."""
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", packing)]

# Training, shingles and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
