"""Exact duplicates by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table
from reeltally.plans.session import materialise


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", digest(F.col("text")).alias("key"))


def _collided(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Keys whose group holds texts that differ: every member is held against the one that stays."""
    members = keyed.join(groups.where("n > 1").select("key", "keep_id"), "key")
    chosen = members.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("key").agg(F.min("text").alias("kept_text"))
    # Written, so that both sides of the join are dealt out for it and a hot group's members can be split.
    chosen = materialise(chosen)
    return members.select("key", "text").join(chosen, "key").where("text <> kept_text").select("key").distinct()


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "min",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``copies``, ``key``, ``sha256``.

    Rows are grouped by ``digest`` of the text; ``keep`` ("min" or "max") names the id that stays.  Groups
    whose texts differ are regrouped by the text itself, so a collision never joins two texts.  Hashes are grouped without
    the texts; to compare bytes each text is dealt out by its hash, once to find the one that stays and once to meet it.

    Null text counts as empty, and empty texts equal each other.  Null ids lose to any other id; a group
    of nulls keeps one.  Of rows repeated with id and text, exactly one is ``kept``; ``copies`` is their
    number.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    best = {"min": F.min, "max": F.max}[keep]
    keyed = _keyed(docs, id_col, text_col, digest)
    rows = keyed.groupBy("key", F.unhex(F.sha2("text", 256)).alias("sha"), "id").agg(F.count(F.lit(1)).alias("copies"))
    groups = rows.groupBy("key").agg(F.sum("copies").alias("n"), best("id").alias("keep_id"))
    # Normally no row at all: written once, as three plans below read it.
    collided = materialise(_collided(keyed, groups))
    plain = rows.join(collided, "key", "left_anti").join(groups, "key")
    split = keyed.join(collided, "key", "left_semi").groupBy("key", "text", "id").agg(F.count(F.lit(1)).alias("copies"))
    by_text = split.groupBy("key", "text").agg(F.sum("copies").alias("n"), best("id").alias("keep_id"))
    split = split.join(by_text, ["key", "text"]).withColumn("sha", F.unhex(F.sha2("text", 256)))
    cols = ["key", "sha", "id", "copies", "n", "keep_id"]
    every = plain.select(cols).unionByName(split.select(cols))
    every = every.withColumn("nth", F.explode(F.expr("sequence(1L, copies)")))
    return every.select(
        "id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "copies",
        "key",
        F.lower(F.hex("sha")).alias("sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows repeated with id and text leave one.
    """
    kept = exact_duplicates(docs, id_col, text_col, keep=keep).where("kept")
    kept = kept.select(F.col("id").alias("__id"), F.col("sha256").alias("__sha"), F.col("copies").alias("__copies"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__text_sha", F.sha2(text, 256))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha")))
    once = rows.where("__copies = 1")
    more = rows.where("__copies > 1").dropDuplicates(["__id", "__sha"])
    return once.unionByName(more).select(*docs.columns)


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY text) AS keep_id,
           count(*) OVER (PARTITION BY text) AS group_size,
           row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1 AS kept,
           sha256(text) AS text_sha256
    FROM d
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"), keep="max")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))
