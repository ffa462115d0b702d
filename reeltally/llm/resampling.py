"""Importance resampling towards a target distribution, by hashed n-gram features.

A 256-byte table lower-cases A-Z and blanks separators, so ``bytes.translate`` and ``bytes.split`` give a text's words.  The crc32 of a run of
words is that of the shorter run, taken on as the seed for a blank and the next word; Counters of the buckets are what is reduced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table
from reeltally.plans.session import materialise

BUCKETS, WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
BLOCK = 1 << 20  # bytes of a text whose words are held at once
# Lower case for A-Z; digits, small letters and all bytes outside ASCII stand for themselves; the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str, words: int = WORDS) -> Iterator[tuple[int, list[int]]]:
    """For every block of the text its number of words, and the crc32 of all runs of 1 to ``words`` words that end in it."""
    data = text.encode().translate(TABLE)
    at, last = 0, []
    while at < len(data):
        stop = data.find(b" ", at + BLOCK)
        stop = len(data) if stop < 0 else stop
        own = data[at:stop].split()
        run = last + own
        seeds = list(map(crc32, run))
        out = seeds[len(last) :]
        for n in range(2, words + 1):
            # Runs of n words: each run of n - 1, a blank, and the word behind it.
            seeds = list(map(crc32, run[n - 1 :], map(crc32, repeat(b" "), seeds)))
            out += seeds[max(len(last) - n + 1, 0) :]
        yield len(own), out
        last = run[max(len(run) - words + 1, 0) :]
        at = stop


def counted(text: str, words: int, buckets: int) -> tuple[int, Counter]:
    """Words of the text, and how many of its features fall into each bucket."""
    n, held = 0, Counter()
    for more, features in grams(text, words):
        n += more
        held.update((np.array(features, np.uint32) % np.uint32(buckets)).tolist())
    return n, held


def bucket_counts(docs: DataFrame, *, text_col: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: the features of all texts, one Counter of at most ``buckets`` entries for each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    held.update(counted(text, words, buckets)[1])
        yield pd.DataFrame({"bucket": list(held.keys()), "n": list(held.values())}, dtype="int64")

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Every bucket's floored thousandfold logarithm of how much likelier it is in the target, counts smoothed by one."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    at = ((float(source.get(b, 0) + 1), float(target.get(b, 0) + 1)) for b in range(buckets))
    return [math.floor(1000 * math.log(t * s_all / (s * t_all))) for s, t in at]


def noise(doc_id: str, seed: int) -> int:
    """A Gumbel variate that the id decides, thousandfold and floored."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: list[int], *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain of the features; 0 without any) and ``score`` (weight and noise)."""
    buckets = len(gains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["id"], batch["text"]):
                n_words, held = counted(text or "", words, buckets)
                n = held.total()
                weight = sum(gains[b] * c for b, c in held.items()) // n if n else 0
                rows.append((doc_id, n_words, n, weight, weight + noise(doc_id or "", seed)))
            yield pd.DataFrame(rows, columns=["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    # Ids travel as text, so that nulls and wide types come back as they were.
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = out.mapInPandas(run, "id string, n_words long, n_features long, weight long, score long")
    return out.withColumn("id", F.col("id").cast(kind))


def draw(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, ... for the ``percent`` in a hundred highest scores of the texts with ``least_words`` words or more, else null.

    Ties go to the smaller id.  The rank is the number of rows of higher scores, from a count for each score (one row for each, so few), and the
    place among equal scores; noise that spans thousands of scores keeps the rows of one score few, whatever the texts.  ``scored`` is
    read twice and must not change: pass a written table.
    """
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    per = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    per = per.select("score", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__above"), F.sum("n").over(W.partitionBy()).alias("__all"))
    per = per.withColumn("__most", F.expr(f"__all * {int(percent)} div 100")).where("__above < __most").select(F.col("score").alias("__score"), "__above", "__most")
    # The condition on the words is part of the join, so that only texts in the running are ordered.
    out = scored.join(per, fit & (F.col("score") == F.col("__score")), "left")
    ahead, rest = out.where("__above is not null"), out.where("__above is null")
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight"))
    ahead = ahead.withColumn("rank", (F.col("__above") + place).cast("long")).withColumn("rank", F.expr("if(rank <= __most, rank, null)"))
    return ahead.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).drop("__score", "__above", "__most")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    words: int = WORDS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Draws the documents that resemble ``target``: ``id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` for every row.

    Two passes over the texts, neither of which moves one: the first leaves ``buckets`` counts, which are all that the driver holds, the second
    a row of five numbers for each text, written before the ranks are taken.  A long text's words are held a block at a time.

    Null and empty texts, and texts of separators alone, have no features, weight 0 and are never drawn.  Repeated rows are ranked each; a null id counts as the empty
    text in the noise and comes last among ties; other columns are ignored.  Empty tables of either kind have no counts: an
    empty target leaves the smoothing alone, an empty ``docs`` gives no rows.
    """
    counts = [
        {r.bucket: r.n for r in bucket_counts(df, text_col=col, words=words, buckets=buckets).collect()} for df, col in ((docs, text_col), (target, target_col))
    ]
    gains = gains_of(*counts, buckets)
    return draw(materialise(weighed(docs, gains, id_col=id_col, text_col=text_col, words=words, seed=seed)), percent=percent, least_words=least_words)


@query("op12_importance_resampling")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
