"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A text is the bag of the byte n-grams of its lower-case words, word boundaries included; each n-gram's hash picks an embedding.
Their average goes through a softmax over two classes.  A misspelt word shares most of its n-grams with the words it was
trained on.  As two classes only need the difference of the softmax's weights, an n-gram adds one number to a text's
score: the model that tasks get is a vector of ``BUCKETS`` floats and a bias, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.bpe import parts
from reeltally.llm.registry import query, table

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIM = 8
SAMPLE_DOCS = 10_000  # labelled texts that training reads, picked by the hash of their id
STEPS, RATE, SOFT_RATE, FLOOR = 80, 12.0, 0.1, 3e-5
THRESHOLD = 0.3
CHUNK_CHARS = 200_000
TRAIN_ROWS, SCORE_CHARS = 256, 500_000
SEED = 11

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(pow(0x100000001B3, j, 1 << 64)) for j in range(max(SIZES))]
# White space and punctuation part words; digits and signs such as * or $ stay, as misspellings use them.
_SPLIT = np.zeros(256, bool)
_SPLIT[list(range(33)) + list(b'.,;:?!|"()[]{}<>/\\_-')] = True


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the places where n-grams begin in the joined texts, and their buckets."""
    data = b"".join(b" " + t.lower().encode() + b" " for t in texts)
    raw = np.frombuffer(data, np.uint8)
    split = _SPLIT[raw]
    wide = np.where(split, np.uint8(32), raw).astype(np.uint64)
    seen = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(split, out=seen[1:])
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        # A boundary may be an n-gram's first or last byte only.
        inside = np.flatnonzero((seen[n - 1 : n - 1 + m] - seen[1 : 1 + m]) == 0)
        total = wide[inside].copy()
        for j in range(1, n):
            total += wide[inside + j] * _STEP[j]
        total ^= total >> np.uint64(29)
        yield inside, ((total * _MIX) >> np.uint64(64 - 17)).astype(np.int32)


def ends(texts: list[str]) -> np.ndarray:
    return np.cumsum([len(t.lower().encode()) + 2 for t in texts])


@dataclass
class Model:
    """What an n-gram of each bucket adds to the log odds of a text's average, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities; a text without n-grams has the bias alone."""
        edge = ends(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for at, bucket in ngrams(texts):
            cut = np.searchsorted(at, edge)
            run = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
            total += np.diff(run[cut], prepend=0.0)
            count += np.diff(cut, prepend=0)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


class Bags:
    """The texts' averages as rows of a sparse matrix, a chunk of texts at a time: four bytes for a bucket and its count, no text kept."""

    MOST = (1 << 15) - 1  # a larger count takes several entries

    def __init__(self):
        self.texts = 0
        # Texts that have n-grams, how many entries each, where they begin, the entries, and what one n-gram's share is.
        self.chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[str]) -> None:
        for lo, hi in parts(texts, CHUNK_CHARS):
            found, edge = [], ends(texts[lo:hi])
            for at, bucket in ngrams(texts[lo:hi]):
                found.append(np.searchsorted(edge, at, side="right").astype(np.int64) * BUCKETS + bucket)
            if not found:
                continue
            key, n = np.unique(np.concatenate(found), return_counts=True)
            del found
            times = (n - 1) // self.MOST + 1
            entry = np.full(times.sum(), self.MOST, np.uint32)
            entry[np.cumsum(times) - 1] = n - (times - 1) * self.MOST
            entry = entry << np.uint32(17) | np.repeat(key % BUCKETS, times).astype(np.uint32)
            row, first, sizes = np.unique(np.repeat(key // BUCKETS, times), return_index=True, return_counts=True)
            total = np.add.reduceat(entry >> np.uint32(17), first, dtype=np.int64)
            self.chunks.append((row + self.texts + lo, sizes, first, entry, (1 / total).astype(np.float32)))
        self.texts += len(texts)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for row, sizes, first, entry, share in self.chunks:
            yield row, sizes, first, (entry & np.uint32(BUCKETS - 1)).astype(np.int32), (entry >> np.uint32(17)) * np.repeat(share, sizes)


def fit(texts: list[str], labels: np.ndarray, **settings) -> Model:
    bags = Bags()
    bags.add(texts)
    return fit_bags(bags, labels, **settings)


def fit_bags(bags: Bags, labels: np.ndarray, *, steps: int = STEPS, rate: float = RATE, dim: int = DIM) -> Model:
    """Full-batch Adagrad on embeddings, softmax and bias together.

    With averages as rows of a sparse matrix X, the gradient of every embedding is one number times the softmax's weights, so
    a step costs two sparse products, whatever the dimension.
    """
    rng = np.random.default_rng(SEED)
    table_, soft = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 1, dim)
    toxic = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    bias = np.log(toxic / (1 - toxic))
    past = np.zeros(BUCKETS)
    past_s, past_b = np.zeros(dim), 0.0
    for _ in range(steps if bags.texts else 0):
        odds, score = np.full(bags.texts, bias), (table_ @ soft).astype(np.float32)
        for row, sizes, first, col, share in bags:
            odds[row] += np.add.reduceat(share * score[col], first)
        miss = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - labels) / bags.texts
        pull = np.zeros(BUCKETS)
        for row, sizes, first, col, share in bags:
            pull += np.bincount(col, share * np.repeat(miss[row], sizes), BUCKETS)
        grad_s, grad_b = table_.T @ pull, miss.sum()
        past += pull**2
        past_s += grad_s**2
        past_b += grad_b**2
        # The floor keeps n-grams of a text or two from moving as fast as those of many.
        table_ -= rate * np.outer(pull / (np.sqrt(past) + FLOOR), soft)
        soft = soft - SOFT_RATE * grad_s / (np.sqrt(past_s) + 1e-9)
        bias -= SOFT_RATE * grad_b / (np.sqrt(past_b) + 1e-9)
    return Model((table_ @ soft).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most ``sample_docs`` labelled texts, whole ones, picked by the hash of their id.

    The sample is trained on in one task.  Null labels and ids take no part; of labels repeated for an id the
    highest counts.  Without a labelled text every score is 1/2.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    chosen = chosen.agg(F.max(label_col).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    # At most sample_docs rows of two numbers.
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    texts = texts.select(F.col("__id").cast("string").alias("id"), "text", F.col("__y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels, last = Bags(), [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, TRAIN_ROWS):
                texts = []
                for row in batch.slice(lo, TRAIN_ROWS).to_pylist():
                    # Sorted, so that repeated rows follow each other; they count once.
                    if (row["id"], row["text"]) != last and len(labels) < sample_docs:
                        last = row["id"], row["text"]
                        texts.append(row["text"])
                        labels.append(row["y"])
                bags.add(texts)
        if labels:
            model = fit_bags(bags, np.array(labels))
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    # In an order of their own, so that a second attempt gives the same model; Spark sorts them, and texts become counts as they arrive.
    row = texts.repartition(1).sortWithinPartitions("id", "text").mapInArrow(run, "weights binary, bias double").first()
    if row is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with two more columns: the probability of being toxic, and 1 where it reaches ``threshold``, else 0.

    Every row is scored in place by its whole text.  Null and empty texts get the score of the bias.  The two names
    must be new ones; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        own, texts = Model(*shared.value), [t or "" for t in text]
        found = [own.score(texts[lo:hi]) for lo, hi in parts(texts, SCORE_CHARS)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    out = docs.withColumn(score, scored(F.col(text_col).cast("string")))
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Rows that no training reads: a quarter, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, trained(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
