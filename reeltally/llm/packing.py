"""Packing token sequences into windows: bounded-space best fit inside partitions, leftovers merged in rounds."""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.bpe import CACHED_PIECES, Splitter, parts
from reeltally.llm.registry import query, table
from reeltally.plans.session import discard, shared_dir

WINDOW, OPEN_WINDOWS, SLACK = 2048, 32, 16
MERGE_PARTS = 32  # so many partitions' open windows meet in one task of the next round
PIECE = "id string, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, closed boolean, part long, ids binary"
FIELDS = [f.split()[0] for f in PIECE.split(", ")]


class Packer:
    """``open_windows`` windows, filled best fit; closed pieces collect in ``rows``.

    A piece that fits nowhere opens a window while one is free.  Otherwise the fullest goes out: as it is when at most
    ``slack`` tokens are missing, else topped up with the head of the piece.
    """

    def __init__(self, prefix: int, window: int, open_windows: int, slack: int, with_ids: bool):
        self.prefix, self.window, self.most, self.slack, self.with_ids = prefix, window, open_windows, slack, with_ids
        self.made, self.rows = 0, []
        self.held: dict[int, list] = {}
        self.free: dict[int, int] = {}
        self.order: list[tuple[int, int]] = []  # room and name of the open windows, sorted

    def begin(self) -> int:
        self.made += 1
        name = self.prefix + self.made
        self.held[name], self.free[name] = [], self.window
        insort(self.order, (self.window, name))
        return name

    def put(self, name: int, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.held[name].append((doc, start, ids, self.window - self.free[name]))
        del self.order[bisect_left(self.order, (self.free[name], name))]
        self.free[name] -= len(ids)
        insort(self.order, (self.free[name], name))
        if not self.free[name]:
            self.close(name)

    def row(self, name: int, piece: tuple, closed: bool, part: int) -> tuple:
        (doc_id, total), start, ids, offset = piece
        data = ids.tobytes()
        return (doc_id, start, len(ids), zlib.crc32(data), total, name, offset, closed, part, data if self.with_ids or not closed else None)

    def close(self, name: int) -> None:
        del self.order[bisect_left(self.order, (self.free.pop(name), name))]
        self.rows += [self.row(name, piece, True, 0) for piece in self.held.pop(name)]

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.put(self.begin(), doc, start, ids[: self.window])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            best = bisect_left(self.order, (len(ids), -1))
            if best < len(self.order):
                return self.put(self.order[best][1], doc, start, ids)
            if len(self.free) < self.most:
                return self.put(self.begin(), doc, start, ids)
            free, name = self.order[0]
            if free <= self.slack:
                self.close(name)
            else:
                self.put(name, doc, start, ids[:free])
                start, ids = start + free, ids[free:]

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=FIELDS)

    def rest(self, part: int, last: bool) -> pd.DataFrame:
        for name in list(self.free):
            if last:
                self.close(name)
            else:
                self.rows += [self.row(name, piece, False, part) for piece in self.held[name]]
        return self.take()


_TOKENIZERS: dict[bytes, tuple] = {}


def tokenizer(data: bytes):
    """One tokenizer for each Python worker, with the ids of pieces it has met."""
    key = hashlib.md5(data).digest()
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(data.decode())
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        _TOKENIZERS[key] = (made, Splitter(), {})
    return _TOKENIZERS[key]


def encoded(data: bytes, texts: list[str]) -> list[np.ndarray]:
    """The tokenizer's ids of every text.  It never merges over the matches of its pattern: each different one is encoded once."""
    made, splitter, known = tokenizer(data)

    def ids_of(pieces: list[str]) -> list[bytes]:
        if len(known) > CACHED_PIECES:
            known.clear()
        new = [piece for piece in pieces if piece not in known]
        for piece, found in zip(new, made.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = array("I", found.ids).tobytes()
        return [known[piece] for piece in pieces]

    return splitter.encode(texts, ids_of)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    slack: int = SLACK,
    merge_parts: int = MERGE_PARTS,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every document's ids, each followed by ``end_id``, into windows of ``window`` tokens.

    Returns a row for each piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``window``, ``offset``, and
    ``ids`` (little-endian unsigned 32-bit; null unless ``with_ids``).  ``vocabulary`` is a tokenizer file on the driver,
    about 2 MB, which is broadcast.

    Each partition packs as it reads, without a shuffle, and holds ``open_windows`` windows.  What is then open moves with its ids:
    the open windows of ``merge_parts`` partitions are packed together in one task, round after round, until one part is left;
    a task of a later round reads at most merge_parts * open_windows windows.  Each round's rows are written before they are
    used, so a lost executor cannot change a window.

    Null and empty texts are one ``end_id``.  Null ids and repeated rows are packed like others; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4")
    limits = (window, open_windows, slack, with_ids)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, *limits)
        for batch in batches:
            texts, ids = [t or "" for t in batch["text"]], batch["id"].tolist()
            for lo, hi in parts(texts):
                for doc_id, found in zip(ids[lo:hi], encoded(shared.value, texts[lo:hi])):
                    packer.add((doc_id, len(found) + 1), 0, np.concatenate([found, end]))
                yield packer.take()
        yield packer.rest(part, False)
        tokenizer(shared.value)[2].clear()

    def merged(level: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer, part = None, None
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.part != part:
                        if packer:
                            yield packer.rest(part, last)
                        part, packer = row.part, Packer((level << 56) + (row.part << 32), *limits)
                    packer.add((row.id, row.doc_tokens), row.start, np.frombuffer(row.ids, "<u4"))
                if packer:
                    yield packer.take()
            if packer:
                yield packer.rest(part, last)

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, level, done = source.mapInPandas(first, PIECE), 0, []
    while True:
        path = shared_dir(spark)
        rows.write.parquet(path)
        rows = spark.read.schema(PIECE).parquet(path)
        done.append(rows.where("closed"))
        rest = rows.where("not closed")
        top = rest.agg(F.max("part")).first()[0]
        if top is None:
            break
        level, count = level + 1, top // merge_parts + 1
        rest = rest.withColumn("part", F.expr(f"part div {merge_parts}"))
        # Pieces in a fixed order, whichever task reads them: a second attempt packs alike.
        rest = rest.repartition(count, "part").sortWithinPartitions("part", "window", "offset")
        rows = rest.mapInPandas(merged(level, count == 1), PIECE)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("closed", "part").withColumn("id", F.col("id").cast(kind))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
