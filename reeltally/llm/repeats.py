"""Removal of long repeated byte strings: sampled anchors, then a column-wise, multi-document suffix order over aligned contexts.

Every string of ``length`` bytes holds an anchor: the ``GRAM``-byte gram of the smallest hash among its grams (the leftmost, if
several).  Equal strings hold the same anchor at the same place, so only places of one anchor's gram can repeat each other,
aligned at the gram.  An anchor's context is the bytes of all strings it is the anchor of; contexts that are equal as a whole
repeat as a whole, and their hash tells.  The rest, the edges of repeated passages, is ordered symbol by symbol: each
round inserts one symbol of every context in front, which moves the order of all suffixes and their common prefixes one column on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.bpe import parts
from reeltally.llm.registry import query, table
from reeltally.llm.shingles import mixed
from reeltally.plans.session import materialise

LENGTH, GRAM = 400, 32
BATCH_ROWS = 8192  # contexts that a task orders at once
CHUNK = BATCH_ROWS  # contexts of one anchor that are ordered together; more are split, and windows meet by hash
BATCH_BYTES = 500_000
NONE = 256  # the symbol where a context has no byte

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = tuple(np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64) for seed in (3, 4))


@lru_cache(maxsize=2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p = _MULTIPLIERS[which]
    up, down = np.full(n + 1, p, np.uint64), np.full(n + 1, pow(p, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


class Sums:
    """Hashes of any stretch of ``raw`` from prefix sums."""

    def __init__(self, raw: np.ndarray, which: int):
        n = len(raw)
        up, self.down = _powers(which, 1 << n.bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][raw] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def anchors(texts: list[bytes], length: int = LENGTH) -> pd.DataFrame:
    """``text`` (place in the list), ``at`` (the anchor), ``low`` and ``high`` (first and last string it anchors), ``gram``, ``t1``, ``t2``."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    count = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    if not len(doc):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "at", "low", "high", "gram", "t1", "t2")})
    start = np.arange(len(doc)) + np.repeat(begin - (np.cumsum(count) - count), count)
    one, two = Sums(raw, 0), Sums(raw, 1)
    places = np.arange(len(raw) - GRAM + 1)
    grams = one.of(places, places + GRAM)
    # The smallest of each window: by hash, then by place.
    width = length - GRAM + 1
    key = np.full(-(-len(grams) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[: len(grams)] = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    rows = key.reshape(-1, width)
    from_left = np.minimum.accumulate(rows, axis=1).ravel()
    to_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(to_right[start], from_left[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(at)) - 1]
    at, doc = at[first], doc[first]
    # Where the anchor lies inside counts as well.
    place = mixed((at - low).astype(np.uint64))
    return pd.DataFrame(
        {
            "text": doc,
            "at": at - begin[doc],
            "low": low - begin[doc],
            "high": high - begin[doc],
            "gram": grams[at].view(np.int64),
            "t1": (one.of(low, high + length) ^ place).view(np.int64),
            "t2": (two.of(low, high + length) ^ place).view(np.int64),
        }
    )


def repeated_columns(group: np.ndarray, columns: np.ndarray, length: int, each=None) -> np.ndarray:
    """Which strings of ``length`` symbols occur in another row of their group at the same column: (rows, columns) of bool.

    ``columns`` holds each row's symbols, one column for each place relative to the anchor; ``group`` ascends.  Column
    by column from the right, rows are kept in the order of their suffixes; ``ends`` is where a row's common prefix with the row
    before it ends.  A stable sort by the new symbol gives the next order; rows that are then neighbours share what all rows
    between them shared.  ``each(column, order, same)`` is told the order and which rows equal the one before for ``length``.
    """
    rows, width = columns.shape
    found = np.zeros((rows, width), bool)
    order = np.arange(rows)
    ends = np.full(rows + 1, width, np.int32)
    for c in range(width - 1, -1, -1):
        symbol = columns[order, c]
        key = group * (NONE + 1) + symbol
        step = np.argsort(key, kind="stable")
        key, order = key[step], order[step]
        before, after = step[:-1], step[1:]
        near = np.full(rows + 1, c, np.int32)
        joined = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % (NONE + 1) != NONE))
        a, b = before[joined], after[joined]
        close = b == a + 1
        near[joined[close] + 1] = ends[b[close]]
        if not close.all():
            far = ~close
            pairs = np.empty(2 * far.sum(), np.int64)
            pairs[::2], pairs[1::2] = a[far] + 1, b[far] + 1
            near[joined[far] + 1] = np.minimum.reduceat(ends, pairs)[::2]
        ends = near
        same = np.flatnonzero(ends[1:rows] - c >= length)
        found[order[same + 1], c] = True
        found[order[same], c] = True
        if each:
            each(c, order, same)
    return found


INTERVAL = "key binary, start long, stop long, gram long, offset long, h1 long, h2 long, open boolean"


def _ordered(batch: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    """Repeated stretches of the contexts of whole groups, and the windows of split groups that other parts may hold."""
    left, size = (batch["at"] - batch["low"]).to_numpy(), batch["context"].str.len().to_numpy()
    width_left = int(left.max())
    columns = np.full((len(batch), width_left + int((size - left).max())), NONE, np.int16)
    for i, (data, gap) in enumerate(zip(batch["context"], width_left - left)):
        columns[i, gap : gap + len(data)] = np.frombuffer(data, np.uint8)
    new = (batch["gram"].to_numpy()[1:] != batch["gram"].to_numpy()[:-1]) | (batch["part"].to_numpy()[1:] != batch["part"].to_numpy()[:-1])
    group = np.append(0, np.cumsum(new))
    split, settled = batch["split"].to_numpy(), batch["settled"].to_numpy()
    heads: list[tuple[np.ndarray, int]] = []

    def each(c: int, order: np.ndarray, same: np.ndarray) -> None:
        if split.any():
            head = np.ones(len(order), bool)
            head[same + 1] = False
            pick = order[head]
            gap = width_left - left[pick]
            heads.append((pick[split[pick] & (c >= gap) & (c + length <= gap + size[pick])], c))

    found = repeated_columns(group, columns, length, each)
    keys, low, gram = batch["key"].to_numpy(), batch["low"].to_numpy(), batch["gram"].to_numpy()
    shift = low - (width_left - left)  # from a column to a place in the text
    edge = np.diff(np.pad(found & ~settled[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    none = {"gram": 0, "offset": 0, "h1": 0, "h2": 0}
    yield pd.DataFrame({"key": keys[row], "start": a + shift[row], "stop": b - 1 + length + shift[row], **none, "open": False})
    for pick, c in heads:
        if len(pick):
            raw = columns[pick, c : c + length].astype(np.uint8)
            n = np.arange(len(pick)) * length
            h = [Sums(raw.ravel(), i).of(n, n + length).view(np.int64) for i in (0, 1)]
            yield pd.DataFrame(
                {"key": keys[pick], "start": c + shift[pick], "stop": c + shift[pick] + length, "gram": gram[pick], "offset": c - width_left, "h1": h[0], "h2": h[1], "open": True}
            )


def _order_contexts(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= BATCH_ROWS:
                mark = (held["gram"] != held["gram"].iloc[-1]) | (held["part"] != held["part"].iloc[-1])
                whole = int(mark.to_numpy().nonzero()[0].max(initial=-1)) + 1
                if whole:
                    yield from _ordered(held.iloc[:whole].reset_index(drop=True), length)
                    held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield from _ordered(held, length)

    return contexts.mapInPandas(run, INTERVAL)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("__key", F.unhex(F.md5("__text")))


def repeated_spans(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """``key`` (128-bit hash of the text) and ``spans``: sorted, disjoint stretches of bytes that strings of ``length`` bytes
    cover which also start anywhere else.  Texts without any have no row.  For the cases see :func:`remove_repeats`."""
    rows = _keyed(docs, text_col).select(F.col("__key").alias("key"), F.col("__text").alias("text"))
    long_rows = rows.where(F.octet_length("text") >= length)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, keys = batch["text"].tolist(), batch["key"].to_numpy()
            for lo, hi in parts(values, BATCH_BYTES):
                out = anchors([t.encode() for t in values[lo:hi]], length)
                yield out.assign(key=keys[lo:hi][out.pop("text")])

    place = "key binary, at int, low int, high int"
    every = materialise(long_rows.mapInPandas(sample, f"{place}, gram long, t1 long, t2 long"))
    kinds = every.groupBy("gram", "t1", "t2").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("key", "at", "low", "high")).alias("one"))
    kinds = materialise(kinds)
    same = ["gram", "t1", "t2"]
    whole = every.join(kinds.where("times > 1").select(*same), same).select("key", F.col("low").cast("long").alias("start"), (F.col("high") + length).cast("long").alias("stop"))

    # One context of each kind, where an anchor's gram has several kinds.
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    settled, of = (F.col("times") > 1).alias("settled"), F.ceil(F.col("kinds") / chunk).cast("int").alias("of")
    wanted = kinds.join(several, "gram").select("gram", "one.*", settled, of)
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("key", "at"), F.col("of").cast("long")).cast("int"))
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "part", "of", "at", "low", "high", "settled")).alias("list"))
    columns = ["gram", "part", "of", "at", "low", "high", "settled"]
    texts = long_rows.dropDuplicates(["key"]).join(lists, "key").select("key", "text", *[F.col(f"list.{c}").alias(c) for c in columns])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["text"].tolist()
            for lo, hi in parts(values, BATCH_BYTES):
                some = batch.iloc[lo:hi]
                out = pd.DataFrame({f: np.concatenate(some[f].to_list()) for f in columns})
                out["split"] = out.pop("of") > 1
                contexts: list[bytes] = []
                for text, low, high in zip(some["text"], some["low"], some["high"]):
                    data = text.encode()
                    contexts += [data[a : b + length] for a, b in zip(low.tolist(), high.tolist())]
                out["context"] = contexts
                out["key"] = np.repeat(some["key"].to_numpy(), some["at"].str.len().to_numpy())
                yield out

    contexts = texts.mapInPandas(cut, f"{place}, gram long, part int, settled boolean, split boolean, context binary")
    contexts = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part", "key", "at")
    found = materialise(_order_contexts(contexts, length))
    windows = found.where("open")
    window = ["gram", "offset", "h1", "h2"]
    again = windows.groupBy(*window).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*window)
    across = windows.join(again, window).select("key", "start", "stop")

    # Texts with copies repeat as a whole.
    copies = rows.select("key", F.octet_length("text").cast("long").alias("stop")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("stop").alias("stop"))
    copies = copies.where(f"n > 1 and stop >= {length}").select("key", F.lit(0).cast("long").alias("start"), "stop")
    stretches = whole.unionByName(found.where("not open").select("key", "start", "stop")).unionByName(across).unionByName(copies).distinct()
    listed = stretches.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))

    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for one in lists:
            spans: list[list[int]] = []
            for x in one:
                a, b = x["start"], x["stop"]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            out.append(spans)
        return pd.Series(out)

    return listed.select("key", F.pandas_udf(merge, "array<array<bigint>>")("s").alias("spans"))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK, kept: str = "kept", spans: str = "spans") -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that are left) and ``spans`` (array of [start, stop) that went).

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, in the
    same text or another; all are judged on the input.  Texts with an equal text elsewhere go whole, if long enough.

    Null text counts as empty; shorter texts than ``length`` stay.  Repeated rows are documents of their own, so both lose
    their text.  Other columns pass through (the two names must be new); an empty table gives no rows.  A text's places are one
    group, as long as the text is; an anchor's contexts are not: parts of ``chunk`` meet by the hashes of what is still open.
    """
    found = repeated_spans(docs, text_col=text_col, length=length, chunk=chunk).select(F.col("key").alias("__key"), F.col("spans").alias(spans))
    out = _keyed(docs, text_col).join(found, "__key", "left")

    def cut(text: pd.Series, lists: pd.Series) -> pd.Series:
        left = []
        for one, places in zip(text, lists):
            data, at, pieces = one.encode(), 0, []
            for a, b in places if places is not None else ():
                pieces.append(data[at:a])
                at = b
            left.append(b"".join([*pieces, data[at:]]))
        return pd.Series(left)

    out = out.withColumn(kept, F.pandas_udf(cut, "binary")("__text", spans))
    return out.withColumn(spans, F.coalesce(spans, F.array().cast("array<array<bigint>>"))).select(*docs.columns, kept, spans)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        (F.size("spans") > 0).alias("touched"),
    )
