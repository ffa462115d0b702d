"""Near-duplicates: ProbMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.bpe import parts
from reeltally.llm.components import components
from reeltally.llm.registry import query, table
from reeltally.llm.shingles import WORDS, mixed, shingles
from reeltally.plans.session import materialise

BANDS, BAND_ROWS = 32, 5  # at similarity 0.8 a pair shares no band with probability 3e-6
SIMILARITY = 0.8
CROWD = 16  # buckets of more texts are divided by rare shingles
BATCH = 1_500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted(doc: np.ndarray, hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their weights: 1 each ("unit") or their number ("count")."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc))).astype("f8")
    return doc[at], hashes[at], np.ones(len(at)) if weights == "unit" else count


def signatures(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray | float, texts: int, size: int) -> np.ndarray:
    """ProbMinHash: (texts, size) hashes; two texts agree at a place with the probability Jaccard of their weights.

    Every shingle is a Poisson process of its weight's rate, drawn from its hash; each arrival goes to a random place, and
    the first to arrive there names it.  A shingle stops once its next arrival is later than all places of its text; arrivals
    are drawn for all shingles together, round by round.
    """
    first = np.full(texts * size, np.inf)
    name = np.zeros(texts * size, np.uint64)
    time, seed = np.zeros(len(doc)), hashes.copy()
    weight = np.broadcast_to(np.asarray(weight, "f8"), doc.shape)
    while len(doc):
        seed = seed + _GOLD
        draw = mixed(seed)
        time = time - np.log1p(-(draw >> np.uint64(11)).astype("f8") * 2.0**-53) / weight
        place = doc * size + (mixed(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        name[place[won]] = hashes[won]
        late = first.reshape(texts, size).max(1) if texts else first
        go = time < late[doc]
        doc, hashes, weight, time, seed = doc[go], hashes[go], weight[go], time[go], seed[go]
    return name.reshape(texts, size)


def band_keys(names: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    rows = names.reshape(len(names), bands, -1)
    key = np.zeros(rows.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[2]):
        key = mixed(key * _GOLD + rows[:, :, j])
    return key.view(np.int64)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (sorted hashes, weights); for equal weights it is the Jaccard similarity of the sets."""
    (hx, wx), (hy, wy) = x, y
    common, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_x, only_y = np.delete(wx, ix), np.delete(wy, iy)
    a, b = wx[ix], wy[iy]
    order = np.argsort(a / b)
    a, b = a[order], b[order]
    ratio = a / b
    # Shingles with a ratio of x to y above a shingle's own count by x, the others by y.
    above = np.append(np.cumsum(a[::-1])[::-1], 0.0)[np.searchsorted(ratio, ratio, side="left")] + only_x.sum()
    below = np.append(0.0, np.cumsum(b))[np.searchsorted(ratio, ratio, side="left")] + only_y.sum()
    return float((1 / (above / a + below / b)).sum())


def _signed(texts: DataFrame, words: int, weights: str, bands: int, rows: int) -> DataFrame:
    """``key``, ``n`` (distinct shingles) and ``bands`` of the texts of every partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("key")
            values = batch["text"].tolist()
            for lo, hi in parts(values, BATCH):
                doc, hashes, weight = weighted(*shingles(values[lo:hi], words), weights)
                n = np.bincount(doc, minlength=hi - lo)
                keys = band_keys(signatures(doc, hashes, weight, hi - lo, bands * rows), bands)
                none = np.zeros(0, np.int64)
                yield pd.DataFrame({"key": batch["key"].iloc[lo:hi], "n": n, "bands": [k if c else none for k, c in zip(keys, n)]})

    return texts.mapInPandas(run, "key binary, n long, bands array<long>")


def _rare_shingles(texts: DataFrame, words: int, weights: str, similarity: float) -> DataFrame:
    """Buckets by rare shingles, for texts that share a crowded bucket: ``bucket``, ``node``, ``pos``, ``n``.

    In the order of how many of these texts hold a shingle, two texts of similarity s share one of the rarest n - ceil(s * n) + 1 of
    either; ``pos`` counts a text's shingles before it.

    With counts, let p and q be two texts' weights over their sums.  Their probability Jaccard is at most the sum of min(p, q), so at
    similarity s the shingles that only one of them holds weigh at most 1 - s in it: both hold their first common shingle
    among those with at most 1 - s before it.
    """
    counted = weights != "unit"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["text"].tolist()
            for lo, hi in parts(values, BATCH):
                doc, hashes, weight = weighted(*shingles(values[lo:hi], words), weights)
                out = pd.DataFrame({"node": batch["node"].to_numpy()[lo:hi][doc], "bucket": hashes.view(np.int64)})
                yield out.assign(weight=weight) if counted else out

    held = texts.select("node", "text").mapInPandas(run, "node long, bucket long" + ", weight double" * counted)
    often = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("often"))
    held = held.join(often, "bucket")
    # Each text's own shingles in order; a text is one group, as long as it is.
    row = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "bucket", *["weight"] * counted))).alias("s"))
    row = row.withColumn("n", F.size("s").cast("long"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(similarity)) + 1
    if counted:
        row = row.withColumn("room", F.aggregate("s", F.lit(0.0), lambda sum_, e: sum_ + e["weight"]) * F.lit(1 - similarity + 1e-9))
        start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("k"))
        more = lambda at, e: F.struct((at["before"] + e["weight"]).alias("before"), (at["k"] + (at["before"] <= F.col("room")).cast("int")).alias("k"))
        keep = F.aggregate("s", start, more)["k"]
    row = row.withColumn("s", F.slice("s", F.lit(1), keep.cast("int")))
    row = row.select("node", "n", F.posexplode("s").alias("pos", "e"))
    return row.where("e.often > 1").select(F.col("e.bucket").alias("bucket"), "node", F.col("pos").cast("long").alias("pos"), "n")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, weights: str, similarity: float) -> DataFrame:
    """``pairs`` with ``ok``: is the exact similarity of their texts high enough?"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = (batch["text_a"] + batch["text_b"]).tolist()
            for lo, hi in parts(values, BATCH):
                part = batch.iloc[lo:hi]
                place: dict[int, int] = {}
                unique: list[str] = []
                for node, text in zip([*part["a"], *part["b"]], [*part["text_a"], *part["text_b"]]):
                    if node not in place:
                        place[node] = len(unique)
                        unique.append(text)
                doc, hashes, weight = weighted(*shingles(unique, words), weights)
                cut = np.searchsorted(doc, np.arange(len(unique) + 1))
                one = [(hashes[i:j], weight[i:j]) for i, j in zip(cut, cut[1:])]
                ok = [probability_jaccard(one[place[a]], one[place[b]]) >= similarity - 1e-9 for a, b in zip(part["a"], part["b"])]
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "ok": ok})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, ok boolean")


def _may_reach(similarity: float, pos_b: str = "pos_b") -> str:
    """Sizes and places leave room for the similarity: with equal weights only, others pass."""
    s = float(similarity)
    return f"least(n_a, n_b) >= {s} * greatest(n_a, n_b) - 1e-9 and least(n_a - pos_a, n_b - {pos_b}) >= {s} / {1 + s} * (n_a + n_b) - 1e-6"


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    weights: str = "count",
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: ``id``, ``class_id`` (the smallest id of its class), ``class_size`` (rows), ``sha256``.

    Texts are linked when the probability Jaccard of their weighted word shingles is at least ``similarity``; classes are
    the connected components.  With ``weights`` "unit" that is the Jaccard similarity of the shingle sets, with
    "count" a shingle weighs as often as it occurs.

    Equal texts are one text from the start.  Texts that share a band form a bucket, and every text is verified against
    its bucket's first.  Buckets of more than ``crowd`` texts are divided first, by the rare shingles that similar texts must
    share by their weights.  Where a bucket still holds several classes, the texts outside its first one's class are verified against all others
    of other classes.  So no link between texts that share a band is lost, while a group of copies costs about one check
    a text.

    Null text counts as empty; texts without a word are linked only to equal ones.  Ids may be null or repeated: rows with equal
    texts share a class.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    signed = _signed(rows.select("key", "text"), words, weights, bands, band_rows).dropDuplicates(["key"])
    signed = materialise(signed.withColumn("node", F.monotonically_increasing_id()))
    buckets = signed.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("head")).where("members > 1")
    shared = materialise(buckets.join(sizes, "bucket"))

    # The texts that share a bucket, each once.
    wanted = shared.select("node").distinct().join(signed.select("node", "key"), "node")
    texts = materialise(rows.select("key", "text").join(wanted, "key").dropDuplicates(["node"]).select("node", "text"))
    crowded = shared.where(F.col("members") > crowd).select("node").distinct()
    rare = _rare_shingles(texts.join(crowded, "node"), words, weights, similarity)
    rare = materialise(rare)
    # Written, so that both sides of the joins below are dealt out for them and a hot bucket's texts can be split.
    heads = rare.groupBy("bucket").agg(F.min(F.struct("pos", "node", "n")).alias("h"))
    heads = materialise(heads.select("bucket", F.col("h.node").alias("head"), F.col("h.pos").alias("pos_b"), F.col("h.n").alias("n_b")))
    small = shared.where(F.col("members") <= crowd).select("bucket", "node", F.lit(0).cast("long").alias("pos"), "n", "head")

    def pair(a: str, b: str):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    star = rare.join(heads, "bucket").where("node <> head")
    if weights == "unit":
        star = star.where(_may_reach(similarity).replace("n_a", "n").replace("pos_a", "pos"))
    star = star.select(*pair("node", "head"))
    star = star.unionByName(small.where("node <> head").select(*pair("node", "head"))).distinct()
    checked = materialise(_verified(star, texts, words, weights, similarity))
    links = checked.where("ok").select("a", "b")
    label = components(links)

    # Buckets that hold several classes: whoever is outside the head's class meets all of other classes.
    every = small.unionByName(rare.join(heads.select("bucket", "head"), "bucket").select("bucket", "node", "pos", "n", "head"))
    named = every.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ones = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    named = named.join(mixed_ones, "bucket")
    head_label = label.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    outside = named.join(head_label, "head", "left").where("label <> coalesce(head_label, head)")
    outside = outside.select("bucket", F.col("node").alias("x"), F.col("pos").alias("pos_a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
    others = named.select("bucket", F.col("node").alias("y"), F.col("pos").alias("pos_b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
    room = F.expr(_may_reach(similarity)) if weights == "unit" else F.lit(True)
    rest = outside.join(others, "bucket").where("label_a <> label_b").where(room).select(*pair("x", "y")).distinct()
    rest = rest.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = materialise(_verified(rest, texts, words, weights, similarity).where("ok").select("a", "b"))
    label = components(links.unionByName(more)) if not more.isEmpty() else label

    classes = signed.select("key", "node").join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).join(classes, "key")
    of_class = counted.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("id").alias("class_id"))
    found = counted.select("key", "label").join(of_class, "label")
    out = rows.select("id", "key").join(found, "key")
    return out.select("id", "class_id", "class_size", F.lower(F.hex("key")).alias("sha256"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all their columns.

    Ids must be unique for exactly one row of a class to stay; rows that repeat it with one text leave one.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("id", "sha256").agg(F.count(F.lit(1)).alias("__copies"))
    kept = kept.select(F.col("id").alias("__id"), F.col("sha256").alias("__sha"), "__copies")
    rows = docs.withColumn("__text_sha", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha")))
    more = rows.where("__copies > 1").dropDuplicates(["__id", "__sha"])
    return rows.where("__copies = 1").unionByName(more).select(*docs.columns)


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit weights: the Jaccard similarity of five-word shingle sets."""
    out = near_duplicates(table(spark, sf_dir, "documents"), weights="unit")
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
