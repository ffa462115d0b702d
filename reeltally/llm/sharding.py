"""Sharding by a k-d tree: leaves are split at distributed weighted medians along their widest metadata dimension."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table
from reeltally.plans.blocks import numbered
from reeltally.plans.session import materialise

SHARDS = 24
ROW_BYTES = 8
TOLERANCE = 0.001
GRID = 65535
SLOT_ROWS = 20_000


def _digits(dim: str) -> list[Column]:
    """A row's place along ``dim`` in 16-bit digits: the coordinate, then the text's hash, then the id's hash.

    Equal texts share all but the last four digits, so a cut parts them only where their group itself must be split.
    """
    bits = [F.shiftrightunsigned(F.col(c), n).bitwiseAND(F.lit(65535)).cast("int") for c in ("text_hash", "id_hash") for n in (48, 32, 16, 0)]
    return [F.col(dim), *bits]


@dataclass
class Cut:
    """One leaf's split: where its left part ends, digit by digit."""

    leaf: int
    shards: int
    dim: str
    left: float  # weight still to be found for the left part, within the prefix
    prefix: list[int] = field(default_factory=list)
    whole: bool | None = None  # once settled: does what lies at the prefix go left?

    def on_path(self) -> Column:
        out = F.col("leaf") == self.leaf
        for digit, value in zip(_digits(self.dim), self.prefix):
            out = out & (digit == value)
        return out

    def goes_left(self) -> Column:
        out = F.lit(bool(self.whole))
        for digit, value in reversed(list(zip(_digits(self.dim), self.prefix))):
            out = (digit < value) | ((digit == value) & out)
        return out


def _settle(rows: DataFrame, cuts: list[Cut], tolerance: float) -> None:
    """Finds every cut by radix selection: each pass sums weights by one digit and narrows all open cuts together.

    A pass returns one row per leaf.  It ends at a digit that holds a single row, or rows that weigh no more than the tolerance, which then
    go whole to the nearer side.
    """
    for cut in cuts:
        cut.whole = None
    while todo := [c for c in cuts if c.whole is None]:
        digit = where = left = None
        for c in todo:
            mine, here = F.col("leaf") == c.leaf, c.on_path()
            value = _digits(c.dim)[len(c.prefix)]
            where = here if where is None else where | here
            digit = F.when(mine, value) if digit is None else digit.when(mine, value)
            left = F.when(mine, F.lit(c.left)) if left is None else left.when(mine, F.lit(c.left))
        sums = rows.where(where).groupBy("leaf", digit.alias("digit")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        run = W.partitionBy("leaf").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("w").over(run)).withColumn("left", left)
        found = sums.where("upto >= left").groupBy("leaf").agg(F.min(F.struct("digit", "w", "upto", "n")).alias("m")).select("leaf", "m.*")
        at = {r["leaf"]: r for r in found.collect()}
        for c in todo:
            r = at[c.leaf]
            c.prefix.append(r["digit"])
            c.left -= r["upto"] - r["w"]
            if r["n"] == 1 or r["w"] <= tolerance or len(c.prefix) == len(_digits(c.dim)):
                c.whole = 2 * c.left >= r["w"]


def kd_shards(
    docs: DataFrame,
    *,
    dims: Mapping[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    target_bytes: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Cuts rows into ``shards`` parts (or as many as ``target_bytes`` asks for) of nearly equal bytes.

    Returns ``id``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard`` and ``slot`` (from 0 in each
    shard, without gaps).  ``dims`` are numeric metadata of a row.  A leaf of s shards is cut along its widest dimension
    (relative to the whole table) where floor(s / 2) / s of its bytes lie to the left; each cut is exact to
    ``tolerance`` of a shard.  Only leaves (a row each) and cuts reach the driver; rows move once, to be numbered.

    Null text has 0 bytes, null dimensions lie at the lowest place, null ids are ids like others.  Equal texts stay together
    unless a cut falls into their group.  Rows that repeat an id and a text cannot be parted.  An empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = {f"d{i}": c for i, c in enumerate(dims.values())}
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.col(id_col)).alias("id_hash"),
        *[c.cast("double").alias(n) for n, c in names.items()],
    )
    rows = materialise(rows)
    span = rows.agg(F.sum("size").alias("w"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    total = span["w"] or 0
    count = shards or max(1, -(-total // target_bytes))
    for n in names:
        low, high = span[f"min_{n}"] or 0.0, span[f"max_{n}"] or 0.0
        rows = rows.withColumn(n, F.floor((F.coalesce(n, F.lit(low)) - low) * (GRID / ((high - low) or 1.0))).cast("int"))

    rows = materialise(rows.withColumn("leaf", F.lit(0)))
    leaves = {0: count} if total else {}
    while any(s > 1 for s in leaves.values()):
        wide = rows.groupBy("leaf").agg(F.sum("size").alias("w"), *[(F.max(n) - F.min(n)).alias(n) for n in names])
        cuts = []
        for r in wide.where(F.col("leaf").isin([k for k, s in leaves.items() if s > 1])).collect():
            s = leaves[r["leaf"]]
            cuts.append(Cut(r["leaf"], s, max(names, key=lambda n: r[n]), r["w"] * (s // 2) / s))
        _settle(rows, cuts, tolerance * total / count)
        move, below = None, {}
        for c in cuts:
            right, go = c.leaf + c.shards // 2, (F.col("leaf") == c.leaf) & ~c.goes_left()
            move = F.when(go, right) if move is None else move.when(go, right)
            below |= {c.leaf: c.shards // 2, right: c.shards - c.shards // 2}
        if not cuts:
            break
        # Written anew after each level (five for 24 shards): a row is a few numbers, and plans stay short.
        rows = materialise(rows.withColumn("leaf", move.otherwise(F.col("leaf"))))
        leaves = {k: s for k, s in leaves.items() if s == 1 or k in below} | below
    spread = max(16, int(total // (count * 1000 * SLOT_ROWS)))
    rows = rows.select("id", "size", "text_crc32", F.col("leaf").alias("shard"), F.pmod(F.col("id_hash"), F.lit(spread)).alias("bin"))
    return numbered(rows, keys=["shard"], order=["id", "text_crc32"], name="slot", block=F.col("bin")).drop("bin")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: the dimensions come from the text alone, so that equal texts lie at one point."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    dims = {"bytes": F.octet_length(text), "wide_chars": F.octet_length(text) - F.length(text), "lines": lines}
    out = kd_shards(table(spark, sf_dir, "documents"), dims=dims, shards=SHARDS)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
