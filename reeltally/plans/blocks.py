"""Ordered operations that never put one whole stream into one task.

``Window.partitionBy(file_id, stream_index)`` sorts a full stream in a single
task, and one stream may hold a third of the data.  The helpers here split every
stream into blocks of its order column, work inside ``(keys, block)`` and stitch
the block edges:

* :func:`neighbours` - previous/next row.  With dense ordinals the edge row of a
  block is copied into the adjacent block (one shuffle, no join); otherwise the
  edge rows are summarised per block and joined back.
* :func:`running` - prefix sums and running maxima through per-block totals.
* :func:`numbered` - dense row numbers.
* :func:`attach` - per-key values onto rows of a possibly hot key, in chunks.

Only per-block summaries (one row per ``block_rows`` rows) are ever ordered per key: a stream
of a hundred billion rows leaves 1.5 million of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("file_id", "stream_index")
BLOCK_ROWS = 65_536
BLOCK_US = 600_000_000
CHUNK_ROWS = 4_000_000
SALTS = 64
_B = "__block"


def ordinal_block(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a non-negative dense ordinal."""
    return F.expr(f"`{order}` div {int(rows)}")


def time_block(time: str, width_us: int = BLOCK_US) -> Column:
    """Block of a time in microseconds; negative times round down."""
    return F.expr(f"(`{time}` - pmod(`{time}`, {int(width_us)})) div {int(width_us)}")


def neighbours(
    df: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: str = "ordinal",
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
    dense: bool = True,
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>`` from the adjacent rows of each key.

    ``dense=True`` relies on ordinals 0..n-1 without gaps, as every source writes
    them, and raises at run time where a row has no row right before it.  Pass
    ``dense=False`` for any other unique order column.
    """
    keys = list(keys)
    blk = block if block is not None else ordinal_block(order, block_rows)
    w = W.partitionBy(*keys, _B).orderBy(order)
    if dense:
        at = F.expr(f"pmod(`{order}`, {int(block_rows)})")
        copies = [F.array(F.col(_B))]
        # Also for ``next`` alone: only the row before tells that no row is missing.
        copies.append(F.when(at == block_rows - 1, F.array(F.col(_B) + 1)).otherwise(F.array().cast("array<bigint>")))
        if next:
            copies.append(
                F.when((at == 0) & (F.col(order) > 0), F.array(F.col(_B) - 1)).otherwise(F.array().cast("array<bigint>"))
            )
        d = df.withColumn(_B, ordinal_block(order, block_rows)).withColumn("__home", F.col(_B))
        d = d.withColumn(_B, F.explode(F.concat(*copies)))
        out = d.withColumn("__seen", F.lag(order).over(w))
        for c in prev:
            out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
        for c in next:
            out = out.withColumn(f"next_{c}", F.lead(c).over(w))
        out = out.where(F.col(_B) == F.col("__home"))
        gap = (F.col(order) > 0) & ~F.coalesce(F.col("__seen") == F.col(order) - 1, F.lit(False))
        first = f"prev_{prev[0]}" if prev else f"next_{next[0]}"
        out = out.withColumn(first, F.when(gap, F.raise_error(F.lit("ordinals are not dense; use dense=False"))).otherwise(F.col(first)))
        return out.drop(_B, "__home", "__seen")

    d = df.withColumn(_B, blk)
    wb = W.partitionBy(*keys).orderBy(_B)
    aggs = [_edge(F.max_by, F.max, c, order).alias(f"__l_{c}") for c in prev]
    aggs += [_edge(F.min_by, F.min, c, order).alias(f"__f_{c}") for c in next]
    edges = d.groupBy(*keys, _B).agg(*aggs).select(
        *keys,
        _B,
        *[F.lag(f"__l_{c}").over(wb).alias(f"__l_{c}") for c in prev],
        *[F.lead(f"__f_{c}").over(wb).alias(f"__f_{c}") for c in next],
    )
    out = d.join(edges, [*keys, _B], "left").withColumn("__n", F.row_number().over(w))
    out = out.withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    for c in prev:
        out = out.withColumn(f"prev_{c}", F.when(F.col("__n") == 1, F.col(f"__l_{c}")).otherwise(F.lag(c).over(w)))
    for c in next:
        out = out.withColumn(f"next_{c}", F.when(F.col("__last"), F.col(f"__f_{c}")).otherwise(F.lead(c).over(w)))
    return out.drop(_B, "__n", "__last", *[f"__l_{c}" for c in prev], *[f"__f_{c}" for c in next])


def _edge(by, plain, col: str, order: str) -> Column:
    return plain(col) if col == order else by(col, order)


def running(
    df: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("ordinal",),
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    prior_maxes: Mapping[str, str] | None = None,
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds running values along ``order``.

    ``sums`` maps new column -> numeric column and gives the sum of the rows *before*
    the current one; ``maxes`` gives the maximum up to and including it and ``prior_maxes``
    the maximum of the rows before it.
    """
    keys, order = list(keys), list(order)
    sums, maxes, prior = dict(sums or {}), dict(maxes or {}), dict(prior_maxes or {})
    tops = {**maxes, **prior}
    d = df.withColumn(_B, block if block is not None else ordinal_block(order[0], block_rows))
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*keys, _B).agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__m_{n}") for n, c in tops.items()],
    )
    carry = totals.select(
        *keys,
        _B,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in tops],
    )
    inside = W.partitionBy(*keys, _B).orderBy(*order)
    out = d.join(carry, [*keys, _B], "left")
    for n, c in sums.items():
        inner = F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn(n, F.col(f"__s_{n}") + F.coalesce(inner, F.lit(0)))
    for n, c in tops.items():
        inner = F.max(c).over(inside.rowsBetween(W.unboundedPreceding, 0 if n in maxes else -1))
        out = out.withColumn(n, F.greatest(F.col(f"__m_{n}"), inner))
    return out.drop(_B, *[f"__s_{n}" for n in sums], *[f"__m_{n}" for n in tops])


def numbered(
    df: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    order: Sequence[str],
    name: str = "ordinal",
    block: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense zero-based row number per key; ``order`` must be unique within a key."""
    keys, order = list(keys), list(order)
    d = df.withColumn(_B, block if block is not None else ordinal_block(order[0], block_rows))
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    carry = d.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__c")).select(
        *keys, _B, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c")
    )
    inside = W.partitionBy(*keys, _B).orderBy(*order)
    return (
        # A left join, so that an unused number costs nothing: Spark then drops the whole right side.
        d.join(carry, [*keys, _B], "left")
        .withColumn(name, F.col("__c") + F.row_number().over(inside) - F.lit(1).cast("long"))
        .drop(_B, "__c")
    )


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    spread: str = "ordinal",
    how: str = "left",
    dense: bool = True,
    extent_of: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Joins one row per key onto many rows without gathering a hot key.

    With a dense non-negative ``spread`` column the many side is cut into chunks of ``chunk_rows`` and the
    one side is repeated once per chunk its key really has, so ordinary keys are not repeated at
    all and a key of any size spreads over as many tasks as it needs.  ``dense=False`` hashes ``spread``
    into ``salts`` parts instead.  ``extent_of`` names a cheaper frame with the same keys and
    ``spread`` values to measure the chunks on.  No broadcast is forced: Spark broadcasts by measured size.
    """
    keys = list(keys)
    if dense:
        chunk = F.expr(f"`{spread}` div {int(chunk_rows)}")
        extent = (df if extent_of is None else extent_of).groupBy(*keys).agg(F.max(spread).alias("__hi"))
        one = per_key.join(extent, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"__hi div {int(chunk_rows)}"))))
        one = one.drop("__hi")
    else:
        chunk = F.pmod(F.xxhash64(spread), F.lit(salts).cast("long"))
        one = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return df.withColumn("__salt", chunk).join(one, [*keys, "__salt"], how).drop("__salt")
