"""Interval overlap join as an equi-join on dyadic nodes.

Two half-open intervals overlap when the later start lies in the other interval.  An interval is cut into dyadic nodes over bins of time: runs of 2^k bins that
begin at a multiple of 2^k, at most two for each k, so even an interval that a damaged time makes endless is some hundred rows.  A start lies in exactly one node of
an interval that contains it, and that node is one of its bin's ancestors, so a pair meets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltally.plans.blocks import attach

_NODE = "struct<level:int,node:bigint>"


def _bin(time: str, width: int) -> str:
    return f"((`{time}` - pmod(`{time}`, {width}L)) div {width}L)"


def _nodes(start: str, end: str, width: int) -> Column:
    """The interval's nodes: at each level the odd one at either edge of what the levels below have left over."""
    low, stop = _bin(start, width), f"greatest(`{end}` - 1, `{start}`)"
    high = f"((({stop}) - pmod({stop}, {width}L)) div {width}L + 1)"
    left, right = f"-shiftright(-{low}, k)", f"shiftright({high}, k)"
    edges = f"""array(
        if({left} < {right} and pmod({left}, 2) = 1, struct(k as level, {left} as node), null),
        if({left} < {right} and pmod({right}, 2) = 1, struct(k as level, {right} - 1 as node), null))"""
    top = f"cast(log2({high} - {low}) as int) + 1"
    return F.expr(f"filter(flatten(transform(sequence(0, {top}), k -> {edges})), x -> x is not null)").cast(f"array<{_NODE}>")


def _deep(side: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """The levels of each key's nodes, for keys with intervals of several bins: of the others all nodes are bins."""
    last = f"((`{end}` - 1 - pmod(`{end}` - 1, {width}L)) div {width}L)"
    long = side.where(f"{_bin(start, width)} < {last}")
    levels = F.transform(_nodes(start, end, width), lambda x: x["level"])
    return long.select(*keys, F.explode(F.array_distinct(levels)).alias("__level")).groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))


def _spread(side: DataFrame, other: DataFrame, keys: Sequence[str], span: tuple[str, str], other_span: tuple[str, str], width: int, own: int) -> DataFrame:
    """``side`` once for each node of its intervals (``__part`` = ``own``) and for each of its starts' ancestors on a level that ``other`` has."""
    start, end = span
    d = attach(side, _deep(other, keys, *other_span, width), keys, spread=start, dense=False)
    levels = F.coalesce(F.array_union("__levels", F.array(F.lit(0))), F.array(F.lit(0)))
    bin_ = F.expr(_bin(start, width))
    up = F.transform(levels, lambda k: F.struct(F.lit(1 - own).alias("part"), k.alias("level"), F.call_function("shiftright", bin_, k).alias("node")))
    down = F.transform(_nodes(start, end, width), lambda x: F.struct(F.lit(own).alias("part"), x["level"].alias("level"), x["node"].alias("node")))
    return d.withColumn("__at", F.explode(F.concat(F.coalesce(down, F.array().cast("array<struct<part:int,level:int,node:bigint>>")), up))).drop("__levels")


def range_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_width: int,
    condition: Column | None = None,
) -> DataFrame:
    """Rows of both sides whose half-open intervals overlap, each pair once.

    An interval shorter than ``bin_width`` is one or two rows, one of n bins at most 2 log2 n; a start adds one row, and one for each further level of
    the other side's nodes under the same key.  Pick a width near the longer of the two usual interval lengths.  Rows with null times match
    nothing.  Apart from ``keys`` the two sides must not share column names.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = _spread(left, right, keys, left_span, right_span, bin_width, 0)
    b = _spread(right, left, keys, right_span, left_span, bin_width, 1)
    later_left = F.col(ls) >= F.col(rs)
    part = F.col("__at.part") == F.when(later_left, 1).otherwise(0)
    hit = a.join(b, [*keys, "__at"]).where(part & (F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re)))
    if condition is not None:
        hit = hit.where(condition)
    return hit.drop("__at")
