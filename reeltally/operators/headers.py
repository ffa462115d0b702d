"""Checks on stream headers and packet listings: planned streams, frame plans, display matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.plans.blocks import KEYS, attach, numbered, time_block
from reeltally.plans.verdicts import with_verdict

# Fixed value: the last entry of a display matrix, in 2.30 fixed point; the others are 16.16.
MATRIX_UNIT, MATRIX_LAST = 65_536, 1_073_741_824
PLAN_FAULTS = ("no presentation time", "discarded or corrupt", "first packet is not a keyframe")


def planned_streams_check(streams: DataFrame, plan: DataFrame, *, key: str = "file_id", position: str = "position") -> DataFrame:
    """Do a finished file's streams have the planned kinds in the planned order, and a readable video header?

    ``plan``: ``kind`` per position from 0.  ``streams``: ``kind, codec, width, height`` and, if there are any, ``chapter_track``:
    such a stream does not count, and those behind it move up.  Only headers are read.  Files of the plan without any stream fail.
    """
    chapter = F.coalesce(F.col("chapter_track"), F.lit(False)) if "chapter_track" in streams.columns else F.lit(False)
    # A file's few streams are one group.
    place = (F.row_number().over(W.partitionBy(key).orderBy(position)) - 1).cast("long")
    found = streams.where(~chapter).select(key, place.alias(position), F.col("kind").alias("__kind"), "codec", "width", "height")
    planned = plan.select(key, F.col(position).cast("long").alias(position), "kind")
    d = planned.join(found, [key, position], "full")
    differs = ~F.col("kind").eqNullSafe(F.col("__kind"))
    readable = F.coalesce(~F.col("codec").isin("", "unknown") & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    out = d.groupBy(key).agg(
        F.count("kind").alias("planned"),
        F.count("__kind").alias("found"),
        F.min(F.when(differs, F.col(position))).alias("first_difference"),
        F.count(F.when((F.col("kind") == "video") & ~readable, 1)).alias("__blind"),
    )
    rules = [(F.col("first_difference").isNotNull(), "streams differ from the plan"), (F.col("__blind") > 0, "no readable video header")]
    return with_verdict(out, *rules).drop("__blind")


def packet_frame_plan(
    packets: DataFrame, *, keys: Sequence[str] = KEYS, order: str = "ordinal", t: str = "pts_us", flags: str = "flags"
) -> tuple[DataFrame, DataFrame]:
    """A stream's packet listing as its plan of frames: ``(frames, verdict)``.

    The listing serves if every packet is timed, none is discarded or corrupt and the first is a keyframe.  ``verdict``
    has the first fault by position, and whether any packet is discarded, even behind that fault.  ``frames`` numbers the packets
    of sound streams in the order of presentation, ties by position.
    """
    keys = list(keys)
    mark = lambda letter: F.coalesce(F.contains(F.col(flags), F.lit(letter)), F.lit(False))
    fault = F.when(F.col(t).isNull(), 0).when(mark("D") | mark("C"), 1).when((F.col(order) == 0) & ~mark("K"), 2)
    # Position and kind of fault in one long, so that the aggregate stays a hash aggregate.
    first = F.min(F.col(order) * 4 + fault)
    facts = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), first.alias("__first"), F.max(mark("D")).alias("discarded"))
    facts = facts.withColumn("first_bad", F.expr("__first div 4")).withColumn("__kind", F.pmod("__first", F.lit(4)))
    verdict = with_verdict(facts, *[(F.col("__kind") == i, text) for i, text in enumerate(PLAN_FAULTS)]).drop("__first", "__kind")
    sound = attach(packets.select(*keys, order, t), verdict.where("ok").select(*keys), keys, spread=order, how="inner")
    frames = numbered(sound, keys=keys, order=[t, order], name="frame", block=time_block(t))
    return frames.select(*keys, "frame", order, t), verdict


def display_transform(matrix: Column | str) -> Column:
    """A display matrix listing (three numbered lines of three numbers) as a struct, null unless it only turns or mirrors.

    ``degrees`` is the counter-clockwise turn of the picture in quarters, ``mirrored`` whether it is flipped left to right
    before that, ``swaps_axes`` whether width and height change places.  Offsets do not matter.
    """
    text = F.col(matrix) if isinstance(matrix, str) else matrix
    lines = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    row = lambda i: F.regexp_extract_all(F.get(lines, F.lit(i)), F.lit(rf"^0*{i}:\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)$"), 0)
    entry = lambda i, j: F.regexp_extract(F.get(lines, F.lit(i)), rf"^0*{i}:\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)$", j + 1).try_cast("bigint")
    whole = F.size(lines) == 3
    for i in range(3):
        whole = whole & (F.size(row(i)) == 1)
    (a, b, c), (d, e, f), (g, h, last) = ([entry(i, j) for j in range(3)] for i in range(3))
    small = lambda x: x.between(-(2**31), 2**31 - 1)
    plain = (c == 0) & (f == 0) & (last == MATRIX_LAST) & small(g) & small(h)
    unit = lambda x, y: ((x == 0) & (F.abs(y) == MATRIX_UNIT)) | ((y == 0) & (F.abs(x) == MATRIX_UNIT))
    square = unit(a, b) & unit(d, e) & ((a == 0) == (e == 0))
    # With unit entries the determinant's sign tells a mirror image; its first row is then turned back.
    mirrored = a * e - b * d < 0
    x, y = F.when(mirrored, -a).otherwise(a), F.when(mirrored, -b).otherwise(b)
    degrees = F.when(x > 0, 0).when(y < 0, 90).when(x < 0, 180).otherwise(270)
    return F.when(F.coalesce(whole & plain & square, F.lit(False)), F.struct(degrees.cast("long").alias("degrees"), mirrored.alias("mirrored"), (a == 0).alias("swaps_axes")))
