"""Subtitle cues, chapters and film-grain segments as interval rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.plans.blocks import BLOCK_ROWS, attach, neighbours
from reeltally.plans.ranges import range_join
from reeltally.plans.verdicts import reason, with_verdict

CUE_BIN_MS = 60_000
CHAPTER_BIN_US = 600_000_000
# Override tags that animate an ASS cue over its own duration.
ANIMATED = ("\\t(", "\\move(", "\\fad(", "\\fade(", "\\k")


def _quantised(ms: Column, dialect: Column) -> Column:
    return F.when(dialect == "ass", (F.round(ms / 10.0) * 10).cast("long")).otherwise(ms)


def clip_cues(
    cues: DataFrame,
    edits: DataFrame,
    *,
    keys: Sequence[str] = ("file_id",),
    bin_ms: int = CUE_BIN_MS,
) -> DataFrame:
    """Cues cut to each edit interval and rebased to its start, with a reject reason per cue.

    ``cues``: ``n, format, start_ms, end_ms, body, fields, settings``; ``edits``: ``edit_id,
    from_ms, to_ms``.  Overlaps are found by an equi-join on time bins.
    """
    keys = list(keys)
    e = edits.select(*keys, "edit_id", "from_ms", "to_ms")
    hit = range_join(cues, e, keys=keys, left_span=("start_ms", "end_ms"), right_span=("from_ms", "to_ms"), bin_width=bin_ms)
    cut = (F.col("start_ms") < F.col("from_ms")) | (F.col("end_ms") > F.col("to_ms"))
    text = F.lower("body")
    animated = F.lit(False)
    for mark in ANIMATED:
        animated = animated | F.contains(text, F.lit(mark))
    effect = F.coalesce(F.get("fields", F.lit(8)) != "", F.lit(False))
    inline = F.col("body").rlike(r"<[0-9][^<]*:")
    fmt = F.col("format")
    start = _quantised(F.greatest("start_ms", "from_ms") - F.col("from_ms"), fmt)
    end = _quantised(F.least("end_ms", "to_ms") - F.col("from_ms"), fmt)
    why = reason(
        ((fmt == "ass") & cut & (animated | effect), "cut through an animated cue"),
        ((fmt == "webvtt") & inline, "inline timestamps"),
        (end <= start, "overlap shorter than the timestamp precision"),
    )
    return hit.select(
        *keys, "edit_id", "n", "format", start.alias("start_ms"), end.alias("end_ms"), "body", "fields", "settings", cut.alias("cut"),
        why.alias("reason"),
    ).withColumn("ok", F.col("reason").isNull())


def clip_verdict(clipped: DataFrame, *, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Per edit: cues kept and the first rejected cue; a rejected cue rejects the whole edit."""
    out = clipped.groupBy(*keys, "edit_id").agg(
        F.count(F.lit(1)).alias("cues"), F.count(F.when(~F.col("ok"), 1)).alias("rejected"), F.min(F.when(~F.col("ok"), F.col("n"))).alias("first_bad")
    )
    return with_verdict(out, (F.col("rejected") > 0, "rejected cues"))


def shift_cues(cues: DataFrame, offset_ms: int) -> DataFrame:
    """Moves every cue by an offset, quantised to its format."""
    inline = (F.col("format") == "webvtt") & F.col("body").rlike(r"<[0-9][^<]*:") & F.lit(offset_ms != 0)
    out = cues.withColumn("start_ms", _quantised(F.col("start_ms") + offset_ms, F.col("format")))
    out = out.withColumn("end_ms", _quantised(F.col("end_ms") + offset_ms, F.col("format")))
    return with_verdict(out, (inline, "inline timestamps"))


def clip_chapters(
    chapters: DataFrame, edits: DataFrame, *, keys: Sequence[str] = ("file_id",), bin_us: int = CHAPTER_BIN_US
) -> DataFrame:
    """Chapters cut to each edit interval (strict overlap) and rebased to its start.

    ``chapters``: ``position, start_us, end_us``; ``edits``: ``edit_id, from_us, to_us``.
    """
    keys = list(keys)
    valid = chapters.where((F.col("start_us") >= 0) & (F.col("end_us") >= F.col("start_us")))
    e = edits.select(*keys, "edit_id", "from_us", "to_us")
    hit = range_join(valid, e, keys=keys, left_span=("start_us", "end_us"), right_span=("from_us", "to_us"), bin_width=bin_us)
    return hit.withColumns({
        "start_us": F.greatest("start_us", "from_us") - F.col("from_us"),
        "end_us": F.least("end_us", "to_us") - F.col("from_us"),
    }).drop("from_us", "to_us")


def rebase_chapters(chapters: DataFrame, origins: DataFrame, *, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Moves chapters to a new origin; those ending at or before it are dropped."""
    d = attach(chapters, origins.select(*keys, "origin_us"), keys, spread="position", how="inner")
    d = d.where(F.col("end_us") > F.col("origin_us"))
    zero = F.lit(0).cast("long")
    d = d.withColumn("start_us", F.greatest(F.col("start_us") - F.col("origin_us"), zero))
    return d.withColumn("end_us", F.greatest(F.col("end_us") - F.col("origin_us"), F.col("start_us"))).drop("origin_us")


def chapter_verdict(chapters: DataFrame, *, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Files whose chapter intervals are unusable."""
    bad = F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("start_us") < 0) | (F.col("end_us") < F.col("start_us"))
    out = chapters.groupBy(*keys).agg(F.count(F.lit(1)).alias("chapters"), F.min(F.when(bad, F.col("position"))).alias("first_bad"))
    return with_verdict(out, (F.col("first_bad").isNotNull(), "invalid chapter interval"))


def grain_coverage(
    segments: DataFrame,
    videos: DataFrame,
    *,
    keys: Sequence[str] = ("file_id",),
    estimate: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Film-grain segments must be ordered, disjoint and reach the end of the video.

    ``segments``: ``n, start_tick, end_tick`` in 100 ns; ``videos``: ``frames, rate_num, rate_den``.
    ``estimate`` allows two percent or one second for header frame counts.
    """
    keys = list(keys)
    d = neighbours(segments.select(*keys, "n", "start_tick", "end_tick"), keys=keys, order="n", prev=["end_tick"], dense=False, block_rows=block_rows)
    bad = (F.col("end_tick") <= F.col("start_tick")) | (F.col("start_tick") < F.col("prev_end_tick"))
    facts = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"),
        F.min("start_tick").alias("first_tick"),
        F.max("end_tick").alias("last_tick"),
        F.min(F.when(bad, F.col("n"))).alias("first_bad"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = (wide("frames") * F.lit(10_000_000) * wide("rate_den")).cast("decimal(38,0)")
    v = videos.select(*keys, F.call_function("div", product, wide("rate_num")).cast("long").alias("video_ticks"))
    margin = F.greatest(F.expr("video_ticks div 50"), F.lit(10_000_000).cast("long")) if estimate else F.lit(0)
    out = facts.join(v, keys, "left").withColumn("__need", F.col("video_ticks") - margin)
    return with_verdict(
        out,
        (F.col("first_bad").isNotNull(), "segments overlap or have invalid timing"),
        (F.col("last_tick") < F.col("__need"), "table ends before the video"),
    ).drop("__need")


def cue_quality(
    cues: DataFrame, *, keys: Sequence[str] = ("file_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Verdict per cue document: ordered starts, positive intervals, at least one cue with text."""
    keys = list(keys)
    d = neighbours(cues.select(*keys, "n", "start_ms", "end_ms", "body"), keys=keys, order="n", prev=["start_ms"], dense=False, block_rows=block_rows)
    lines = F.transform(F.split("body", "\n"), lambda x: X.strip(x))
    text = F.exists(lines, lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    late = F.col("start_ms") < F.col("prev_start_ms")
    reverse = F.col("end_ms") <= F.col("start_ms")
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cues"),
        F.count(F.when(late, 1)).alias("out_of_order"),
        F.count(F.when(reverse, 1)).alias("reversed"),
        F.count(F.when(text, 1)).alias("with_text"),
    )
    return with_verdict(
        out, ((F.col("out_of_order") > 0) | (F.col("reversed") > 0), "reversed or out-of-order timing"), (F.col("with_text") == 0, "no text")
    )


def cue_lines(cues: DataFrame) -> DataFrame:
    """Adds ``line``: the cue as text in its own format."""
    clock = lambda c: X.format_clock(c, "format")
    gap = F.when(F.coalesce(F.col("settings"), F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), "settings"))
    timing = F.concat(clock("start_ms"), F.lit(" --> "), clock("end_ms"), gap)
    block = F.concat((F.col("n") + 1).cast("string"), F.lit("\n"), timing, F.lit("\n"), "body", F.lit("\n"))
    head = F.concat_ws(",", F.get("fields", F.lit(0)), clock("start_ms"), clock("end_ms"))
    rest = F.array_join(F.slice("fields", 4, 7), ",")
    return cues.withColumn("line", F.when(F.col("format") == "ass", F.concat(F.lit("Dialogue: "), head, F.lit(","), rest)).otherwise(block))
