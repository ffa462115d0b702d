"""Timeline summaries and clock checks over packets, frames and audio frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.plans import blocks
from reeltally.plans.blocks import BLOCK_ROWS, BLOCK_US, KEYS, attach, neighbours, running
from reeltally.plans.verdicts import with_verdict

SLACK_US = 1
REORDER_LIMIT = 64
FILM_RATE = (24000, 1001)
FILM_ALTERNATIVE = (2997, 125)


def clip_rows(rows: DataFrame, start_us: int, end_us: int, *, t: str = "t_us", kind: str | None = "kind") -> DataFrame:
    """Audio and video rows with ``start - 1us <= t < end - 1us``."""
    out = rows.where((F.col(t) >= start_us - SLACK_US) & (F.col(t) < end_us - SLACK_US))
    return out.where(F.col(kind).isin("audio", "video")) if kind else out


def timeline_summary(
    rows: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    t: str = "t_us",
    duration: str = "duration_us",
    order: str = "ordinal",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Count, first, last, largest quantum, end and span per stream."""
    # The step of a row is measured from the highest time before it, as times may run backwards.
    d = running(
        rows.select(*keys, order, t, duration), keys=keys, order=[order], prior_maxes={"__high": t}, block_rows=block_rows
    )
    step = F.col(t) - F.col("__high")
    dur = F.when(F.col(duration) > 0, F.col(duration))
    out = d.groupBy(*keys).agg(
        F.count(t).alias("frames"),
        F.min(t).alias("first_us"),
        F.max(t).alias("last_us"),
        F.greatest(F.coalesce(F.max(F.when(step > 0, step)), F.lit(0)), F.coalesce(F.max(dur), F.lit(0))).alias("max_quantum_us"),
        F.max(F.col(t) + F.coalesce(dur, F.lit(0))).alias("__end"),
        F.count(F.when(F.col(t).isNull(), 1)).alias("untimed"),
    )
    end = F.greatest("__end", F.col("last_us") + F.col("max_quantum_us"))
    out = out.withColumn("end_us", end).withColumn("span_us", F.greatest(F.col("end_us") - F.col("first_us"), F.lit(0).cast("long")))
    return with_verdict(out.drop("__end"), (F.col("untimed") > 0, "row without timestamp"))


def timeline_totals(summary: DataFrame, *, file_keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Origin, end, span and largest quantum over all streams of a file."""
    return summary.groupBy(*file_keys).agg(
        F.count(F.lit(1)).alias("streams"),
        F.min("first_us").alias("origin_us"),
        F.max("end_us").alias("end_us"),
        F.greatest(F.max("end_us") - F.min("first_us"), F.lit(0).cast("long")).alias("span_us"),
        F.max("max_quantum_us").alias("max_quantum_us"),
    )


def packet_timeline(
    packets: DataFrame, *, keys: Sequence[str] = KEYS, pts: str = "pts_us", duration: str = "duration_us"
) -> DataFrame:
    """Earliest presentation time and latest packet end; a missing time or negative duration is invalid."""
    out = packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min(pts).alias("start_us"),
        F.max(F.col(pts) + F.coalesce(F.col(duration), F.lit(0))).alias("end_us"),
        F.count(F.when(F.col(pts).isNull(), 1)).alias("untimed"),
        F.count(F.when(F.col(duration) < 0, 1)).alias("negative_durations"),
    )
    return with_verdict(
        out, (F.col("untimed") > 0, "packet without timestamp"), (F.col("negative_durations") > 0, "negative duration")
    )


def monotone_check(
    rows: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    t: str = "t_us",
    order: str = "ordinal",
    dense: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Times must strictly increase; reports the first violating ordinal."""
    d = neighbours(rows.select(*keys, order, t), keys=keys, order=order, prev=[t], dense=dense, block_rows=block_rows)
    bad = F.col(t).isNull() | (F.col(t) <= F.col(f"prev_{t}"))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(bad, 1)).alias("violations"),
        F.min(F.when(bad, F.col(order))).alias("first_bad"),
    )
    return with_verdict(out, (F.col("violations") > 0, "timestamps not strictly increasing"))


def _frame_us(num: Column, den: Column) -> Column:
    return den * 1e6 / num


def constant_clock_check(
    rows: DataFrame,
    rates: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    t: str = "t_us",
    order: str = "ordinal",
    tolerance: str = "tolerance_us",
    origin: str | None = None,
) -> DataFrame:
    """Row n must sit at ``origin + n * frame`` within the tolerance.

    ``rates`` has one row per stream: ``rate_num, rate_den, tolerance_us`` and optionally an
    ``origin`` column (default: the time of row 0).  Declared 24000/1001 streams also pass on
    the 2997/125 clock; ``used_num/used_den`` name the clock that was accepted.  Extremes of
    ``t - n * frame`` decide, so nothing is sorted.
    """
    keys = list(keys)
    d = attach(rows.select(*keys, order, t), rates, keys, spread=order, how="inner")
    declared = F.col(t) - F.col(order) * _frame_us(F.col("rate_num"), F.col("rate_den"))
    other = F.col(t) - F.col(order) * _frame_us(F.lit(float(FILM_ALTERNATIVE[0])), F.lit(float(FILM_ALTERNATIVE[1])))
    first = F.min(origin) if origin else F.min(F.when(F.col(order) == 0, F.col(t)))
    out = d.groupBy(*keys, "rate_num", "rate_den", tolerance).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(F.col(t).isNull(), 1)).alias("untimed"),
        first.alias("origin_us"),
        F.min(declared).alias("__dl"), F.max(declared).alias("__dh"),
        F.min(other).alias("__al"), F.max(other).alias("__ah"),
    )
    off = lambda lo, hi: F.greatest(F.col(hi) - F.col("origin_us"), F.col("origin_us") - F.col(lo))
    film = (F.col("rate_num") * FILM_RATE[1] == F.col("rate_den") * FILM_RATE[0])
    tol = F.col(tolerance)
    good_declared = off("__dl", "__dh") <= tol
    good_other = film & (off("__al", "__ah") <= tol)
    out = (
        out.withColumn("max_residual_us", off("__dl", "__dh"))
        .withColumn("reconciled", ~good_declared & good_other)
        .withColumn("used_num", F.when(F.col("reconciled"), FILM_ALTERNATIVE[0]).otherwise(F.col("rate_num")).cast("long"))
        .withColumn("used_den", F.when(F.col("reconciled"), FILM_ALTERNATIVE[1]).otherwise(F.col("rate_den")).cast("long"))
    )
    return with_verdict(
        out,
        (F.col("untimed") > 0, "row without timestamp"),
        (~good_declared & ~good_other, "not a constant frame clock"),
    ).drop("__dl", "__dh", "__al", "__ah")


def reorder_check(
    packets: DataFrame,
    rates: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    pts: str = "pts_us",
    order: str = "ordinal",
    limit: int = REORDER_LIMIT,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Decode-order packets must present without ties, at most ``limit`` positions early, on a constant clock.

    ``rates`` has one row per stream: ``rate_num, rate_den, tolerance_us, expected_frames``; the
    clock starts at ``origin_us`` when that column exists, else at the earliest time.
    """
    keys = list(keys)
    # One pass: a block of times becomes one row, its ranks counted from its own start; the rows before it then move them all alike.
    wanted = ["rate_num", "rate_den", "tolerance_us", "expected_frames", *(["origin_us"] if "origin_us" in rates.columns else [])]
    d = attach(packets.select(*keys, order, pts), rates.select(*keys, *wanted), keys, spread=order, how="inner", dense=False)
    d = d.withColumn("__timed", F.col(pts).isNotNull()).withColumn("__block", F.coalesce(blocks.time_block(pts, block_us), blocks.ordinal_block(order)))
    home = [*keys, "__timed", "__block"]
    inside = W.partitionBy(*home).orderBy(pts, order)
    d = d.withColumns({"__rank": F.row_number().over(inside) - 1, "__tie": F.col(pts) == F.lag(pts).over(inside), "__frame": _frame_us(F.col("rate_num"), F.col("rate_den"))})
    residual = F.col(pts) - F.col("__rank") * F.col("__frame")
    parts = d.groupBy(*home).agg(
        F.count(F.lit(1)).alias("packets"), F.count(pts).alias("__n"), F.count(F.when(F.col("__tie"), 1)).alias("__ties"), F.max(F.col(order) - F.col("__rank")).alias("__early"),
        F.min(residual).alias("__lo"), F.max(residual).alias("__hi"), F.min(pts).alias("__first"), F.max("__frame").alias("__frame"), *[F.max(c).alias(c) for c in wanted],
    )
    before = W.partitionBy(*keys).orderBy("__block", "__timed").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    timed = lambda c: F.when(F.col("__timed"), c)
    shift = F.col("__before") * F.col("__frame")
    out = parts.groupBy(*keys).agg(
        F.sum("packets").alias("packets"),
        F.sum(F.col("packets") - F.col("__n")).alias("untimed"),
        F.max(timed(F.col("__early") - F.col("__before"))).alias("max_depth"),
        F.min(F.col("origin_us" if "origin_us" in wanted else "__first")).alias("clock_origin_us"),
        F.min(F.col("__lo") - shift).alias("__lo"), F.max(F.col("__hi") - shift).alias("__hi"),
        F.min("tolerance_us").alias("__tol"),
        F.sum(timed(F.col("__ties"))).alias("duplicates"),
        F.min("expected_frames").alias("expected_frames"),
    )
    out = out.withColumn(
        "max_residual_us", F.greatest(F.col("__hi") - F.col("clock_origin_us"), F.col("clock_origin_us") - F.col("__lo"))
    )
    return with_verdict(
        out,
        (F.col("untimed") > 0, "packet without timestamp"),
        ((F.col("duplicates") > 0) | (F.col("max_depth") > limit), "times repeat or reorder too far"),
        (F.col("max_residual_us") > F.col("__tol"), "not a constant frame clock"),
        (F.col("packets") != F.col("expected_frames"), "packet count differs"),
    ).drop("__lo", "__hi", "__tol")


def ordered_clock_check(
    packets: DataFrame,
    rates: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    pts: str = "pts_us",
    dts: str = "dts_us",
    duration: str = "duration_us",
    flags: str = "flags",
    order: str = "ordinal",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Packets that are already an ordered constant clock from zero, starting on a keyframe."""
    keys = list(keys)
    d = neighbours(packets.select(*keys, order, pts, dts, duration, flags), keys=keys, order=order, prev=[pts], block_rows=block_rows)
    d = attach(d, rates, keys, spread=order, how="inner", extent_of=packets)
    frame = _frame_us(F.col("rate_num"), F.col("rate_den"))
    p, n = F.col(pts), F.col(order)
    first = n == 0
    last = n + 1 == F.col("expected_frames")
    good = (
        (p == F.col(dts))
        & (F.col(duration) > 0)
        & ~F.col(flags).rlike("[CD]")
        & F.when(first, (p == 0) & F.col(flags).contains("K")).otherwise(p > F.col(f"prev_{pts}"))
        & (F.abs(p - n * frame) <= F.col("tolerance_us"))
        & (~last | (F.abs(p + F.col(duration) - F.col("expected_frames") * frame) <= F.col("tolerance_us")))
    )
    bad = ~F.coalesce(good, F.lit(False))
    out = d.groupBy(*keys, "expected_frames").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(bad, 1)).alias("violations"),
        F.min(F.when(bad, n)).alias("first_bad"),
    )
    return with_verdict(
        out, (F.col("violations") > 0, "not an ordered clock"), (F.col("packets") != F.col("expected_frames"), "packet count differs")
    )


def repair_timestamps(
    rows: DataFrame, *, keys: Sequence[str] = KEYS, t: str = "t_us", order: str = "ordinal", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``repaired_us``: unusable times repeat the last output, and the output never decreases."""
    d = rows.withColumn("__valid", F.when(F.col(t) >= 0, F.col(t)))
    d = running(d, keys=keys, order=[order], maxes={"__high": "__valid"}, block_rows=block_rows)
    return d.withColumn("repaired_us", F.coalesce("__high", F.lit(0).cast("long"))).drop("__valid", "__high")


def tiling_check(
    intervals: DataFrame,
    totals: DataFrame,
    *,
    keys: Sequence[str] = ("file_id",),
    start: str = "start_frame",
    end: str = "end_frame",
    order: str = "n",
    total: str = "frames",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Intervals must start at 0, abut exactly and end at the total."""
    keys = list(keys)
    d = neighbours(intervals.select(*keys, order, start, end), keys=keys, order=order, prev=[end], dense=False, block_rows=block_rows)
    bad = (F.col(start) != F.coalesce(F.col(f"prev_{end}"), F.lit(0))) | (F.col(end) <= F.col(start))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.min(F.when(bad, F.col(order))).alias("first_bad"),
        F.max(end).alias("last_end"),
    )
    out = totals.select(*keys, F.col(total).alias("total")).join(out, keys, "left").withColumn(
        "intervals", F.coalesce("intervals", F.lit(0).cast("long"))
    )
    return with_verdict(
        out,
        (F.col("intervals") == 0, "no intervals"),
        (F.col("first_bad").isNotNull(), "intervals do not tile"),
        (F.col("last_end") != F.col("total"), "intervals do not end at the total"),
    )


def resolve_frame_interval(edits: DataFrame, streams: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edit intervals in frames or milliseconds as exact frame ranges.

    ``edits``: ``start_ms, end_ms`` or ``start_frame, end_frame``; ``streams``: ``frames, rate_num, rate_den``.
    """
    keys = list(keys)
    d = attach(edits, streams.select(*keys, "frames", "rate_num", "rate_den"), keys, spread="edit_id", dense=False)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scale = (wide("rate_den") * F.lit(1000)).cast("decimal(22,0)")

    def ceil_frame(ms: str) -> Column:
        product = (wide(ms) * wide("rate_num")).cast("decimal(38,0)")
        return F.call_function("div", product + scale - 1, scale).cast("long")

    by_time = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    fs = F.when(by_time, ceil_frame("start_ms")).otherwise(F.col("start_frame"))
    fe = F.when(by_time, ceil_frame("end_ms")).otherwise(F.col("end_frame"))
    inside = ~by_time | ((wide("end_ms") * wide("rate_num")).cast("decimal(38,0)") <= (wide("frames") * scale).cast("decimal(38,0)"))
    out = d.withColumn("from_frame", fs).withColumn("to_frame", fe).withColumn("__inside", inside)
    out = with_verdict(
        out,
        (F.col("frames").isNull() | (F.col("rate_num") <= 0) | (F.col("rate_den") <= 0), "invalid source rate"),
        (by_time & (F.col("end_ms") <= F.col("start_ms")), "empty interval"),
        (F.col("to_frame") <= F.col("from_frame"), "empty interval"),
        ((F.col("to_frame") > F.col("frames")) | ~F.col("__inside"), "past the end"),
    )
    return out.withColumn("frame_count", F.when(F.col("ok"), F.col("to_frame") - F.col("from_frame"))).drop("__inside")


def audio_continuity(
    frames: DataFrame,
    rates: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    t: str = "t_us",
    samples: str = "samples",
    rate: str = "rate",
    order: str = "ordinal",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Start, total samples and the residual envelope of the sample clock per stream.

    ``rates`` has one row per stream: ``sample_rate`` and ``tolerance_us``.  The prefix sum of
    samples is stitched over blocks; the envelope needs only extremes.
    """
    keys = list(keys)
    d = running(frames.select(*keys, order, t, samples, rate), keys=keys, order=[order], sums={"__before": samples}, block_rows=block_rows)
    d = attach(d, rates.select(*keys, "sample_rate", "tolerance_us"), keys, spread=order, how="inner", extent_of=frames)
    drift = F.col(t) - F.col("__before") * 1e6 / F.col("sample_rate")
    out = d.groupBy(*keys, "sample_rate", "tolerance_us").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(F.when(F.col(order) == 0, F.col(t))).alias("start_us"),
        F.sum(samples).alias("samples"),
        F.min(drift).alias("__lo"), F.max(drift).alias("__hi"),
        F.count(F.when(F.col(rate) != F.col("sample_rate"), 1)).alias("rate_changes"),
        F.count(F.when(F.col(t).isNull() | ~F.coalesce(F.col(samples) > 0, F.lit(False)), 1)).alias("unusable"),
    )
    out = out.withColumn("min_residual_us", F.least(F.col("__lo") - F.col("start_us"), F.lit(0.0)))
    out = out.withColumn("max_residual_us", F.greatest(F.col("__hi") - F.col("start_us"), F.lit(0.0)))
    worst = F.greatest(-F.col("min_residual_us"), F.col("max_residual_us"))
    return with_verdict(
        out.drop("__lo", "__hi"),
        (F.col("rate_changes") > 0, "sample rate changed"),
        (F.col("unusable") > 0, "frame without time or samples"),
        (worst > F.col("tolerance_us"), "gap or overlap"),
    )


def clip_audio(summary: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sample range of ``[start, end)`` (microseconds) on each stream's sample clock, rounded up."""
    def at(time: Column) -> Column:
        exact = (time - F.col("start_us")) * F.col("sample_rate") / 1e6 - 1e-7
        return F.least(F.greatest(F.ceil(exact), F.lit(0).cast("long")), F.col("samples"))

    out = summary.withColumn("first_sample", at(start)).withColumn("end_sample", at(end))
    begin = F.greatest(F.col("start_us") + F.col("first_sample") * 1e6 / F.col("sample_rate") - start, F.lit(0.0))
    return with_verdict(
        out.drop("ok", "reason").withColumn("clip_start_us", begin),
        (F.col("first_sample") >= F.col("end_sample"), "no samples inside the interval"),
    )


def audio_output_check(source: DataFrame, output: DataFrame, *, keys: Sequence[str] = KEYS, codec: str = "codec") -> DataFrame:
    """Output sample count against the source's, allowing resampler rounding and the codec's final frame."""
    keys = list(keys)
    s = source.select(*keys, F.col("start_us").alias("s_start"), F.col("samples").alias("s_samples"), F.col("sample_rate").alias("s_rate"))
    o = output.select(*keys, F.col("start_us").alias("o_start"), F.col("samples").alias("o_samples"), F.col("sample_rate").alias("o_rate"), codec)
    d = s.join(o, keys)
    padding = F.col("o_samples") - F.col("s_samples") * F.col("o_rate") / F.col("s_rate")
    allowed = F.when(F.col(codec) == "aac", 1023.0).otherwise(2.0)
    d = d.withColumn("padding", padding)
    return with_verdict(
        d,
        (F.abs(F.col("s_start") - F.col("o_start")) > 2000, "decoded start changed"),
        ((F.col("padding") < -2.0) | (F.col("padding") > allowed + 2.0), "sample count changed"),
    )


def timeline_check(expected: DataFrame, actual: DataFrame, *, mode: str, file_key: str = "file_id", stream_key: str = "stream_index") -> DataFrame:
    """Compares two timeline summaries: ``mode="cut"`` or ``mode="rewrite"``.

    Tolerance is ``0.02 s + q * (boundaries + 2)`` with q the largest quantum of either file.
    """
    if mode not in ("cut", "rewrite"):
        raise ValueError(mode)
    slack, boundaries = (2, 1) if mode == "cut" else (0, 0)
    return _compare_timelines(expected, actual, slack, boundaries + 2, file_key, stream_key)


def _compare_timelines(expected, actual, slack, factor, fk, sk):
    def side(df: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(fk, sk, *[F.col(c).alias(f"{tag}_{c}") for c in ("frames", "first_us", "span_us")])
        files = df.groupBy(fk).agg(
            F.min("first_us").alias(f"{tag}_origin"), F.max("max_quantum_us").alias(f"{tag}_q"), F.count(F.lit(1)).alias(f"{tag}_streams")
        )
        return rows, files

    er, ef = side(expected, "e")
    ar, af = side(actual, "a")
    d = er.join(ar, [fk, sk], "full").join(ef.join(af, fk, "full"), fk)
    d = d.withColumn("tolerance_us", 20_000 + F.greatest("e_q", "a_q") * factor)
    span_off = F.abs(F.col("e_span_us") - F.col("a_span_us"))
    start_off = F.abs((F.col("e_first_us") - F.col("e_origin")) - (F.col("a_first_us") - F.col("a_origin")))
    d = d.withColumn("frame_change", F.col("a_frames") - F.col("e_frames")).withColumn("span_change_us", span_off).withColumn(
        "offset_change_us", start_off
    )
    return with_verdict(
        d,
        (F.col("e_streams").isNull() | F.col("a_streams").isNull() | (F.col("e_streams") != F.col("a_streams")), "stream count differs"),
        (F.col("a_frames").isNull() | F.col("e_frames").isNull(), "stream missing"),
        (F.abs("frame_change") > slack, "frame count changed"),
        (F.col("span_change_us") > F.col("tolerance_us"), "span changed"),
        (F.col("offset_change_us") > F.col("tolerance_us"), "start offset changed"),
    )


def concat_check(inputs: DataFrame, actual: DataFrame, *, keys: Sequence[str] = ("job_id",), position: str = "position", stream: str = "stream_index") -> DataFrame:
    """Joined file against its inputs: frame sums and the first input's relative start offsets.

    ``inputs`` holds a timeline summary per ``(job, position, stream)``; ``actual`` one per ``(job, stream)``.
    """
    keys = list(keys)
    jobs = inputs.groupBy(*keys).agg(
        F.max("max_quantum_us").alias("__qi"),
        F.count_distinct(position).alias("inputs"),
        F.min(F.when(F.col(position) == 0, F.col("first_us"))).alias("__o0"),
        F.count(F.when(F.col(position) == 0, 1)).alias("__n0"),
    )
    streams = inputs.groupBy(*keys, stream).agg(
        F.sum("frames").alias("expected_frames"),
        F.count(F.lit(1)).alias("__in"),
        F.min(F.when(F.col(position) == 0, F.col("first_us"))).alias("__f0"),
    ).where(F.col("__f0").isNotNull())
    outs = actual.groupBy(*keys).agg(
        F.max("max_quantum_us").alias("__qa"), F.min("first_us").alias("__oa"), F.count(F.lit(1)).alias("__na")
    )
    a = actual.select(*keys, stream, F.col("frames").alias("actual_frames"), F.col("first_us").alias("__fa"))
    d = streams.join(jobs, keys).join(outs, keys, "left").join(a, [*keys, stream], "left")
    d = d.withColumn("tolerance_us", 20_000 + F.greatest("__qi", "__qa") * (F.col("inputs") + 2))
    d = d.withColumn("offset_change_us", F.abs((F.col("__f0") - F.col("__o0")) - (F.col("__fa") - F.col("__oa"))))
    return with_verdict(
        d,
        (F.coalesce("__na", F.lit(0)) != F.col("__n0"), "stream count differs"),
        (F.col("actual_frames").isNull(), "stream missing"),
        (F.col("__in") != F.col("inputs"), "stream missing in an input"),
        (F.col("actual_frames") != F.col("expected_frames"), "frame count changed"),
        (F.col("offset_change_us") > F.col("tolerance_us"), "start offset changed"),
    ).drop("__qi", "__o0", "__n0", "__in", "__f0", "__qa", "__oa", "__na", "__fa")
