"""Sampling plans, score pooling, ladders, detectors, loudness and size budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltally.plans.blocks import KEYS, attach
from reeltally.plans.verdicts import with_verdict

# Default recommendation thresholds per metric (none for XPSNR).
THRESHOLDS = {"psnr": 45.0, "ssim": 0.98, "vmaf": 95.0, "ssimulacra2": 80.0, "butteraugli": 4.0}
ERROR_DOMAIN = ("psnr", "xpsnr")
LOWER_IS_BETTER = ("butteraugli",)


def every_nth(rows: DataFrame, n: int, *, order: str = "ordinal") -> DataFrame:
    """Rows 0, n, 2n, ... with consecutive ``sample`` numbers; ``sample * n`` restores the ordinal."""
    if not 1 <= n <= 1000:
        raise ValueError("step must be 1..1000")
    return rows.where(F.col(order) % n == 0).withColumn("sample", F.expr(f"`{order}` div {n}"))


def plan_samples(files: DataFrame, count: int, section_s: float, *, seconds: str = "duration_s") -> DataFrame:
    """Centred sample windows per file: ``sample, start_s, length_s``.

    Both ends are skipped by five percent (at most a minute) unless that leaves too little room.
    """
    t = F.col(seconds)
    want = F.lit(max(count, 1))
    skip = F.least(t * 0.05, F.lit(60.0))
    tight = t - skip * 2.0 < want * F.lit(float(section_s))
    from_s = F.when(tight, 0.0).otherwise(skip)
    span = F.when(tight, t).otherwise(t - skip * 2.0)
    fits = F.greatest(F.floor(span / section_s), F.lit(1).cast("long"))
    n = F.least(want.cast("long"), fits)
    d = files.where(t > 0).withColumns({"__from": from_s, "__span": span, "__n": n, "__whole": t <= section_s})
    d = d.withColumn("__n", F.when(F.col("__whole"), 1).otherwise(F.col("__n")))
    d = d.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = F.col("__from") + (F.col("sample") + 0.5) * (F.col("__span") / F.col("__n")) - section_s / 2.0
    start = F.least(F.greatest(start, F.lit(0.0)), t - section_s)
    return d.withColumn("start_s", F.when(F.col("__whole"), 0.0).otherwise(start)).withColumn(
        "length_s", F.when(F.col("__whole"), t).otherwise(float(section_s))
    ).drop("__from", "__span", "__n", "__whole")


def xpsnr_frame_error(y: Column, u: Column, v: Column) -> Column:
    """Weighted error of one frame; an infinite channel has no error."""
    err = lambda c: F.when(c == float("inf"), 0.0).otherwise(F.pow(F.lit(10.0), -c / 10.0))
    return (err(y) * 4.0 + err(u) + err(v)) / 6.0


def error_score(error: Column) -> Column:
    """Decibels of a mean error; null when the error is zero."""
    return F.when(error > 0, F.log10(error) * -10.0)


def pool_scores(
    points: DataFrame, *, keys: Sequence[str], metric: str = "metric", score: str = "score", weight: str | None = None
) -> DataFrame:
    """Pooled score per key and metric.

    PSNR and XPSNR pool in the error domain, where a null (infinite) score adds no error; any
    other metric is a weighted mean and null as soon as one score is missing.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = F.col(score)
    dB = F.col(metric).isin(*ERROR_DOMAIN)
    error = F.when(s.isNull(), 0.0).otherwise(F.pow(F.lit(10.0), -s / 10.0))
    out = points.groupBy(*keys, metric).agg(
        F.sum(w).alias("weight"),
        F.count(F.when(s.isNull(), 1)).alias("__missing"),
        F.sum(F.when(dB, error * w)).alias("__error"),
        F.sum(F.when(~dB, s * w)).alias("__total"),
    )
    mean = F.when((F.col("__missing") == 0) & (F.col("weight") > 0), F.col("__total") / F.col("weight"))
    pooled = F.when(dB, error_score(F.when(F.col("weight") > 0, F.col("__error") / F.col("weight")))).otherwise(mean)
    return out.withColumn("score", pooled).drop("__missing", "__error", "__total")


def ladder_summary(rungs: DataFrame, files: DataFrame, *, key: str = "file_id", crf: str = "crf") -> DataFrame:
    """Bytes, rate, bytes per minute and projected size per rung.

    ``rungs``: encoded samples with ``bytes, seconds``; ``files``: ``duration_s`` per file.
    """
    r = rungs.groupBy(key, crf).agg(F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
    r = r.join(files.select(key, F.col("duration_s").alias("source_s")), key, "left")
    per = lambda x: F.when(F.col("seconds") > 0, x / F.col("seconds"))
    return r.withColumns({
        "bitrate_kbps": F.coalesce(per(F.col("bytes") * 8.0) / 1000.0, F.lit(0.0)),
        "bytes_per_minute": F.coalesce(F.round(per(F.col("bytes") * 60.0)).cast("long"), F.lit(0).cast("long")),
        "projected_bytes": F.coalesce(F.round(per(F.col("bytes") * F.col("source_s"))).cast("long"), F.lit(0).cast("long")),
    }).drop("source_s")


def sampled_fraction(samples: DataFrame, files: DataFrame, *, key: str = "file_id") -> DataFrame:
    """Seconds sampled per file and their share of the source, at most one."""
    s = samples.groupBy(key).agg(F.sum("length_s").alias("sampled_s"))
    d = s.join(files.select(key, "duration_s"), key)
    return d.withColumn("fraction", F.least(F.col("sampled_s") / F.col("duration_s"), F.lit(1.0))).drop("duration_s")


def recommend_rung(
    rungs: DataFrame, *, key: str = "file_id", metric: str = "metric", crf: str = "crf", score: str = "score", threshold: str | None = None
) -> DataFrame:
    """Highest CRF whose score meets the metric's threshold; null scores pass only for PSNR and XPSNR."""
    t = F.lit(None).cast("double")
    for name, value in THRESHOLDS.items():
        t = F.when(F.col(metric) == name, value).otherwise(t)
    if threshold:
        t = F.coalesce(F.col(threshold).cast("double"), t)
    s, m = F.col(score), F.col(metric)
    passes = F.when(s.isNull(), m.isin(*ERROR_DOMAIN)).when(m.isin(*LOWER_IS_BETTER), s <= t).otherwise(s >= t)
    good = t.isNotNull() & F.coalesce(passes, F.lit(False))
    return rungs.groupBy(key, metric).agg(
        F.count(F.lit(1)).alias("rungs"), F.max(F.when(good, F.col(crf))).alias("recommended_crf")
    )


def crop_consensus(
    samples: DataFrame, *, keys: Sequence[str] = ("file_id",), frame_w: str = "frame_w", frame_h: str = "frame_h", paired: bool = False
) -> DataFrame:
    """Agreed crop margins per file.

    The most frequent rectangle wins when its share exceeds 80 %, else the union of all.  Ties go
    to the larger area, then to the larger rectangle in ``(x, y, w, h)`` order.  ``paired=True`` is the
    quality-comparison form: ties in ``(w, h, x, y)`` order and the union rounded out to even edges.
    """
    keys = list(keys)
    counts = samples.groupBy(*keys, frame_w, frame_h, "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n"))
    tie = ["w", "h", "x", "y"] if paired else ["x", "y", "w", "h"]
    best = F.max(F.struct("n", (F.col("w") * F.col("h")).alias("area"), *tie)).alias("best")
    d = counts.groupBy(*keys, frame_w, frame_h).agg(
        best,
        F.sum("n").alias("rectangles"),
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
    )
    if paired:
        even = lambda c: F.call_function("div", c, F.lit(2)) * 2
        d = d.withColumns({
            "x0": even(F.col("x0")), "y0": even(F.col("y0")),
            "x1": F.least(even(F.col("x1") + 1), F.col(frame_w)), "y1": F.least(even(F.col("y1") + 1), F.col(frame_h)),
        })
    clear = F.col("best.n") * 100 > F.col("rectangles") * 80
    pick = lambda agreed, union: F.when(clear, agreed).otherwise(union)
    b = F.col("best")
    half = F.call_function("div", F.col("rectangles"), F.lit(2))
    return d.select(
        *keys,
        pick(b["x"], F.col("x0")).alias("crop_left"),
        pick(b["y"], F.col("y0")).alias("crop_top"),
        (F.col(frame_w) - pick(b["x"] + b["w"], F.col("x1"))).alias("crop_right"),
        (F.col(frame_h) - pick(b["y"] + b["h"], F.col("y1"))).alias("crop_bottom"),
        F.call_function("div", b["n"] * 100 + half, F.col("rectangles")).alias("agreement_pct"),
    )


def field_gap_ratio(gaps: DataFrame, *, keys: Sequence[str] = ("file_id",), position: str = "n", value: str = "value") -> DataFrame:
    """Ratio of the mean field differences of the two parities; the first value of each sample is dropped."""
    later, v = F.col(position) >= 1, F.col(value)
    out = gaps.groupBy(*keys).agg(
        F.avg(F.when(later & (F.col(position) % 2 == 0), v)).alias("__a"), F.avg(F.when(later & (F.col(position) % 2 == 1), v)).alias("__b")
    )
    hi, lo = F.greatest("__a", "__b"), F.least("__a", "__b")
    usable = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (hi >= 0.5)
    ratio = F.when(usable, F.when(lo < 0.0001, 1e12).otherwise(hi / lo))
    return out.withColumn("gap_ratio", ratio).drop("__a", "__b")


def _order_of(tff, bff, progressive, undetermined, gap) -> Column:
    interlaced, dominant = tff + bff, F.greatest(tff, bff)
    total = interlaced + progressive + undetermined
    combed = (dominant > 0) & (dominant * 4 >= interlaced * 3) & ((interlaced > progressive) | (interlaced * 5 > total))
    split = F.coalesce(gap >= 4.0, F.lit(False))
    return (
        F.when(total == 0, "undetermined")
        .when(combed & ~split, F.when(bff > tff, "bottom first").otherwise("top first"))
        .otherwise("progressive")
    )


def field_order_verdict(
    samples: DataFrame, gap_ratios: DataFrame | None = None, declared: DataFrame | None = None, *, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """Field order per file from summed detector counts, the field-gap ratio and a declared order.

    ``samples``: ``tff, bff, progressive, undetermined, repeated, neither``; ``declared``: ``field_order``.
    """
    keys = list(keys)
    names = ["tff", "bff", "progressive", "undetermined", "repeated", "neither"]
    d = samples.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    d = d.join(gap_ratios.select(*keys, "gap_ratio"), keys, "left") if gap_ratios is not None else d.withColumn("gap_ratio", F.lit(None).cast("double"))
    counts = [F.col(c) for c in names[:4]]
    interim = _order_of(*counts, F.lit(None).cast("double"))
    gap = F.when(interim.isin("top first", "bottom first"), F.col("gap_ratio"))
    d = d.withColumn("gap_ratio", gap).withColumn("field_order", _order_of(*counts, F.col("gap_ratio")))
    share = F.col("repeated") * 5 > F.col("repeated") + F.col("neither")
    telecined = F.col("field_order").isin("top first", "bottom first") & (F.col("repeated") > 0) & share
    d = d.withColumn("telecined", telecined)
    if declared is not None:
        # Declared container field orders.
        said = declared.select(*keys, F.when(F.col("field_order") == "progressive", "progressive")
                               .when(F.col("field_order").isin("tt", "tb"), "top first")
                               .when(F.col("field_order").isin("bb", "bt"), "bottom first").alias("__said"))
        d = d.join(said.where(F.col("__said").isNotNull()), keys, "full")
        trusted = F.col("__said").isNotNull()
        d = d.withColumn("telecined", F.coalesce("telecined", F.lit(False)) & ~trusted)
        d = d.withColumn("gap_ratio", F.when(~trusted, F.col("gap_ratio")))
        d = d.withColumn("field_order", F.coalesce("__said", "field_order")).withColumn("declared", trusted).drop("__said")
    return d


def gain_proposal(
    loudness: DataFrame, *, target: str = "target_lufs", limit: str = "peak_limit_db", integrated: str = "integrated", peak: str = "peak"
) -> DataFrame:
    """Flat gain toward a loudness target, limited by true-peak headroom, in whole tenths of a dB."""
    wanted = F.col(target) - F.col(integrated)
    headroom = F.col(limit) - F.col(peak)
    known = F.col(integrated).isNotNull() & F.col(peak).isNotNull()
    safe = F.when(known, F.least(wanted, headroom, F.lit(24.0)))
    return loudness.withColumn("gain_tenths_db", F.when(safe >= -60.0, F.floor(safe * 10.0).cast("long"))).withColumn(
        "limited_by_peak", F.coalesce(known & (headroom < wanted), F.lit(False))
    )


def target_bytes(mib: Column | None = None, tenths: Column | None = None) -> Column:
    """Target size in bytes from whole MiB or tenths of a MiB, rounded once."""
    if mib is not None:
        return mib.cast("long") * 1_048_576
    return F.call_function("div", tenths.cast("long") * 1_048_576 + 5, F.lit(10))


def size_budget(
    packets: DataFrame,
    targets: DataFrame,
    *,
    key: str = "file_id",
    kind: str = "kind",
    size: str = "size",
) -> DataFrame:
    """Video bitrate left by a target size after all other streams and the container reserve.

    ``targets``: ``target_bytes, seconds`` per file.
    """
    other = packets.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(kind) != "video", F.col(size))), F.lit(0)).cast("long").alias("other_bytes"))
    d = targets.select(key, "target_bytes", "seconds").join(other, key, "left")
    d = d.withColumn("other_bytes", F.coalesce("other_bytes", F.lit(0).cast("long")))
    reserve = F.expr("target_bytes div 100") + 65_536
    room = F.col("target_bytes") - F.col("other_bytes") - reserve
    rate = F.floor(room * 8.0 / F.col("seconds") / 1000.0).cast("long")
    d = d.withColumn("available_bytes", room).withColumn("__kbps", F.when((F.col("seconds") > 0) & (room >= 0), rate))
    d = with_verdict(
        d,
        (room < 0, "target cannot hold the other streams"),
        (~F.coalesce(F.col("__kbps").between(1, 100_000), F.lit(False)), "bitrate out of range"),
    )
    return d.withColumn("kbps", F.when(F.col("ok"), F.col("__kbps"))).drop("__kbps")


def downsample_series(rows: DataFrame, limit: int, *, keys: Sequence[str] = KEYS, order: str = "ordinal") -> DataFrame:
    """At most ``limit`` chart points per series: every ``ceil(n / limit)``-th row and always the last."""
    keys, limit = list(keys), max(limit, 1)
    size = rows.groupBy(*keys).agg((F.max(order) + 1).alias("__n"))
    d = attach(rows, size, keys, spread=order)
    stride = F.greatest(F.expr(f"(__n + {limit - 1}) div {limit}"), F.lit(1).cast("long"))
    picked = (F.col(order) % stride == 0) & (F.call_function("div", F.col(order), stride) < limit - 1)
    return d.where(picked | (F.col(order) == F.col("__n") - 1)).drop("__n")
