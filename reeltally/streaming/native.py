"""Streams that need only built-in aggregation: windowed rate and latest job state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.operators.jobs import clamp_progress
from reeltally.operators.rates import every_window
from reeltally.plans.blocks import KEYS


def stream_windowed_rate(
    packets: DataFrame,
    window_us: int,
    *,
    keys: Sequence[str] = KEYS,
    t: str = "t_us",
    size: str = "size",
    watermark: str = "1 hour",
) -> DataFrame:
    """Bytes per fixed window over arriving packets.

    Append mode emits a window once the watermark passes it; update mode emits every change.
    Windows are aligned to time zero, negative times included.
    """
    timed = packets.where(F.col(t).isNotNull()).withColumn("event_time", F.timestamp_micros(F.col(t)))
    win = F.window("event_time", f"{window_us} microseconds")
    g = timed.withWatermark("event_time", watermark).groupBy(*keys, win.alias("w")).agg(F.sum(size).alias("packet_bytes"))
    return g.select(*keys, F.unix_micros("w.start").alias("start_us"), "packet_bytes")


def fill_windows(updates: DataFrame, window_us: int, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Final value per window from the written updates, zero-filled between first and last window."""
    keys = list(keys)
    final = updates.groupBy(*keys, "start_us").agg(F.max_by("packet_bytes", "batch").alias("packet_bytes"))
    span = final.groupBy(*keys).agg(F.min("start_us").alias("lo"), F.max("start_us").alias("hi"))
    spine = every_window(span, keys, "lo", "hi", "start_us", window_us)
    d = spine.join(final, [*keys, "start_us"], "left")
    b = F.coalesce("packet_bytes", F.lit(0).cast("long"))
    return d.select(*keys, "start_us", b.alias("packet_bytes"), (b * 8.0 / F.lit(float(window_us))).alias("mbps"))


def stream_job_state(events: DataFrame, *, key: str = "job_id", time: str = "event_us", order: str = "seq") -> DataFrame:
    """Newest snapshot per job in update mode; :func:`newest_job_state` reads the written updates."""
    fields = F.struct("state", "progress_s", "duration_s", "estimated", F.col(time).alias("last_us"))
    g = events.groupBy(key).agg(F.max_by(fields, F.struct(time, order)).alias("s"), F.count(F.lit(1)).alias("snapshots"))
    return g.select(key, "s.*", "snapshots")


def newest_job_state(updates: DataFrame, *, key: str = "job_id") -> DataFrame:
    rest = [c for c in updates.columns if c not in (key, "batch")]
    d = updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")
    return clamp_progress(d)
