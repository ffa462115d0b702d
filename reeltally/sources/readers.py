"""Corpus readers: many dump files to typed tables plus a quarantine table.

Every reader lists files with the Spark file sources, keeps the position inside each file as the ordinal and
takes ``file_id`` from the path.  Dumps of many small files may be ``bundled``, see :func:`~reeltally.sources.lines.write_bundles`.  Side information that a dump does not contain (formats, sampled
positions, expected counts) comes from ``context``, a table keyed by ``path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.sources import documents as docs
from reeltally.sources import records as rec
from reeltally.sources.json_splits import read_json_records
from reeltally.sources.lines import read_bundles, read_documents, read_lines
from reeltally.sources.records import read_tool_logs

__all__ = [
    "read_probe_documents", "read_packet_records", "read_packet_hashes", "read_frame_records", "read_frame_documents", "read_metric_reports",
    "read_frame_hashes", "read_cues", "read_grain_segments", "read_scene_slices", "read_job_history", "read_tool_logs", "read_detector_samples",
    "read_loudness_reports", "read_dynamic_metadata", "read_inventory", "read_chunk_progress",
]


def _with_context(df: DataFrame, context: DataFrame | None) -> DataFrame:
    return df if context is None else df.join(context, "path", "left")


def _documents(spark: SparkSession, path: str, glob: str | None, bundled: bool) -> DataFrame:
    return read_bundles(spark, path) if bundled else read_documents(spark, path, glob=glob)


def read_probe_documents(spark: SparkSession, path: str, *, glob: str = "*.json", context: DataFrame | None = None):
    """``(files, streams, chapters, quarantine)``; ``context`` may add ``size_bytes`` and ``modified_at``."""
    return docs.parse_probe_documents(_with_context(read_documents(spark, path, glob=glob), context))


def read_packet_records(spark: SparkSession, path: str, *, glob: str | None = None, stream_index: int | None = None):
    return rec.parse_packet_records(read_lines(spark, path, glob=glob), stream_index=stream_index)


def read_packet_hashes(spark: SparkSession, path: str, *, glob: str | None = None):
    return rec.parse_packet_hashes(read_lines(spark, path, glob=glob))


def read_frame_records(spark: SparkSession, path: str, *, glob: str | None = None):
    return rec.parse_frame_records(read_lines(spark, path, glob=glob))


def read_frame_documents(spark: SparkSession, path: str, *, glob: str = "*.json"):
    """JSON frame documents of any size, cut into records split by split."""
    return rec.parse_frame_objects(*read_json_records(spark, path, "frames", glob=glob))


def read_metric_reports(spark: SparkSession, path: str, metric: str, *, glob: str | None = None):
    """Per-frame scores of one dialect: ssim, psnr and xpsnr text or vmaf JSON."""
    if metric == "vmaf":
        return rec.parse_metric_objects(*read_json_records(spark, path, "frames", glob=glob))
    return rec.parse_metric_lines(read_lines(spark, path, glob=glob), metric)


def read_frame_hashes(spark: SparkSession, path: str, *, glob: str | None = None, strict: bool = False):
    return rec.parse_frame_hashes(read_lines(spark, path, glob=glob), strict=strict)


def read_cues(spark: SparkSession, path: str):
    """Subtitle files; the format follows the extension (srt, vtt, ass)."""
    d = read_documents(spark, path).withColumn("__e", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    # Extensions of the text subtitle formats.
    d = d.withColumn("format", F.when(F.col("__e") == "vtt", "webvtt").otherwise(F.col("__e"))).where(F.col("format").isin("srt", "webvtt", "ass"))
    return docs.parse_cue_documents(d.drop("__e"))


def read_grain_segments(spark: SparkSession, path: str, *, glob: str | None = None):
    return rec.parse_grain_segments(read_lines(spark, path, glob=glob))


def read_scene_slices(spark: SparkSession, path: str, context: DataFrame, *, glob: str = "*.json", bundled: bool = False):
    """``context`` maps each path to its ``file_id`` and ``slice``."""
    return docs.parse_scene_slices(_with_context(_documents(spark, path, glob, bundled), context))


def read_job_history(spark: SparkSession, path: str, *, glob: str = "*.json", bundled: bool = False):
    return docs.parse_job_history(_documents(spark, path, glob, bundled))


def read_detector_samples(spark: SparkSession, path: str, context: DataFrame, *, glob: str = "*.log"):
    """``(field_samples, gap_samples, crop_samples)``; ``context`` gives ``file_id, position, frame_w, frame_h`` per log."""
    lines = _with_context(read_lines(spark, path, glob=glob), context)
    return rec.parse_field_samples(lines), rec.parse_gap_samples(lines), rec.parse_crop_samples(lines)


def read_loudness_reports(spark: SparkSession, path: str, *, glob: str = "*.log", context: DataFrame | None = None, bundled: bool = False):
    return docs.parse_loudness_reports(_with_context(_documents(spark, path, glob, bundled), context))


def read_dynamic_metadata(spark: SparkSession, path: str, context: DataFrame, *, glob: str = "*.json"):
    """``context`` gives the expected ``frames`` per path."""
    return docs.parse_scene_objects(*read_json_records(spark, path, "SceneInfo", glob=glob, judge=docs.judge_scene_count(context)))


def read_inventory(spark: SparkSession, path: str, *, recursive: bool = True, max_media: int | None = None):
    return docs.scan_inventory(docs.list_files(spark, path, recursive=recursive), max_media)


def read_chunk_progress(spark: SparkSession, path: str, context: DataFrame, *, glob: str = "*.json"):
    """``context`` gives ``job_id`` and ``total_frames`` per path."""
    return docs.parse_chunk_progress(_with_context(read_documents(spark, path, glob=glob), context))


def file_verdict(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Per file: accepted rows, rejected records and the first bad one; any rejected record fails the file."""
    good = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"))
    # Quarantined documents have a path and no record number.
    if "file_id" not in quarantine.columns:
        quarantine = quarantine.withColumn("file_id", X.path_id("path"))
    if "n" not in quarantine.columns:
        quarantine = quarantine.withColumn("n", F.lit(0).cast("long"))
    quarantine = quarantine.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    bad = quarantine.groupBy("file_id").agg(F.count(F.lit(1)).alias("rejected"), F.min("n").alias("first_bad"), F.min_by("reason", "n").alias("reason"))
    d = good.join(bad, "file_id", "full").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "rejected")})
    return d.withColumn("ok", F.col("rejected") == 0)


def path_context(paths: DataFrame) -> DataFrame:
    """``path`` with the ``file_id`` that the readers derive from it."""
    return paths.select("path", X.path_id("path").alias("file_id"))
