"""Report and cue writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.operators.cues import cue_lines
from reeltally.plans.blocks import BLOCK_ROWS, attach, neighbours, numbered
from reeltally.plans.verdicts import with_verdict
from reeltally.sources.lines import write_bundles

# Fixed value: the event field order of an ASS script.
ASS_HEADER = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def write_cues(
    cues: DataFrame, path: str, *, key: str = "file_id", headers: DataFrame | None = None, bundled: bool = False
) -> None:
    """One text document per file below ``path/<key>=.../``, cues in order.

    A document is one text file, which one task writes as it reads its sorted rows; it never holds them.  ``headers`` may give ``header`` text per file
    (ASS scripts); otherwise the format's own header is written.  With ``bundled`` the documents' lines lie in few files, named ``<key>=...``,
    see :func:`~reeltally.sources.lines.write_bundles`: a library of many short documents needs no folder for each.
    """
    lines = cue_lines(cues).select(key, F.col("n").cast("long").alias("n"), "format", "line")
    own = F.when(F.col("format") == "webvtt", "WEBVTT\n").when(F.col("format") == "ass", ASS_HEADER)
    heads = lines.groupBy(key).agg(F.min("format").alias("format")).withColumn("line", own)
    if headers is not None:
        given = headers.select(key, F.col("header").alias("__h"))
        heads = heads.join(given, key, "left").withColumn("line", F.coalesce("__h", "line")).drop("__h")
    heads = heads.where(F.col("line").isNotNull()).select(key, F.lit(-1).cast("long").alias("n"), "format", "line")
    if bundled:
        every = lines.unionByName(heads).select(key, F.col("n").alias("__n"), F.posexplode(F.split("line", "\n")).alias("__at", "value"))
        placed = numbered(every, keys=[key], order=["__n", "__at"]).withColumnRenamed("ordinal", "n")
        return write_bundles(placed, path, F.concat(F.lit(f"{key}="), F.col(key).cast("string")))
    out = lines.unionByName(heads).repartition(key).sortWithinPartitions(key, "n")
    out.select(key, F.col("line").alias("value")).write.mode("errorifexists").partitionBy(key).text(path)


def bitrate_csv(series: DataFrame, window_s: float, *, start: str = "start_s", keep: Sequence[str] = ()) -> DataFrame:
    """Window rows ready for CSV."""
    return series.select(
        *keep,
        F.col(start).alias("window_start_seconds"),
        (F.col(start) + window_s).alias("window_end_seconds"),
        F.col("mbps").alias("megabits_per_second"),
        F.col("packet_bytes").cast("string").alias("packet_bytes"),
    )


def quality_csv(points: DataFrame, reference_start: int = 0, candidate_start: int = 0, *, keep: Sequence[str] = ()) -> DataFrame:
    """Score rows ready for CSV; an infinite score is written as ``infinity``."""
    return points.select(
        *keep,
        F.col("frame").alias("comparison_frame"),
        (F.col("frame") + reference_start).alias("reference_frame"),
        (F.col("frame") + candidate_start).alias("candidate_frame"),
        F.coalesce(F.col("score").cast("string"), F.lit("infinity")).alias("score"),
    )


def metadata_csv(summary: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Summary columns as ``field,value`` cells, escaped against spreadsheet formulas."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields])
    rows = summary.select(*keys, F.explode(pairs).alias("p"))
    return rows.select(*keys, X.csv_cell("p.field").alias("field"), X.csv_cell("p.value").alias("value"))


def write_report_csv(series: DataFrame, metadata: DataFrame, path: str, *, partition: Sequence[str] = ()) -> None:
    """Series and metadata side by side as two CSV datasets below ``path``.

    Cells of ``metadata`` are already quoted, so that dataset is written as text lines.
    """
    series.write.mode("errorifexists").partitionBy(*partition).csv(f"{path}/series", header=True)
    meta = metadata.select(*partition, F.concat_ws(",", "field", "value").alias("value"))
    meta.write.mode("errorifexists").partitionBy(*partition).text(f"{path}/metadata")


def validate_report(
    points: DataFrame,
    reports: DataFrame,
    *,
    keys: Sequence[str],
    kind: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Gate before writing.

    ``kind="bitrate"``: ``points(i, start_s, mbps, packet_bytes)`` strictly ascending, finite.
    ``kind="quality"``: ``points(i, frame, score)`` with ``frame = i * step`` and ``ceil(frame_count / step)`` rows.
    ``reports`` has one row per key with ``fingerprint`` (64 hex) and for quality ``frame_count, step, metric``.
    """
    keys = list(keys)
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    hex64 = F.col("fingerprint").rlike("^[0-9a-fA-F]{64}$")
    if kind == "bitrate":
        d = neighbours(points.select(*keys, "i", "start_s", "mbps", "packet_bytes"), keys=keys, order="i", prev=["start_s"], dense=False, block_rows=block_rows)
        bad = (
            ~finite(F.col("start_s")) | ~finite(F.col("mbps")) | (F.col("mbps") < 0) | (F.col("packet_bytes") < 0)
            | F.coalesce(F.col("start_s") <= F.col("prev_start_s"), F.lit(False))
        )
        facts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min(F.when(bad, F.col("i"))).alias("first_bad"))
        out = reports.join(facts, keys, "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))
        rules = []
    elif kind == "quality":
        d = attach(points.select(*keys, "i", "frame", "score"), reports.select(*keys, "step", "metric"), keys, spread="i", how="inner")
        infinite = F.col("score").isNull() & (F.col("metric") == "psnr")
        bad = (F.col("frame") != F.col("i") * F.col("step")) | ~(infinite | finite(F.col("score")))
        facts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min(F.when(bad, F.col("i"))).alias("first_bad"))
        out = reports.join(facts, keys, "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))
        due = F.expr("(frame_count + step - 1) div step")
        rules = [
            ((F.col("frame_count") < 1) | (F.col("step") < 1), "settings out of range"),
            (F.col("points") != due, "point count differs"),
        ]
    else:
        raise ValueError(kind)
    return with_verdict(out, *rules, (F.col("first_bad").isNotNull(), "invalid point"), (~hex64, "invalid fingerprint"))
