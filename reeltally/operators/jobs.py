"""Job logs, job history, chunk progress and batch outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.functions.exprs import RECOVERABLE_STATES, TERMINAL_STATES
from reeltally.plans.blocks import BLOCK_ROWS, neighbours
from reeltally.plans.verdicts import with_verdict

JOB_LOG_NAME = r"^([0-9]+-[0-9]+-[0-9]+)\.(log|.*\.log)(\.1)?$"
ORPHAN_DAYS = 30
# Patterns of tool messages.
PLAIN_LINE = r"^\s*(?:Source|Output|Tool|Command|Mux log|Tool log path):"
STAGE_PREFIX = r"(?i)^\s*\[(?:producer|consumer)\]\s*"
TOOL_PREFIX = r"(?i)^(?:\[(?!(?:error|fatal|warn|warning)\])[^\]]+\]\s*)+"
ERROR_LINE = (
    r"(?i)^(?:[\w.-]+\s*)?\[(?:error|fatal)\]",
    r"(?i)^(?:Error\b|Fatal\b|Failed to\b|Could not\b|Cannot\b|Conversion failed[!.]?$)",
)
WARNING_LINE = (r"(?i)^(?:[\w.-]+\s*)?\[(?:warn|warning)\]", r"(?i)^(?:Warning\b|Warn:)")
SUCCESS_LINE = (
    r"(?i)^(?:Verified output published\.|Output verified and saved\.|Finished and saved\.|encoded \d+ frames\b)"
)
PROGRESS_LINE = (
    r"(?i)^(?:frame=\s*\d|Encoding:?\s+\d|Encoding frame\s+\d|\d+\s+frames:|\[?\d+(?:\.\d+)?%\]?\s+\d+\/\d+)"
)
PHASE_LINE = (
    r"^(?:Inspecting |Reading |Planning |Will encode |Encoding .+ with |Muxing |Checking |Output check:|Generated command confirmed)"
)
ATTACHMENT_PROBE = r"Could not find codec parameters for stream \d+ \(Attachment\b"
PROBE_ADVICE = r"Consider increasing the value for the 'analyzeduration'"
TOOL_OUTPUT = r"^(?:\s|\[)"
BOOKKEEPING = r"^(?:Tool|Owned temporary [^:]+|Mux log|[\w -]+ log): "
PAUSE_NOTICE = r"^(?:Paused|Continued) the media job process trees\."


def log_tone(text: str | Column) -> Column:
    """plain, phase, progress, success, warning or error of one log line, by ordered rules."""
    line = F.col(text) if isinstance(text, str) else text
    message = F.ltrim(F.regexp_replace(line, STAGE_PREFIX, ""))
    diagnostic = F.regexp_replace(message, TOOL_PREFIX, "")
    any_of = lambda c, patterns: c.rlike(patterns[0]) | c.rlike(patterns[1])
    return (
        F.when(line.rlike(PLAIN_LINE), "plain")
        .when(any_of(diagnostic, ERROR_LINE), "error")
        .when(any_of(diagnostic, WARNING_LINE), "warning")
        .when(message.rlike(SUCCESS_LINE), "success")
        .when(message.rlike(PROGRESS_LINE), "progress")
        .when(message.rlike(PHASE_LINE), "phase")
        .otherwise("plain")
    )


def classify_log_lines(lines: DataFrame, *, text: str = "text") -> DataFrame:
    return lines.withColumn("tone", log_tone(text))


def drop_probe_noise(
    lines: DataFrame, *, keys: Sequence[str] = ("job_id",), order: str = "n", text: str = "text", dense: bool = True, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Without attachment-probe warnings and the advice line right after each."""
    probe = lines.withColumn("__probe", F.col(text).rlike(ATTACHMENT_PROBE))
    d = neighbours(probe, keys=keys, order=order, prev=["__probe"], dense=dense, block_rows=block_rows)
    advice = F.col(text).rlike(PROBE_ADVICE) & F.coalesce("prev___probe", F.lit(False))
    return d.where(~F.col("__probe") & ~advice).drop("__probe", "prev___probe")


def latest_step(lines: DataFrame, *, keys: Sequence[str] = ("job_id",), order: str = "n", text: str = "text") -> DataFrame:
    """Newest line per job that is a step: not blank, tool output, bookkeeping or a pause notice."""
    t = F.col(text)
    step = (X.strip(t) != "") & ~t.rlike(TOOL_OUTPUT) & ~t.rlike(BOOKKEEPING) & ~t.rlike(PAUSE_NOTICE)
    return lines.groupBy(*keys).agg(F.max_by(F.when(step, X.strip(t)), F.when(step, F.col(order))).alias("step"))


def log_tail(
    lines: DataFrame, *, keys: Sequence[str] = ("job_id",), order: str = "n", text: str = "text", rows: int = 30, width: int = 500
) -> DataFrame:
    """Last lines per job, each cut to ``width`` characters.

    The rank filter lets Spark keep only ``rows`` lines per job in each map task before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    d = lines.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows)
    return d.withColumn(text, F.substring(text, 1, width)).drop("__r")


def orphan_logs(files: DataFrame, jobs: DataFrame, now_us: Column, *, days: int = ORPHAN_DAYS) -> DataFrame:
    """Log files named after no known job and last written over ``days`` ago.

    ``files``: ``name, modified_us``.  Names that are not job logs are never listed.
    """
    owner = F.regexp_extract("name", JOB_LOG_NAME, 1)
    old = F.col("modified_us") < now_us - days * 86_400_000_000
    d = files.where(old).withColumn("job_id", owner).where(F.col("job_id") != "")
    return d.join(jobs.select("job_id"), "job_id", "left_anti")


def chunk_progress(chunks: DataFrame, totals: DataFrame, *, key: str = "job_id") -> DataFrame:
    """Done frames and chunks, remaining chunks and encoded bytes per job; over-counts are rejected.

    ``chunks``: ``chunk, frames, done, bytes``; ``totals``: ``total_frames``.
    """
    done = F.col("done")
    d = chunks.groupBy(key).agg(
        F.coalesce(F.sum(F.when(done, F.col("frames"))), F.lit(0)).cast("long").alias("done_frames"),
        F.count(F.when(done, 1)).alias("done_chunks"),
        F.count(F.when(~done, 1)).alias("remaining_chunks"),
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).cast("long").alias("encoded_bytes"),
    )
    d = totals.select(key, "total_frames").join(d, key, "left").fillna(0, ["done_frames", "done_chunks", "remaining_chunks", "encoded_bytes"])
    return with_verdict(d, (F.col("done_frames") > F.col("total_frames"), "more frames done than planned"))


def remaining_chunks(planned: DataFrame, finished: DataFrame, *, keys: Sequence[str] = ("job_id", "chunk")) -> DataFrame:
    return planned.join(finished.select(*keys), list(keys), "left_anti")


def batch_outcome(rows: DataFrame, *, key: str = "batch_id") -> DataFrame:
    """Completed, failed and skipped rows per batch.

    ``rows``: ``state`` succeeded, failed, canceled or skipped; a canceled or skipped row marks the batch.
    """
    s = F.col("state")
    stopped = s.isin("canceled", "skipped")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(s == "succeeded", 1)).alias("completed"),
        F.count(F.when(s.isin("failed", "canceled"), 1)).alias("failed"),
        F.count(F.when(s == "skipped", 1)).alias("skipped"),
        F.coalesce(F.bool_or(stopped), F.lit(False)).alias("canceled"),
    )


def list_recoverable_jobs(jobs: DataFrame, progress: DataFrame, *, backend: str = "av1an") -> DataFrame:
    """Ended but unfinished jobs with saved progress, newest run first.

    ``jobs``: ``job_id, state, backend, last_run_us``; ``progress``: output of :func:`chunk_progress`.
    """
    d = jobs.where(F.col("state").isin(*RECOVERABLE_STATES) & (F.col("backend") == backend))
    saved = progress.where(F.col("ok") & (F.col("done_chunks") > 0)).select("job_id", "done_chunks", "encoded_bytes")
    return d.join(saved, "job_id").orderBy(F.col("last_run_us").desc(), "job_id")


def latest_job_state(events: DataFrame, *, key: str = "job_id", time: str = "event_us", order: str = "seq") -> DataFrame:
    """Newest snapshot per job with progress clamped to its duration.

    Where ``estimated`` is set the duration grows to the progress instead.  ``order`` breaks ties in time.
    """
    fields = F.struct("state", "progress_s", "duration_s", "estimated", F.col(time).alias("last_us"))
    d = events.groupBy(key).agg(
        F.max_by(fields, F.struct(time, order)).alias("s"),
        F.count(F.lit(1)).alias("snapshots"),
    )
    return clamp_progress(d.select(key, "s.*", "snapshots"))


def clamp_progress(d: DataFrame) -> DataFrame:
    grown = F.when(F.coalesce("estimated", F.lit(False)) & (F.col("progress_s") > F.col("duration_s")), F.col("progress_s"))
    d = d.withColumn("duration_s", F.coalesce(grown, "duration_s"))
    d = d.withColumn("progress_s", F.when(F.col("progress_s") > F.col("duration_s"), F.col("duration_s")).otherwise(F.col("progress_s")))
    return d.withColumn("terminal", F.col("state").isin(*TERMINAL_STATES))
