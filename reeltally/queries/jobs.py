"""Registered queries: logs, history, progress."""

import re

from pyspark.sql import functions as F

from reeltally.operators import jobs
from reeltally.plans.blocks import numbered
from reeltally.queries import stand_ins as v
from reeltally.queries.registry import query

L = lambda x: F.lit(x).cast("long")

# Messages of tools, picked by event number and filled from the event's columns.
MESSAGES = (
    "Inspecting source streams {props}", "[consumer] Encoding: {id}/{cents} Frames @ {user}.5 fps", "Svt[info]: preset {props}", "x265 [error] malloc failed for {id}",
    "Source: /library/{type}/Error Report {user}.mkv", "[producer] Warning: deprecated pixel format {type}", "Could not find codec parameters for stream {id} (Attachment: ttf)",
    "Consider increasing the value for the 'analyzeduration' ({user}) and 'probesize' ({cents}) options", "Verified output published. {props}", "Failed to open file {id}",
    "Paused the media job process trees.", "Mux log: /tmp/{user}/mux.txt", "   Last message repeated {id} times", "frame=  {id} fps= 24 {type}", "[mp4 @ 0x{user}] [warning] non monotonous",
    "Encoding video {user} with SVT-AV1", "", "{user}.0% {id}/{cents} done", "cannot allocate {props}", "{type}: {props}", "{props} {type} {id}",
)
COLUMNS = {
    "props": ("props", "props"), "type": ("event_type", "event_type"), "id": ("cast(event_id AS string)", "event_id::VARCHAR"),
    "user": ("cast(user_id AS string)", "user_id::VARCHAR"), "cents": ("cast(cast(round(value * 100) AS bigint) AS string)", "CAST(round(value * 100) AS BIGINT)::VARCHAR"),
}


def _filled(message: str, side: int):
    """The message's parts as columns (0) or SQL (1): names in braces are columns of the events."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", message)):
        if side == 0:
            out.append(F.expr(COLUMNS[part][0]) if i % 2 else F.lit(part))
        else:
            out.append(COLUMNS[part][1] if i % 2 else "'" + part.replace("'", "''") + "'")
    return F.concat(*out) if side == 0 else " || ".join(out)


def log_lines(spark, sf):
    """One line per event; the job is the user, the line number follows the event order."""
    e = v.events(spark, sf)
    text = F.element_at(F.array(*[_filled(m, 0) for m in MESSAGES]), (F.col("event_id") * 8 % len(MESSAGES) + 1).cast("int"))
    d = e.select(F.col("user_id").alias("job_id"), "event_id", "t_us", text.alias("text"))
    return numbered(d, keys=["job_id"], order=["event_id"], name="n")


LINES = f"""
lines AS (SELECT user_id AS job_id, event_id, t_us, [{", ".join(_filled(m, 1) for m in MESSAGES)}][event_id * 8 % {len(MESSAGES)} + 1] AS text,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ev)
"""

TONES = """CASE WHEN text LIKE 'Source:%' OR text LIKE 'Mux log:%' THEN 'plain'
  WHEN text LIKE '%[error]%' OR text LIKE 'Could not%' OR text LIKE 'Failed to%' OR text LIKE 'cannot%' OR text LIKE 'error: %' THEN 'error'
  WHEN text LIKE '%Warning:%' OR text LIKE '%[warning]%' THEN 'warning' WHEN text LIKE 'Verified output%' THEN 'success'
  WHEN text LIKE '%Encoding: %' OR text LIKE 'frame=%' OR regexp_matches(text, '^[0-9]+[.]0% ') THEN 'progress'
  WHEN text LIKE 'Inspecting %' OR text LIKE 'Encoding video % with%' THEN 'phase' ELSE 'plain' END"""


@query("classify_log_lines", f"WITH {LINES} SELECT job_id, n, {TONES} AS tone FROM lines")
def classify_log_lines(spark, sf):
    return jobs.classify_log_lines(log_lines(spark, sf)).select("job_id", "n", "tone")


@query("drop_probe_noise", f"""WITH {LINES}, l AS (SELECT *, lag(text) OVER (PARTITION BY job_id ORDER BY n) AS prev FROM lines)
SELECT job_id, n, text FROM l WHERE text NOT LIKE 'Could not find codec%' AND NOT (text LIKE 'Consider increasing%' AND coalesce(prev LIKE 'Could not find codec%', false))""")
def drop_probe_noise(spark, sf):
    return jobs.drop_probe_noise(log_lines(spark, sf)).select("job_id", "n", "text")


@query("latest_step", f"""WITH {LINES}
SELECT job_id, max_by(trim(text), n) FILTER (trim(text) <> '' AND NOT regexp_matches(text, '^(\\s|\\[)') AND text NOT LIKE 'Mux log: %' AND text NOT LIKE 'Paused the%') AS step FROM lines GROUP BY job_id""")
def latest_step(spark, sf):
    return jobs.latest_step(log_lines(spark, sf))


@query("log_tail", f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS k FROM lines)
SELECT job_id, n, left(text, 40) AS text FROM r WHERE k <= 30""")
def log_tail(spark, sf):
    return jobs.log_tail(log_lines(spark, sf), width=40).select("job_id", "n", "text")


@query("orphan_logs", """
WITH f AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'note-' ELSE '' END || (user_id)::VARCHAR || '-' || (event_id)::VARCHAR || '-1' || CASE event_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.mux.log.1' ELSE '.txt' END AS name,
  user_id::VARCHAR || '-' || event_id::VARCHAR || '-1' AS job_id, t_us FROM ev)
SELECT job_id, name FROM f WHERE event_id % 5 <> 0 AND event_id % 3 <> 2 AND t_us < 15 * 86400000000 AND event_id % 4 <> 0""")
def orphan_logs(spark, sf):
    i = F.col("event_id")
    job = F.concat_ws("-", "user_id", "event_id", F.lit("1"))
    ext = F.when(i % 3 == 0, ".log").when(i % 3 == 1, ".mux.log.1").otherwise(".txt")
    e = v.events(spark, sf)
    files = e.select(F.concat(F.when(i % 5 == 0, "note-").otherwise(""), job, ext).alias("name"), F.col("t_us").alias("modified_us"))
    known = e.where(i % 4 == 0).select(job.alias("job_id"))
    return jobs.orphan_logs(files, known, L(45 * 86_400_000_000)).select("job_id", "name")


def chunks(spark, sf):
    """Line items as chunks of the order's job; done when their status is F."""
    return v.lineitem(spark, sf).select(
        F.col("l_orderkey").alias("job_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk"), F.col("l_quantity").cast("long").alias("frames"),
        (F.col("l_linestatus") == "F").alias("done"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"))


def job_totals(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 150).alias("total_frames"))


CHUNKS = """
g AS (SELECT l_orderkey AS job_id, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS done_frames, count(*) FILTER (l_linestatus = 'F') AS done_chunks,
  count(*) FILTER (l_linestatus <> 'F') AS remaining_chunks, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS encoded_bytes FROM lineitem GROUP BY 1),
cp AS (SELECT o_orderkey AS job_id, o_orderkey % 150 AS total_frames, coalesce(done_frames, 0) AS done_frames, coalesce(done_chunks, 0) AS done_chunks, coalesce(remaining_chunks, 0) AS remaining_chunks,
  coalesce(encoded_bytes, 0) AS encoded_bytes, coalesce(done_frames, 0) <= o_orderkey % 150 AS ok FROM orders LEFT JOIN g ON job_id = o_orderkey)
"""


@query("chunk_progress", f"WITH {CHUNKS} SELECT * FROM cp")
def chunk_progress(spark, sf):
    return jobs.chunk_progress(chunks(spark, sf), job_totals(spark, sf)).drop("reason")


@query("remaining_chunks", """
WITH c AS (SELECT l_orderkey AS job_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS chunk, bool_or(l_linestatus = 'F') AS done FROM lineitem GROUP BY ALL)
SELECT job_id, chunk FROM c WHERE NOT done""")
def remaining_chunks(spark, sf):
    c = chunks(spark, sf)
    return jobs.remaining_chunks(c.select("job_id", "chunk").distinct(), c.where("done"))


@query("list_recoverable_jobs", f"""WITH {CHUNKS}
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'P' THEN 'stopped' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'standalone' ELSE 'av1an' END AS backend,
  o_orderkey % 1000 AS last_run_us, done_chunks, encoded_bytes FROM orders JOIN cp ON job_id = o_orderkey WHERE ok AND done_chunks > 0 AND o_orderstatus IN ('P', 'F') AND o_orderkey % 3 <> 0""")
def list_recoverable_jobs(spark, sf):
    k = F.col("o_orderkey")
    j = v.table(spark, sf, "orders").select(
        k.alias("job_id"), F.when(F.col("o_orderstatus") == "P", "stopped").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("state"),
        F.when(k % 3 == 0, "standalone").otherwise("av1an").alias("backend"), (k % 1000).alias("last_run_us"))
    return jobs.list_recoverable_jobs(j, jobs.chunk_progress(chunks(spark, sf), job_totals(spark, sf)))


@query("batch_outcome", """
WITH r AS (SELECT o_custkey AS batch_id, CASE WHEN o_orderkey % 41 = 0 THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_custkey % 9 = 0 THEN 'skipped' ELSE 'succeeded' END AS state FROM orders)
SELECT batch_id, count(*) AS rows, count(*) FILTER (state = 'succeeded') AS completed, count(*) FILTER (state IN ('failed', 'canceled')) AS failed, count(*) FILTER (state = 'skipped') AS skipped,
  bool_or(state IN ('canceled', 'skipped')) AS canceled FROM r GROUP BY batch_id""")
def batch_outcome(spark, sf):
    s = F.col("o_orderstatus")
    state = (F.when(F.col("o_orderkey") % 41 == 0, "canceled").when(s == "F", "succeeded").when(s == "O", "failed")
             .when(F.col("o_custkey") % 9 == 0, "skipped").otherwise("succeeded"))
    return jobs.batch_outcome(v.table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), state.alias("state")))


def job_events(spark, sf):
    """Snapshots of one job per user: the state follows the event type, progress its value."""
    t = F.col("event_type")
    state = F.when(t == "purchase", "succeeded").when(t == "error", "failed").when(t == "signup", "queued").otherwise("running")
    return v.events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.col("t_us").alias("event_us"), F.col("event_id").alias("seq"), state.alias("state"),
        F.col("value").alias("progress_s"), F.when(F.col("user_id") % 3 != 0, 20.0).alias("duration_s"), (F.col("user_id") % 2 == 0).alias("estimated"))


STATE = """
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS snapshots FROM ev),
c AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN CASE WHEN user_id % 2 = 0 AND value > 20 THEN value ELSE 20e0 END END AS dur,
  CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS st FROM s WHERE k = 1),
latest AS (SELECT user_id AS job_id, st AS state, CASE WHEN value > dur THEN dur ELSE value END AS progress_s, dur AS duration_s, user_id % 2 = 0 AS estimated, t_us AS last_us, snapshots, st IN ('succeeded', 'failed') AS terminal FROM c)
"""


@query("latest_job_state", f"WITH {STATE} SELECT * FROM latest")
def latest_job_state(spark, sf):
    return jobs.latest_job_state(job_events(spark, sf))
