"""Registered queries: the streaming forms, run over everything available."""

from pyspark.sql import functions as F

from reeltally.operators import thinning
from reeltally.plans.blocks import numbered
from reeltally.queries import stand_ins as v
from reeltally.queries.clocks import WINDOW
from reeltally.queries.jobs import STATE, log_lines
from reeltally.queries.registry import ORACLES, query
from reeltally.streaming import native, stateful
from reeltally.streaming.runner import open_stream, run_available


def _events(spark, sf):
    schema = v.table(spark, sf, "events").schema
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return open_stream(spark, f"{sf}/events.parquet", schema).withColumn("t_us", micros)


@query("stream_windowed_rate")
def stream_windowed_rate(spark, sf):
    i = F.col("event_id")
    pts, dts = F.when(i % 11 != 0, F.col("t_us")), F.when(i % 13 != 0, F.col("t_us") - 40000)
    p = _events(spark, sf).select((F.col("user_id") % 10).alias("file_id"), F.expr("(user_id div 10) % 3").alias("stream_index"),
                                  F.coalesce(pts, dts).alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("size"))
    out = run_available(native.stream_windowed_rate(p, WINDOW, watermark="60 days"))
    return native.fill_windows(out, WINDOW).withColumn("mbps", F.round("mbps", 9))


ORACLES["stream_windowed_rate"] = ORACLES["windowed_rate"]


# Packets arrive by three days each; every 101st comes nine days late, behind the watermark of two days.
ARRIVAL_US, LATE_FILES, DELAY_US = 3 * 86_400_000_000, 3, 2 * 86_400_000_000


def _late_sql(behind: int) -> str:
    """Packets with ``late``: their window ends behind the watermark, which is that of the micro-batches up to ``behind`` before."""
    return f"""
ar AS (SELECT file_id, stream_index, coalesce(pts_us, dts_us) AS t, size,
  coalesce(pts_us, dts_us) // {ARRIVAL_US} + CASE WHEN event_id % 101 = 0 THEN {LATE_FILES} ELSE 0 END AS a FROM packets WHERE coalesce(pts_us, dts_us) >= 0),
every AS (SELECT unnest(range(max(a) + 1)) AS a FROM ar),
seen AS (SELECT a, max(t // 1000 * 1000) AS m FROM every LEFT JOIN ar USING (a) GROUP BY a),
wm AS (SELECT a, max(m) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND {behind} PRECEDING) - {DELAY_US} AS w FROM seen),
k AS (SELECT ar.*, t // {WINDOW} AS k, coalesce((t // {WINDOW} + 1) * {WINDOW} <= w, false) AS late FROM ar JOIN wm USING (a))
"""


def _arrivals(spark, sf):
    """The packets as a stream, a micro-batch for each arrival."""
    t = F.coalesce("pts_us", "dts_us")
    p = v.packets(spark, sf, keep_id=True).where(t >= 0).select("file_id", "stream_index", t.alias("t_us"), "size", "event_id")
    late = F.when(F.col("event_id") % 101 == 0, LATE_FILES).otherwise(0)
    return v.arriving(p.withColumn("arrival", F.expr(f"t_us div {ARRIVAL_US}") + late).drop("event_id"))


@query("stream_windowed_rate_append", f"""WITH {_late_sql(2)}
SELECT file_id, stream_index, k * {WINDOW} AS start_us, CAST(sum(size) AS BIGINT) AS packet_bytes FROM k WHERE NOT late
GROUP BY file_id, stream_index, k HAVING (k + 1) * {WINDOW} <= (SELECT max(m) - {DELAY_US} FROM seen)""")
def stream_windowed_rate_append(spark, sf):
    """Windows as the watermark closes them; each is written once."""
    rate = native.stream_windowed_rate(_arrivals(spark, sf), WINDOW, watermark=f"{DELAY_US} microseconds")
    return run_available(rate, mode="append").drop("batch")


def _rate_and_late(spark, sf):
    return run_available(stateful.stream_rate_and_late(_arrivals(spark, sf), WINDOW, f"{DELAY_US} microseconds"), mode="append")


@query("stream_closed_windows", f"""WITH {_late_sql(1)}
SELECT file_id, stream_index, k * {WINDOW} AS start_us, count(*) AS packets, CAST(sum(size) AS BIGINT) AS packet_bytes FROM k WHERE NOT late
GROUP BY file_id, stream_index, k HAVING (k + 1) * {WINDOW} <= (SELECT max(m) - {DELAY_US} FROM seen)""")
def stream_closed_windows(spark, sf):
    return stateful.closed_windows(_rate_and_late(spark, sf))


@query("stream_late_packets", f"""WITH {_late_sql(1)}
SELECT file_id, stream_index, k * {WINDOW} AS start_us, t AS t_us, CAST(size AS BIGINT) AS packet_bytes FROM k WHERE late""")
def stream_late_packets(spark, sf):
    """The same stream's other rows: packets that come after their window was closed."""
    return _rate_and_late(spark, sf).where("kind = 'late'").select("file_id", "stream_index", "start_us", "t_us", "packet_bytes")


@query("stream_job_state", f"WITH {STATE} SELECT * FROM latest")
def stream_job_state(spark, sf):
    t = F.col("event_type")
    state = F.when(t == "purchase", "succeeded").when(t == "error", "failed").when(t == "signup", "queued").otherwise("running")
    e = _events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.col("t_us").alias("event_us"), F.col("event_id").alias("seq"), state.alias("state"),
        F.col("value").alias("progress_s"), F.when(F.col("user_id") % 3 != 0, 20.0).alias("duration_s"), (F.col("user_id") % 2 == 0).alias("estimated"))
    return native.newest_job_state(run_available(native.stream_job_state(e)))


@query("progress_estimate", """
WITH o AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN user_id % 7 = 0 AND event_id % 500 >= 250 THEN 'b' ELSE 'a' END AS phase,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10000000 AS t, event_id / 100e0 AS p, CASE WHEN user_id % 3 <> 0 THEN 120e0 END AS duration FROM events),
x AS (SELECT *, row_number() OVER w AS r, coalesce(lag(phase) OVER w <> phase OR lag(p) OVER w > p, true) AS broken, coalesce(p > lag(p) OVER w, true) AS up
  FROM o WINDOW w AS (PARTITION BY job_id ORDER BY t, seq)),
a AS (SELECT *, max(CASE WHEN broken OR up THEN t END) OVER (PARTITION BY job_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
g AS (SELECT *, sum(CASE WHEN broken OR (up AND t - before >= 15000) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY r) AS seg FROM a),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id, seg ORDER BY r) = 1 AS head FROM g),
l AS (SELECT *, max(CASE WHEN head OR up THEN t END) OVER (PARTITION BY job_id, seg ORDER BY r) AS t_last,
  lead(t // 1000) OVER (PARTITION BY job_id, seg, head OR up ORDER BY r) AS next_second FROM m),
s AS (SELECT job_id, seg, t, p, head FROM l WHERE head OR (up AND next_second IS DISTINCT FROM t // 1000)),
b AS (SELECT l.job_id, l.r, l.t, l.p, l.t_last, l.duration, coalesce(max(s.t) FILTER (s.t <= l.t - 30000), min(s.t)) AS t0 FROM l JOIN s ON s.job_id = l.job_id AND s.seg = l.seg AND s.t <= l.t
  GROUP BY ALL),
e AS (SELECT b.*, coalesce(l.seg, 0) AS seg FROM b JOIN l ON l.job_id = b.job_id AND l.r = b.r),
v AS (SELECT e.job_id, e.t, e.p, e.t_last, e.duration, e.t0, (SELECT min(s.p) FROM s WHERE s.job_id = e.job_id AND s.seg = e.seg AND s.t = e.t0) AS p0 FROM e),
k AS (SELECT *, CASE WHEN t - t_last >= 15000 THEN 'waiting' WHEN t - t0 >= 5000 AND p > p0 THEN 'estimate' END AS kind FROM v)
SELECT job_id, t AS t_ms, kind, round(CASE WHEN kind = 'estimate' THEN (p - p0) / ((t - t0) / 1000e0) END, 6) AS speed,
  round(CASE WHEN kind = 'estimate' AND duration > p THEN (duration - p) / ((p - p0) / ((t - t0) / 1000e0)) END, 6) AS remaining_s FROM k""")
def progress_estimate(spark, sf):
    """Observations every few seconds: event time runs ten thousand times slower.  They arrive out of order over many files."""
    i = F.col("event_id")
    o = v.events(spark, sf).select(
        F.col("user_id").alias("job_id"), F.when(F.col("user_id") % 7 == 0, F.when(i % 500 < 250, "a").otherwise("b")).otherwise("a").alias("phase"), i.alias("seq"),
        F.expr("t_us div 10000000").alias("t_ms"), (i / 100.0).alias("progress"), F.when(F.col("user_id") % 3 != 0, 120.0).alias("duration"))
    out = run_available(stateful.progress_estimate(_shuffled(o, "seq"), delay=DELAY), mode="append").drop("batch")
    return out.withColumns({"speed": F.round("speed", 6), "remaining_s": F.round("remaining_s", 6)})


# Rows arrive by sixteen seconds, some up to sixteen seconds late.
SPAN_MS, SPREAD_MS, DELAY = 16_000, 4_000, "20 seconds"


def _shuffled(rows, order: str):
    """Rows out of order over micro-batches; a last one without a job moves the watermark behind all of them."""
    d = rows.withColumn("arrival", F.expr(f"(t_ms + `{order}` % 5 * {SPREAD_MS}) div {SPAN_MS}"))
    end = d.agg((F.max("t_ms") + 3_600_000).alias("t_ms"), (F.max("arrival") + 1).alias("arrival"))
    return v.arriving(d.unionByName(end, allowMissingColumns=True))


def _redraws(lines):
    """Log lines with a redraw flag; event time runs ten thousand times slower."""
    return lines.select("job_id", "n", F.expr("t_us div 10000000").alias("t_ms"), (F.col("event_id") % 8 != 0).alias("redraw"), F.concat(F.lit("frame "), (F.col("event_id") % 3).cast("string")).alias("text"))


@query("thin_log", """
WITH RECURSIVE ev2 AS (SELECT user_id AS job_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10000000 AS t_ms, event_id % 8 <> 0 AS redraw, 'frame ' || (event_id % 3)::VARCHAR AS text,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
rd AS (SELECT r.job_id, r.n, min(x.n) AS follow FROM ev2 r LEFT JOIN ev2 x ON x.job_id = r.job_id AND x.redraw AND x.t_ms >= r.t_ms + 10000 WHERE r.redraw GROUP BY r.job_id, r.n),
due AS (SELECT job_id, min(n) AS n FROM rd GROUP BY job_id UNION ALL SELECT rd.job_id, rd.follow FROM due JOIN rd ON rd.job_id = due.job_id AND rd.n = due.n WHERE rd.follow IS NOT NULL),
m AS (SELECT e.*, NOT redraw OR d.n IS NOT NULL AS direct FROM ev2 e LEFT JOIN due d ON d.job_id = e.job_id AND d.n = e.n),
l AS (SELECT *, lead(direct) OVER w AS nd, lead(text) OVER w AS nt FROM m WINDOW w AS (PARTITION BY job_id ORDER BY n))
SELECT job_id, n, t_ms, text FROM l WHERE direct OR nd IS NULL OR (nd AND text <> nt)""")
def thin_log(spark, sf):
    return thinning.thin_log(_redraws(log_lines(spark, sf)), block_ms=120_000)


@query("thin_progress_log")
def thin_progress_log(spark, sf):
    """The stream, its lines out of order; a log's last line is known from the stored events."""
    ends = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("event_id").alias("end"))
    lines = _redraws(v.events(spark, sf).withColumn("job_id", F.col("user_id")).withColumn("n", F.col("event_id")))
    lines = lines.join(ends, "job_id").select("*", (F.col("n") == F.col("end")).alias("last")).drop("end")
    out = run_available(stateful.thin_progress_log(_shuffled(lines, "n"), delay=DELAY), mode="append").drop("batch")
    # Positions in the table become positions in the job's log, as the batch form has them.
    place = v.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("n"))
    place = numbered(place, keys=["job_id"], order=["n"], name="at")
    return out.join(place, ["job_id", "n"]).select("job_id", F.col("at").alias("n"), "t_ms", "text")


ORACLES["thin_progress_log"] = ORACLES["thin_log"]


@query("stream_clock_check", """
WITH l AS (SELECT o_orderkey // 1000 AS file_id, o_orderkey % 1000 AS ordinal, o_orderkey % 1000 * 41708 + CASE WHEN o_orderkey % 1511 = 7 THEN 5000 WHEN o_orderkey % 1999 = 3 THEN -90000 ELSE 0 END AS t_us FROM orders),
p AS (SELECT *, lag(t_us) OVER (PARTITION BY file_id ORDER BY ordinal) AS prev FROM l),
b AS (SELECT *, CASE WHEN t_us <= prev THEN 'timestamps not strictly increasing' WHEN abs(t_us - ordinal * 41708) > 2000 THEN 'not a constant frame clock' END AS why FROM p)
SELECT file_id, CAST(0 AS BIGINT) AS stream_index, count(*) AS frames, min(ordinal) FILTER (why IS NOT NULL) AS first_bad, arg_min(why, ordinal) FILTER (why IS NOT NULL) AS reason, count(why) = 0 AS ok FROM b GROUP BY file_id""")
def stream_clock_check(spark, sf):
    schema = v.table(spark, sf, "orders").schema
    k = F.col("o_orderkey")
    shift = F.when(k % 1511 == 7, 5000).when(k % 1999 == 3, -90000).otherwise(0)
    f = open_stream(spark, f"{sf}/orders.parquet", schema).select(
        F.expr("o_orderkey div 1000").alias("file_id"), F.lit(0).cast("long").alias("stream_index"), (k % 1000).alias("ordinal"), (k % 1000 * 41708 + shift).alias("t_us"))
    out = run_available(stateful.stream_clock_check(f, frame_us=41708.0, origin_us=0.0, tolerance_us=2000.0, part_rows=256))
    return stateful.clock_verdict(out)
