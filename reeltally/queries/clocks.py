"""Registered queries: rates and clocks."""

from pyspark.sql import functions as F

from reeltally.operators import clocks, rates
from reeltally.queries import stand_ins as v
from reeltally.queries.registry import query

WINDOW = 300 * 1_000_000


@query("windowed_rate", f"""
WITH b AS (
  SELECT file_id, stream_index, CAST(floor(coalesce(pts_us, dts_us) / {WINDOW}) AS BIGINT) AS k, CAST(sum(size) AS BIGINT) AS bytes
  FROM packets WHERE coalesce(pts_us, dts_us) IS NOT NULL GROUP BY ALL),
span AS (SELECT file_id, stream_index, min(k) AS lo, max(k) AS hi FROM b GROUP BY ALL),
spine AS (SELECT file_id, stream_index, unnest(generate_series(lo, hi)) AS k FROM span)
SELECT s.file_id, s.stream_index, s.k * {WINDOW} AS start_us, coalesce(b.bytes, 0) AS packet_bytes,
  round(coalesce(b.bytes, 0) * 8e0 / {WINDOW}e0, 9) AS mbps
FROM spine s LEFT JOIN b USING (file_id, stream_index, k)
""")
def windowed_rate(spark, sf):
    return rates.windowed_rate(v.packets(spark, sf), WINDOW).withColumn("mbps", F.round("mbps", 9))


@query("packet_totals", """
WITH p AS (SELECT *, coalesce(pts_us, dts_us) AS t FROM packets),
a AS (SELECT file_id, stream_index, CAST(sum(size) AS BIGINT) AS packet_bytes, count(*) AS packet_count,
  CAST(coalesce(sum(size) FILTER (t IS NULL), 0) AS BIGINT) AS untimed_bytes, count(*) FILTER (t IS NULL) AS untimed_count,
  count(*) FILTER (pts_us IS NULL AND dts_us IS NOT NULL) AS dts_fallback_count, min(t) AS start_us, max(t) AS last_t,
  max(t + coalesce(duration_us, 0)) AS stop FROM p GROUP BY ALL),
tail AS (SELECT file_id, stream_index, bool_or(duration_us > 0) AS known FROM p JOIN a USING (file_id, stream_index)
  WHERE t = last_t GROUP BY ALL)
SELECT file_id, stream_index, packet_bytes, packet_count, untimed_bytes, untimed_count, dts_fallback_count, start_us,
  CASE WHEN known THEN stop END AS end_us,
  round(CASE WHEN known AND stop > start_us THEN (packet_bytes - untimed_bytes) * 8e0 / (stop - start_us) END, 9) AS average_mbps
FROM a LEFT JOIN tail USING (file_id, stream_index)
""")
def packet_totals(spark, sf):
    return rates.packet_totals(v.packets(spark, sf)).withColumn("average_mbps", F.round("average_mbps", 9))


@query("bitrate_report", f"""
WITH p AS (SELECT *, coalesce(pts_us, dts_us) AS t FROM packets),
b AS (SELECT file_id, stream_index, floor(t / {WINDOW}) AS k, sum(size) AS bytes FROM p WHERE t IS NOT NULL GROUP BY ALL),
s AS (SELECT file_id, stream_index, CAST(max(k) - min(k) + 1 AS BIGINT) AS windows, max(bytes) * 8e0 / {WINDOW}e0 AS peak FROM b GROUP BY ALL)
SELECT file_id, stream_index, CAST(sum(size) AS BIGINT) AS packet_bytes, any_value(windows) AS windows, round(any_value(peak), 9) AS peak_mbps,
  true AS ok
FROM p JOIN s USING (file_id, stream_index) GROUP BY file_id, stream_index
""")
def bitrate_report(spark, sf):
    summary, _ = rates.bitrate_report(v.packets(spark, sf), WINDOW)
    return summary.select("file_id", "stream_index", "packet_bytes", "windows", F.round("peak_mbps", 9).alias("peak_mbps"), "ok")


@query("clip_rows", """
SELECT file_id, stream_index, ordinal, t_us FROM (
  SELECT file_id, stream_index, ordinal, coalesce(pts_us, dts_us) AS t_us FROM packets)
WHERE stream_index IN (0, 1) AND t_us >= 86400000000 - 1 AND t_us < 20 * 86400000000 - 1
""")
def clip_rows(spark, sf):
    kind = F.when(F.col("stream_index") == 0, "video").when(F.col("stream_index") == 1, "audio").otherwise("subtitle")
    p = v.packets(spark, sf).select("file_id", "stream_index", "ordinal", F.coalesce("pts_us", "dts_us").alias("t_us"), kind.alias("kind"))
    return clocks.clip_rows(p, 86_400_000_000, 20 * 86_400_000_000).drop("kind")


TIMELINE = """
lagged AS (SELECT file_id, stream_index, pts_us AS t, CASE WHEN duration_us > 0 THEN duration_us END AS d,
  max(pts_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM packets),
tl AS (SELECT file_id, stream_index, count(t) AS frames, min(t) AS first_us, max(t) AS last_us,
  greatest(coalesce(max(t - high) FILTER (t > high), 0), coalesce(max(d), 0)) AS max_quantum_us,
  max(t + coalesce(d, 0)) AS stop, count(*) FILTER (t IS NULL) AS untimed FROM lagged GROUP BY ALL),
timeline AS (SELECT file_id, stream_index, frames, first_us, last_us, max_quantum_us, untimed,
  greatest(stop, last_us + max_quantum_us) AS end_us,
  greatest(greatest(stop, last_us + max_quantum_us) - first_us, 0) AS span_us, untimed = 0 AS ok FROM tl)
"""


def timelines(spark, sf):
    p = v.packets(spark, sf).withColumnRenamed("pts_us", "t_us")
    return clocks.timeline_summary(p)


@query("timeline_summary", f"WITH {TIMELINE} SELECT * FROM timeline")
def timeline_summary(spark, sf):
    return timelines(spark, sf).drop("reason")


@query("timeline_totals", f"""WITH {TIMELINE}
SELECT file_id, count(*) AS streams, min(first_us) AS origin_us, max(end_us) AS end_us,
  greatest(max(end_us) - min(first_us), 0) AS span_us, max(max_quantum_us) AS max_quantum_us FROM timeline GROUP BY file_id""")
def timeline_totals(spark, sf):
    return clocks.timeline_totals(timelines(spark, sf))


@query("packet_timeline", """
SELECT file_id, stream_index, count(*) AS packets, min(pts_us) AS start_us, max(pts_us + coalesce(duration_us, 0)) AS end_us,
  count(*) FILTER (pts_us IS NULL) AS untimed, count(*) FILTER (duration_us < 0) AS negative_durations,
  CASE WHEN count(*) FILTER (pts_us IS NULL) > 0 THEN 'packet without timestamp' END AS reason,
  count(*) FILTER (pts_us IS NULL) = 0 AS ok
FROM packets GROUP BY file_id, stream_index
""")
def packet_timeline(spark, sf):
    return clocks.packet_timeline(v.packets(spark, sf))


@query("monotone_check", """
WITH l AS (SELECT *, lag(pts_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) AS prev FROM packets)
SELECT file_id, stream_index, count(*) AS frames, count(*) FILTER (pts_us IS NULL OR pts_us <= prev) AS violations,
  min(ordinal) FILTER (pts_us IS NULL OR pts_us <= prev) AS first_bad, count(*) FILTER (pts_us IS NULL OR pts_us <= prev) = 0 AS ok
FROM l GROUP BY ALL
""")
def monotone_check(spark, sf):
    return clocks.monotone_check(v.packets(spark, sf), t="pts_us").drop("reason")


def _frame_rates(spark, sf):
    """One row per stream: declared film rate on even files, PAL on odd ones."""
    f = v.frames(spark, sf).groupBy("file_id", "stream_index").agg(F.count(F.lit(1)).alias("expected_frames"))
    even = F.col("file_id") % 2 == 0
    return f.select(
        "file_id", "stream_index", "expected_frames",
        F.when(even, 24000).otherwise(25).cast("long").alias("rate_num"),
        F.when(even, 1001).otherwise(1).cast("long").alias("rate_den"),
        (1000 + 10 * F.col("file_id")).cast("long").alias("tolerance_us"),
    )


RATES = """rates AS (SELECT file_id, stream_index, count(*) AS expected_frames,
  CASE WHEN file_id % 2 = 0 THEN 24000 ELSE 25 END::BIGINT AS rate_num, CASE WHEN file_id % 2 = 0 THEN 1001 ELSE 1 END::BIGINT AS rate_den,
  1000 + 10 * file_id AS tolerance_us FROM frames GROUP BY ALL)"""


@query("constant_clock_check", f"""WITH {RATES},
d AS (SELECT f.file_id, f.stream_index, rate_num, rate_den, tolerance_us, count(*) AS frames,
  min(t_us) FILTER (ordinal = 0) AS origin_us,
  min(t_us - ordinal * (rate_den * 1e6 / rate_num)) AS dl, max(t_us - ordinal * (rate_den * 1e6 / rate_num)) AS dh,
  min(t_us - ordinal * (125e0 * 1e6 / 2997e0)) AS al, max(t_us - ordinal * (125e0 * 1e6 / 2997e0)) AS ah
  FROM frames f JOIN rates USING (file_id, stream_index) GROUP BY ALL),
r AS (SELECT *, greatest(dh - origin_us, origin_us - dl) AS off, greatest(ah - origin_us, origin_us - al) AS off2 FROM d)
SELECT file_id, stream_index, rate_num, rate_den, tolerance_us, frames, origin_us, round(off, 3) AS max_residual_us,
  off > tolerance_us AND rate_num = 24000 AND off2 <= tolerance_us AS reconciled,
  off <= tolerance_us OR (rate_num = 24000 AND off2 <= tolerance_us) AS ok FROM r
""")
def constant_clock_check(spark, sf):
    r = clocks.constant_clock_check(v.frames(spark, sf), _frame_rates(spark, sf))
    return r.select("file_id", "stream_index", "rate_num", "rate_den", "tolerance_us", "frames", "origin_us",
                    F.round("max_residual_us", 3).alias("max_residual_us"), "reconciled", "ok")


@query("reorder_check", """
WITH c AS (SELECT file_id, stream_index, count(*) AS packets, count(*) FILTER (pts_us IS NULL) AS untimed FROM packets GROUP BY ALL),
s AS (SELECT file_id, stream_index, ordinal, t, row_number() OVER (PARTITION BY file_id, stream_index ORDER BY t, ordinal) - 1 AS presented FROM
 (SELECT *, (pts_us // 60000000) * 60000000 - (ordinal % 3) * 60000000 AS t FROM packets WHERE pts_us IS NOT NULL)),
m AS (SELECT file_id, stream_index, max(ordinal - presented) AS max_depth, count(*) - count(DISTINCT t) AS duplicates FROM s GROUP BY ALL)
SELECT file_id, stream_index, packets, untimed, max_depth, CAST(duplicates AS BIGINT) AS duplicates,
  CASE WHEN untimed > 0 THEN 'packet without timestamp' WHEN duplicates > 0 OR max_depth > 64 THEN 'times repeat or reorder too far' END AS reason
FROM c JOIN m USING (file_id, stream_index)
""")
def reorder_check(spark, sf):
    t = F.expr("(pts_us div 60000000) * 60000000 - (ordinal % 3) * 60000000")
    p = v.packets(spark, sf).select("file_id", "stream_index", "ordinal", t.alias("pts_us"))
    r = p.groupBy("file_id", "stream_index").agg(F.count(F.lit(1)).alias("expected_frames")).select(
        "file_id", "stream_index", "expected_frames", F.lit(25).cast("long").alias("rate_num"), F.lit(1).cast("long").alias("rate_den"),
        F.lit(10**15).cast("long").alias("tolerance_us"))
    out = clocks.reorder_check(p, r, block_us=86_400_000_000)
    return out.select("file_id", "stream_index", "packets", "untimed", "max_depth", "duplicates", "reason")


@query("ordered_clock_check", f"""WITH {RATES},
l AS (SELECT *, CASE WHEN ordinal % 24 = 0 THEN 'K__' WHEN o_orderkey % 307 = 0 THEN '_D_' ELSE '___' END AS flags,
  lag(t_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) AS prev, row_number() OVER () AS rn FROM frames JOIN rates USING (file_id, stream_index)),
g AS (SELECT *, coalesce(t_us = t_us AND duration_us > 0 AND NOT (flags LIKE '%D%') AND
  CASE WHEN ordinal = 0 THEN t_us = 0 AND flags LIKE '%K%' ELSE t_us > prev END AND
  abs(t_us - ordinal * (rate_den * 1e6 / rate_num)) <= tolerance_us AND
  (ordinal + 1 <> expected_frames OR abs(t_us + duration_us - expected_frames * (rate_den * 1e6 / rate_num)) <= tolerance_us), false) AS good FROM l)
SELECT file_id, stream_index, any_value(expected_frames) AS expected_frames, count(*) AS packets, count(*) FILTER (NOT good) AS violations,
  min(ordinal) FILTER (NOT good) AS first_bad, count(*) FILTER (NOT good) = 0 AS ok FROM g GROUP BY file_id, stream_index
""")
def ordered_clock_check(spark, sf):
    flags = F.when(F.col("ordinal") % 24 == 0, "K__").when(F.col("o_orderkey") % 307 == 0, "_D_").otherwise("___")
    f = v.frames(spark, sf).withColumn("flags", flags).withColumn("dts_us", F.col("t_us"))
    return clocks.ordered_clock_check(f, _frame_rates(spark, sf), pts="t_us").drop("reason")


@query("repair_timestamps", """
SELECT file_id, stream_index, ordinal, coalesce(max(CASE WHEN pts_us >= 0 THEN pts_us END) OVER (PARTITION BY file_id, stream_index
  ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 0) AS repaired_us FROM packets
""")
def repair_timestamps(spark, sf):
    p = v.packets(spark, sf).select("file_id", "stream_index", "ordinal", "pts_us")
    return clocks.repair_timestamps(p, t="pts_us").drop("pts_us")


@query("tiling_check", """
WITH i AS (SELECT file_id, ordinal AS n, ordinal * 24 AS s, ordinal * 24 + CASE WHEN o_orderkey % 2003 = 0 THEN 23 ELSE 24 END AS e FROM frames),
l AS (SELECT *, lag(e) OVER (PARTITION BY file_id ORDER BY n) AS prev FROM i)
SELECT file_id, count(*) AS intervals, count(*) * 24 AS total, min(n) FILTER (s <> coalesce(prev, 0) OR e <= s) AS first_bad, max(e) AS last_end,
  count(*) FILTER (s <> coalesce(prev, 0) OR e <= s) = 0 AND max(e) = count(*) * 24 AS ok FROM l GROUP BY file_id
""")
def tiling_check(spark, sf):
    f = v.frames(spark, sf)
    end = F.col("ordinal") * 24 + F.when(F.col("o_orderkey") % 2003 == 0, 23).otherwise(24)
    i = f.select("file_id", F.col("ordinal").alias("n"), (F.col("ordinal") * 24).alias("start_frame"), end.alias("end_frame"))
    totals = f.groupBy("file_id").agg((F.count(F.lit(1)) * 24).alias("frames"))
    return clocks.tiling_check(i, totals).drop("reason")


@query("resolve_frame_interval", """
WITH s AS (SELECT file_id, stream_index, count(*) AS frames, 24000 AS num, 1001 AS den FROM frames GROUP BY ALL),
e AS (SELECT o_custkey % 20 AS file_id, o_orderkey AS edit_id,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7919 END AS sm, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7919 + o_orderkey % 4001 END AS em,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 97 END AS sf, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 97 + o_orderkey % 1009 END AS ef FROM orders),
r AS (SELECT *, CASE WHEN sm IS NOT NULL THEN (sm * num + den * 1000 - 1) // (den * 1000) ELSE sf END AS from_frame,
  CASE WHEN sm IS NOT NULL THEN (em * num + den * 1000 - 1) // (den * 1000) ELSE ef END AS to_frame,
  sm IS NULL OR em * num <= frames * den * 1000 AS inside FROM e JOIN s USING (file_id)),
q AS (SELECT *, CASE WHEN sm IS NOT NULL AND em <= sm THEN 'empty interval' WHEN to_frame <= from_frame THEN 'empty interval'
  WHEN to_frame > frames OR NOT inside THEN 'past the end' END AS reason FROM r)
SELECT file_id, edit_id, from_frame, to_frame, reason, CASE WHEN reason IS NULL THEN to_frame - from_frame END AS frame_count FROM q
""")
def resolve_frame_interval(spark, sf):
    s = v.frames(spark, sf).groupBy("file_id", "stream_index").agg(F.count(F.lit(1)).alias("frames")).withColumns(
        {"rate_num": F.lit(24000).cast("long"), "rate_den": F.lit(1001).cast("long")})
    k = F.col("o_orderkey")
    by_ms = k % 2 == 0
    e = v.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("file_id"), F.lit(0).cast("long").alias("stream_index"), k.alias("edit_id"),
        F.when(by_ms, k % 7919).alias("start_ms"), F.when(by_ms, k % 7919 + k % 4001).alias("end_ms"),
        F.when(~by_ms, k % 97).alias("start_frame"), F.when(~by_ms, k % 97 + k % 1009).alias("end_frame"))
    return clocks.resolve_frame_interval(e, s).select("file_id", "edit_id", "from_frame", "to_frame", "reason", "frame_count")


AUDIO = """a AS (SELECT file_id, stream_index, ordinal, 1024 + CASE WHEN o_orderkey % 5 = 0 THEN 128 ELSE 0 END AS samples,
   48000 AS rate, t_us AS raw, sum(1024 + CASE WHEN o_orderkey % 5 = 0 THEN 128 ELSE 0 END) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) -
   (1024 + CASE WHEN o_orderkey % 5 = 0 THEN 128 ELSE 0 END) AS before, o_orderkey FROM frames)"""


def _audio(spark, sf):
    """Audio frames of 1024 or 1152 samples whose nominal clock assumes 1024."""
    samples = 1024 + F.when(F.col("o_orderkey") % 5 == 0, 128).otherwise(0)
    return v.frames(spark, sf).select(
        "file_id", "stream_index", "ordinal", samples.cast("long").alias("samples"), F.lit(48000).cast("long").alias("rate"),
        (5000 + F.expr("(ordinal * 1024 * 1000000) div 48000")).alias("t_us"))


def _audio_rates(frames):
    return frames.groupBy("file_id", "stream_index").agg(F.max("rate").alias("sample_rate")).withColumn(
        "tolerance_us", (400000 + 1000 * F.col("file_id")).cast("long"))


AUDIO_SUMMARY = f"""{AUDIO},
t AS (SELECT *, 5000 + (ordinal * 1024 * 1000000) // 48000 AS t_us FROM a),
env AS (SELECT file_id, stream_index, count(*) AS frames, min(t_us) FILTER (ordinal = 0) AS start_us, CAST(sum(samples) AS BIGINT) AS samples,
  min(t_us - before * 1e6 / 48000) AS lo, max(t_us - before * 1e6 / 48000) AS hi FROM t GROUP BY ALL)"""


@query("audio_continuity", f"""WITH {AUDIO_SUMMARY}
SELECT file_id, stream_index, frames, start_us, samples, round(least(lo - start_us, 0), 3) AS min_residual_us,
  round(greatest(hi - start_us, 0), 3) AS max_residual_us,
  greatest(-least(lo - start_us, 0), greatest(hi - start_us, 0)) <= 400000 + 1000 * file_id AS ok FROM env
""")
def audio_continuity(spark, sf):
    a = _audio(spark, sf)
    r = clocks.audio_continuity(a, _audio_rates(a))
    return r.select("file_id", "stream_index", "frames", "start_us", "samples", F.round("min_residual_us", 3).alias("min_residual_us"),
                    F.round("max_residual_us", 3).alias("max_residual_us"), "ok")


@query("clip_audio", f"""WITH {AUDIO_SUMMARY},
c AS (SELECT *, least(greatest(CAST(ceil((1000000 - start_us) * 48000 / 1e6 - 1e-7) AS BIGINT), 0), samples) AS first_sample,
  least(greatest(CAST(ceil((9000000 - start_us) * 48000 / 1e6 - 1e-7) AS BIGINT), 0), samples) AS end_sample FROM env)
SELECT file_id, stream_index, first_sample, end_sample, round(greatest(start_us + first_sample * 1e6 / 48000 - 1000000, 0), 3) AS clip_start_us,
  first_sample < end_sample AS ok FROM c
""")
def clip_audio(spark, sf):
    a = _audio(spark, sf)
    r = clocks.clip_audio(clocks.audio_continuity(a, _audio_rates(a)), F.lit(1_000_000), F.lit(9_000_000))
    return r.select("file_id", "stream_index", "first_sample", "end_sample", F.round("clip_start_us", 3).alias("clip_start_us"), "ok")


@query("audio_output_check", f"""WITH {AUDIO_SUMMARY}
SELECT file_id, stream_index, (samples + file_id * 100) - samples * 48000e0 / 48000 AS padding,
  file_id * 100 <= CASE WHEN file_id % 2 = 0 THEN 1025 ELSE 4 END AS ok FROM env
""")
def audio_output_check(spark, sf):
    a = _audio(spark, sf)
    s = clocks.audio_continuity(a, _audio_rates(a))
    codec = F.when(F.col("file_id") % 2 == 0, "aac").otherwise("opus")
    o = s.withColumn("samples", F.col("samples") + F.col("file_id") * 100).withColumn("codec", codec)
    return clocks.audio_output_check(s, o).select("file_id", "stream_index", "padding", "ok")


CUT = """
cut AS (SELECT file_id, stream_index, frames + CASE WHEN stream_index = 1 THEN file_id % 4 ELSE 0 END AS frames, first_us + 1000 * file_id AS first_us,
   span_us + CASE WHEN stream_index = 2 THEN file_id * 600000000 ELSE 0 END AS span_us, max_quantum_us FROM timeline),
ef AS (SELECT file_id, min(first_us) AS o, max(max_quantum_us) AS q FROM timeline GROUP BY file_id),
af AS (SELECT file_id, min(first_us) AS o, max(max_quantum_us) AS q FROM cut GROUP BY file_id),
j AS (SELECT e.file_id, e.stream_index, a.frames - e.frames AS frame_change, abs(e.span_us - a.span_us) AS span_change_us,
  abs((e.first_us - ef.o) - (a.first_us - af.o)) AS offset_change_us, greatest(ef.q, af.q) AS q
  FROM timeline e JOIN cut a USING (file_id, stream_index) JOIN ef USING (file_id) JOIN af USING (file_id))
"""


@query("timeline_check", f"""WITH {TIMELINE}, {CUT},
m AS (SELECT *, 'cut' AS mode, 20000 + q * 3 AS tolerance_us, 2 AS slack FROM j UNION ALL
  SELECT *, 'rewrite' AS mode, 20000 + q * 2 AS tolerance_us, 0 AS slack FROM j)
SELECT file_id, stream_index, mode, frame_change, span_change_us, offset_change_us, tolerance_us,
  CASE WHEN abs(frame_change) > slack THEN 'frame count changed' WHEN span_change_us > tolerance_us THEN 'span changed'
  WHEN offset_change_us > tolerance_us THEN 'start offset changed' END AS reason FROM m
""")
def timeline_check(spark, sf):
    e = timelines(spark, sf)
    a = e.withColumn("frames", F.col("frames") + F.when(F.col("stream_index") == 1, F.col("file_id") % 4).otherwise(0))
    a = a.withColumn("first_us", F.col("first_us") + 1000 * F.col("file_id"))
    a = a.withColumn("span_us", F.col("span_us") + F.when(F.col("stream_index") == 2, F.col("file_id") * 600_000_000).otherwise(0))
    cols = ["file_id", "stream_index", "mode", "frame_change", "span_change_us", "offset_change_us", "tolerance_us", "reason"]
    both = [clocks.timeline_check(e, a, mode=m).withColumn("mode", F.lit(m)).select(*cols) for m in ("cut", "rewrite")]
    return both[0].unionByName(both[1])


@query("concat_check", f"""WITH {TIMELINE},
i AS (SELECT file_id // 5 AS job_id, file_id % 5 AS position, * FROM timeline),
o AS (SELECT job_id, stream_index, CAST(sum(frames) AS BIGINT) + CASE WHEN stream_index = 2 THEN job_id ELSE 0 END AS frames,
  min(first_us) AS first_us, max(max_quantum_us) AS q FROM i GROUP BY job_id, stream_index),
jo AS (SELECT job_id, min(first_us) AS oa, max(q) AS qa FROM o GROUP BY job_id),
ji AS (SELECT job_id, count(DISTINCT position) AS inputs, max(max_quantum_us) AS qi, min(first_us) FILTER (position = 0) AS o0 FROM i GROUP BY job_id),
f AS (SELECT job_id, stream_index, CAST(sum(frames) AS BIGINT) AS expected_frames, min(first_us) FILTER (position = 0) AS f0 FROM i GROUP BY job_id, stream_index)
SELECT job_id, f.stream_index, inputs, expected_frames, o.frames AS actual_frames, 20000 + greatest(qi, qa) * (inputs + 2) AS tolerance_us,
  abs((f0 - o0) - (o.first_us - oa)) AS offset_change_us,
  o.frames = expected_frames AND abs((f0 - o0) - (o.first_us - oa)) <= 20000 + greatest(qi, qa) * (inputs + 2) AS ok
FROM f JOIN ji USING (job_id) JOIN jo USING (job_id) JOIN o USING (job_id, stream_index)
""")
def concat_check(spark, sf):
    i = timelines(spark, sf).withColumn("job_id", F.expr("file_id div 5")).withColumn("position", F.col("file_id") % 5)
    o = i.groupBy("job_id", "stream_index").agg(
        (F.sum("frames") + F.when(F.col("stream_index") == 2, F.col("job_id")).otherwise(0)).alias("frames"),
        F.min("first_us").alias("first_us"), F.max("max_quantum_us").alias("max_quantum_us"))
    return clocks.concat_check(i, o).drop("reason")
