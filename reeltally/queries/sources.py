"""Registered queries: ingestion jobs over record text that Spark derives from the driver tables."""

from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.queries import stand_ins as v
from reeltally.queries.cues import CUES, cue_rows
from reeltally.queries.registry import query
from reeltally.sources import documents as docs
from reeltally.sources import readers
from reeltally.sources import records as rec

S = lambda c: F.col(c).cast("string")


def _packet_lines(spark, sf, *, hashed: bool):
    """One record per event; a few are damaged."""
    e = v.events(spark, sf)
    i = F.col("event_id")
    sec = lambda us: F.format_string("%d.%06d", F.call_function("div", us, F.lit(1_000_000)), us % 1_000_000)
    pts = F.when(i % 11 == 0, "N/A").otherwise(sec(F.col("t_us")))
    dts = F.when(i % 13 == 0, "N/A").otherwise(sec(F.col("t_us") + 40_000))
    dur = F.when(i % 17 == 0, "N/A").when(i % 1009 == 5, "-1.0").otherwise(F.concat((1 + i % 3).cast("string"), F.lit(".000000")))
    size = F.when(i % 1013 == 7, "x").otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
    parts = [F.concat(F.lit("stream_index="), F.expr("(user_id div 10) % 3").cast("string")), F.concat(F.lit("pts_time="), pts), F.concat(F.lit("dts_time="), dts),
             F.concat(F.lit("duration_time="), dur), F.concat(F.lit("size="), size)]
    if hashed:
        parts.append(F.concat(F.lit("data_hash="), F.when(i % 1019 == 3, "SHA256:zz").otherwise(F.concat(F.lit("SHA256:"), F.sha2(S("event_id"), 256)))))
    else:
        parts.append(F.when(i % 1021 == 9, "flags=K").when(i % 1031 == 2, "size=1"))
    return e.select((F.col("user_id") % 10).alias("file_id"), S("user_id").alias("path"), i.alias("n"), F.concat_ws("|", *parts).alias("value"))


PACKET_BASE = """SELECT user_id % 10 AS file_id, (user_id // 10) % 3 AS stream_index, event_id AS i, CASE WHEN event_id % 11 <> 0 THEN t_us END AS pts_us,
 CASE WHEN event_id % 13 <> 0 THEN t_us + 40000 END AS dts_us, CASE WHEN event_id % 17 <> 0 THEN 1000000 * (1 + event_id % 3) END AS duration_us, CAST(round(value * 100) AS BIGINT) AS size FROM ev"""


@query("read_packet_records", f"""WITH b AS ({PACKET_BASE})
SELECT file_id, stream_index, row_number() OVER (PARTITION BY file_id, stream_index ORDER BY i) - 1 AS ordinal, pts_us, dts_us, duration_us, size FROM b
WHERE i % 1021 <> 9 AND i % 1031 <> 2 AND NOT (i % 1009 = 5 AND i % 17 <> 0) AND i % 1013 <> 7""")
def read_packet_records(spark, sf):
    return rec.parse_packet_records(_packet_lines(spark, sf, hashed=False))[0]


@query("packet_quarantine", """SELECT user_id % 10 AS file_id, event_id AS n, CASE WHEN event_id % 1021 = 9 THEN 'unexpected field' WHEN event_id % 1031 = 2 THEN 'repeated field'
  WHEN event_id % 1009 = 5 AND event_id % 17 <> 0 THEN 'negative duration' ELSE 'no usable size' END AS reason FROM events
WHERE event_id % 1021 = 9 OR event_id % 1031 = 2 OR (event_id % 1009 = 5 AND event_id % 17 <> 0) OR event_id % 1013 = 7""")
def packet_quarantine(spark, sf):
    return rec.parse_packet_records(_packet_lines(spark, sf, hashed=False))[1].select("file_id", "n", "reason")


@query("read_packet_hashes", f"""WITH b AS ({PACKET_BASE})
SELECT file_id, stream_index, row_number() OVER (PARTITION BY file_id, stream_index ORDER BY i) - 1 AS ordinal, pts_us, dts_us,
  CASE WHEN i % 1009 = 5 AND i % 17 <> 0 THEN -1000000 ELSE duration_us END AS duration_us, size, sha256(i::VARCHAR) AS hash FROM b WHERE i % 1013 <> 7 AND i % 1019 <> 3""")
def read_packet_hashes(spark, sf):
    return rec.parse_packet_hashes(_packet_lines(spark, sf, hashed=True))[0].drop("flags")


def _frame_fields(k):
    fmt = F.when(k % 3 == 0, "yuv420p").when(k % 3 == 1, "yuv422p10le").otherwise("yuv444p")
    return {
        "best_effort_timestamp_time": F.when(k % 509 == 1, "N/A").otherwise(F.format_string("%d.%06d", F.call_function("div", F.col("t_us"), F.lit(1_000_000)), F.col("t_us") % 1_000_000)),
        "interlaced_frame": F.when(k % 503 == 2, "1").otherwise("0"), "sample_aspect_ratio": F.when(k % 2 == 0, "N/A").otherwise("4:3"),
        "width": F.lit("1920"), "height": F.when(k % 499 == 3, "0").otherwise("1080"), "pix_fmt": F.when(k % 491 == 4, "rgb24").otherwise(fmt), "color_range": F.lit("tv"),
        "color_space": F.lit("bt709"), "color_transfer": F.when(k % 487 == 5, "smpte2084").otherwise("bt709"), "color_primaries": F.lit("bt709"),
        "chroma_location": F.when(k % 3 == 1, "unspecified").when(k % 479 == 6, "unknown").otherwise("left"),
    }


FRAME_SQL = """
k AS (SELECT *, o_orderkey AS k FROM frames),
fr AS (SELECT *, CASE WHEN k % 509 = 1 THEN 'invalid timestamp' WHEN k % 503 = 2 THEN 'not progressive' WHEN k % 499 = 3 THEN 'size out of range' WHEN k % 491 = 4 THEN 'unsupported pixel format'
  WHEN k % 487 = 5 THEN 'not tagged SDR' WHEN k % 3 = 0 AND k % 479 = 6 THEN 'incomplete colour metadata' END AS reason,
  CASE k % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'left' END AS chroma_location, CASE WHEN k % 2 = 0 THEN '1:1' ELSE '4:3' END AS sar,
  CASE k % 3 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv422p10le' ELSE 'yuv444p' END AS pix_fmt FROM k)
"""


@query("read_frame_records", f"""WITH {FRAME_SQL}
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ordinal) - 1 AS ordinal, t_us, CAST(1080 AS BIGINT) AS height, sar, pix_fmt, chroma_location FROM fr WHERE reason IS NULL""")
def read_frame_records(spark, sf):
    f = v.frames(spark, sf)
    fields = _frame_fields(F.col("o_orderkey"))
    lines = f.select("file_id", F.lit("").alias("path"), F.col("ordinal").alias("n"), F.concat_ws("|", *[F.concat(F.lit(f"{k}="), c) for k, c in fields.items()]).alias("value"))
    rows, _ = rec.parse_frame_records(lines)
    return rows.select("file_id", "ordinal", "t_us", "height", F.concat_ws(":", "sar.num", "sar.den").alias("sar"), "pix_fmt", "chroma_location")


def _groups(df, by, order, item, name="items"):
    """Arrays for building JSON documents; ``by`` always bounds the group size."""
    before = lambda l, r: F.when(l["o"] < r["o"], -1).when(l["o"] > r["o"], 1).otherwise(0)
    a = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))), before)
    return df.groupBy(*by).agg(a.alias("a")).select(*by, F.transform("a", lambda r: r["x"]).alias(name))


@query("read_frame_documents", f"""WITH {FRAME_SQL}
SELECT file_id, ordinal // 100 AS doc, ordinal % 100 AS ordinal, t_us, sar, pix_fmt FROM fr WHERE reason IS NULL""")
def read_frame_documents(spark, sf):
    """Documents of a hundred frames each."""
    f = v.frames(spark, sf).withColumn("doc", F.expr("ordinal div 100"))
    item = F.struct(*[c.alias(k) for k, c in _frame_fields(F.col("o_orderkey")).items()])
    d = _groups(f, ["file_id", "doc"], "ordinal", item, "frames")
    d = d.select(F.struct("file_id", "doc").alias("file_id"), F.lit("").alias("path"), F.to_json(F.struct("frames")).alias("value"))
    rows, _ = rec.parse_frame_documents(d)
    return rows.select("file_id.file_id", "file_id.doc", "ordinal", "t_us", F.concat_ws(":", "sar.num", "sar.den").alias("sar"), "pix_fmt")


def _metric_lines(spark, sf):
    f, c = v.frames(spark, sf), F.col("score_centi")
    n = (F.col("ordinal") + 1 + F.when((F.col("file_id") == 3) & (F.col("ordinal") > 5), 1).otherwise(0)).cast("string")
    mk = lambda value: f.select("file_id", F.lit("").alias("path"), F.col("ordinal").alias("n"), value.alias("value"))
    num = lambda x: F.format_string("%.4f", x)
    psnr = mk(F.concat(F.lit("n:"), n, F.lit(" mse_avg:0.10 psnr_avg:"), F.when(c % 50 == 0, "inf").otherwise(num(c / 200.0))))
    ssim = mk(F.concat(F.lit("n:"), n, F.lit(" Y:0.99 All:"), num(c / 10000.0), F.lit(" (17.02)")))
    x = lambda s: F.when(c % 50 == 0, "inf").otherwise(num((c + s) / 200.0))
    xpsnr = mk(F.concat(F.lit("n: "), n, F.lit("  XPSNR y: "), x(0), F.lit("  XPSNR u: "), x(10), F.lit("  XPSNR v: "), x(20)))
    return {"psnr": psnr, "ssim": ssim, "xpsnr": xpsnr}


@query("read_metric_reports", """
WITH m AS (SELECT file_id, ordinal + CASE WHEN file_id = 3 AND ordinal > 5 THEN 1 ELSE 0 END AS frame, score_centi AS c FROM frames)
SELECT file_id, 'psnr' AS metric, frame, CASE WHEN c % 50 <> 0 THEN round(c / 200e0, 4) END AS score FROM m
UNION ALL SELECT file_id, 'ssim', frame, round(c / 10000e0, 4) FROM m
UNION ALL SELECT file_id, 'xpsnr', frame, CASE WHEN c % 50 <> 0 THEN round(-10 * log10((4 * pow(10e0, -c / 200e0 / 10) + pow(10e0, -(c + 10) / 200e0 / 10) + pow(10e0, -(c + 20) / 200e0 / 10)) / 6), 4) END FROM m
UNION ALL SELECT file_id, 'vmaf', ordinal, c / 100e0 FROM (SELECT *, score_centi AS c FROM frames) WHERE ordinal >= 0""")
def read_metric_reports(spark, sf):
    rows = None
    for metric, lines in _metric_lines(spark, sf).items():
        r = rec.parse_metric_lines(lines, metric)[0].select("file_id", "metric", "frame", F.round("score", 4).alias("score"))
        rows = r if rows is None else rows.unionByName(r)
    f = v.frames(spark, sf).withColumn("doc", F.expr("ordinal div 100"))
    item = F.struct(F.col("ordinal").alias("frameNum"), F.create_map(F.lit("vmaf"), F.col("score_centi") / 100.0).alias("metrics"))
    d = _groups(f, ["file_id", "doc"], "ordinal", item, "frames").select("file_id", F.lit("").alias("path"), F.to_json(F.struct("frames")).alias("value"))
    return rows.unionByName(rec.parse_metric_documents(d)[0].select("file_id", "metric", "frame", "score"))


@query("metric_verdict", """SELECT file_id, 'ssim' AS metric, count(*) AS frames, min(ordinal) AS first_frame, CASE WHEN file_id = 3 THEN 'frames skipped or repeated' WHEN file_id = 4 THEN 'frame count differs' END AS reason FROM frames GROUP BY file_id""")
def metric_verdict(spark, sf):
    rows, _ = rec.parse_metric_lines(_metric_lines(spark, sf)["ssim"], "ssim")
    due = v.frames(spark, sf).groupBy("file_id").agg((F.count(F.lit(1)) + F.when(F.col("file_id") == 4, 1).otherwise(0)).alias("expected_frames"))
    return rec.metric_verdict(rows, due).select("file_id", "metric", "frames", "first_frame", "reason")


def _hash_lines(spark, sf):
    """Listing per file: three header lines, then one record per frame."""
    f = v.frames(spark, sf)
    k = F.col("o_orderkey")
    body = F.concat_ws(", ", F.lit("0"), S("ordinal"), F.when(k % 601 == 1, "NOPTS").when(k % 607 == 2, "?").otherwise(S("ordinal")), F.lit("1"), F.lit("3110400"), F.col("hash"))
    rows = f.select("file_id", S("file_id").alias("path"), (F.col("ordinal") + 3).alias("n"), body.alias("value"))
    head = f.select("file_id").distinct().select("file_id", S("file_id").alias("path"), F.posexplode(F.array(F.lit("#hash: SHA256"), F.lit(rec.COLUMN_HEADER), F.lit("#tb 0: 1001/24000"))).alias("n", "value"))
    return rows.unionByName(head.withColumn("n", F.col("n").cast("long")))


@query("read_frame_hashes", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ordinal) - 1 AS i FROM frames WHERE o_orderkey % 607 <> 2 OR o_orderkey % 601 = 1)
SELECT file_id, i AS ordinal, CASE WHEN o_orderkey % 601 <> 1 THEN ordinal END AS pts_ticks, CASE WHEN o_orderkey % 601 <> 1 THEN CAST(round(ordinal * 1001 * 1e6 / 24000) AS BIGINT) END AS pts_us, hash FROM b""")
def read_frame_hashes(spark, sf):
    return rec.parse_frame_hashes(_hash_lines(spark, sf))[0].select("file_id", "ordinal", "pts_ticks", "pts_us", "hash")


@query("frame_hash_quarantine", """SELECT file_id, ordinal + 3 AS n, CASE WHEN o_orderkey % 601 = 1 THEN 'reordered or empty frame' ELSE 'invalid timestamp' END AS reason FROM frames WHERE o_orderkey % 601 = 1 OR o_orderkey % 607 = 2""")
def frame_hash_quarantine(spark, sf):
    return rec.parse_frame_hashes(_hash_lines(spark, sf), strict=True)[1].select("file_id", "n", "reason")


@query("read_cues", f"""WITH {CUES} SELECT file_id, n // 200 AS part, n % 200 AS n, format, CASE WHEN format = 'ass' THEN CAST(round(start_ms / 10.0) * 10 AS BIGINT) ELSE start_ms END AS start_ms,
  CASE WHEN format = 'ass' THEN CAST(round(end_ms / 10.0) * 10 AS BIGINT) ELSE end_ms END AS end_ms, body FROM cues WHERE file_id % 10 <> 9 OR n // 200 > 0""")
def read_cues(spark, sf):
    """Documents rendered from the conversations; every tenth has a reversed cue."""
    from reeltally.operators.cues import cue_lines

    c = cue_rows(spark, sf)
    bad = (F.col("file_id") % 10 == 9) & (F.col("n") == 0)
    c = c.withColumn("end_ms", F.when(bad, F.col("start_ms")).otherwise(F.col("end_ms")))
    d = _groups(cue_lines(c).withColumn("part", F.expr("n div 200")), ["file_id", "part", "format"], "n", F.col("line"))
    head = F.when(F.col("format") == "webvtt", "WEBVTT\n\n").when(F.col("format") == "ass", "[Script Info]\n\n[Events]\n").otherwise("")
    d = d.select(F.struct("file_id", "part").alias("file_id"), "format", F.lit("").alias("path"), F.concat(head, F.array_join("items", "\n")).alias("value"))
    return docs.parse_cue_documents(d)[0].select("file_id.file_id", "file_id.part", "n", "format", "start_ms", "end_ms", "body")


@query("read_grain_segments", """SELECT file_id, ordinal AS n, ordinal * 417083 AS start_tick, (ordinal + 1) * 417083 AS end_tick FROM frames WHERE ordinal % 9 <> 4 AND o_orderkey % 701 <> 3""")
def read_grain_segments(spark, sf):
    return rec.parse_grain_segments(_grain_lines(spark, sf))[0]


def _grain_lines(spark, sf):
    k, n = F.col("o_orderkey"), F.col("ordinal")
    line = F.when(n % 9 == 4, "p 6 0 0 0").when(k % 701 == 3, "E 1 2").otherwise(F.concat(F.lit("E "), (n * 417083).cast("string"), F.lit("  "), ((n + 1) * 417083).cast("string"), F.lit(" 1 7 1")))
    return v.frames(spark, sf).select("file_id", F.lit("").alias("path"), n.alias("n"), line.alias("value"))


@query("read_scene_slices", """
WITH s AS (SELECT file_id, ordinal // 40 AS slice, ordinal % 40 AS n, count(*) OVER (PARTITION BY file_id, ordinal // 40) AS c FROM frames)
SELECT file_id, slice, l.list, n, n * 24 AS start_frame, n * 24 + 24 AS end_frame FROM s, (VALUES ('scenes'), ('split_scenes')) l(list) WHERE file_id % 7 <> 5 AND (list = 'scenes' OR file_id % 2 = 0)""")
def read_scene_slices(spark, sf):
    return docs.parse_scene_slices(_slice_documents(spark, sf))[1]


def _slice_documents(spark, sf):
    f = v.frames(spark, sf).withColumn("slice", F.expr("ordinal div 40")).withColumn("i", F.col("ordinal") % 40)
    item = F.struct((F.col("i") * 24).alias("start_frame"), (F.col("i") * 24 + 24).alias("end_frame"))
    d = _groups(f, ["file_id", "slice"], "i", item, "scenes")
    frames = F.when(F.col("file_id") % 7 != 5, F.size("scenes") * 24)
    return d.select("file_id", "slice", F.lit("").alias("path"), F.to_json(F.struct(frames.alias("frames"), "scenes", F.when(F.col("file_id") % 2 == 0, F.col("scenes")).alias("split_scenes"))).alias("value"))


@query("read_job_history", """
WITH o AS (SELECT o_orderkey // 100 AS doc, o_orderkey::VARCHAR AS job_id, CASE o_orderstatus WHEN 'P' THEN 'stopped' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS state, CAST(round(o_totalprice * 100) AS BIGINT) AS input_bytes FROM orders)
SELECT job_id, state, input_bytes FROM o WHERE doc % 11 <> 3 AND doc % 13 <> 4""")
def read_job_history(spark, sf):
    return docs.parse_job_history(_history_documents(spark, sf))[0].select("job_id", "state", "input_bytes")


def _history_documents(spark, sf):
    """One history document per hundred orders; some have another version or a repeated id."""
    o = v.table(spark, sf, "orders").withColumn("doc", F.expr("o_orderkey div 100"))
    state = F.when(F.col("o_orderstatus") == "P", "stopped").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    job = F.struct(S("o_orderkey").alias("id"), state.alias("state"), F.lit("av1an").alias("backend"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("inputBytes"),
                   F.array(F.lit("a"), F.lit("b")).alias("logs"))
    d = _groups(o, ["doc"], "o_orderkey", job, "jobs")
    k = F.col("doc")
    jobs_ = F.when(k % 13 == 4, F.concat("jobs", F.slice("jobs", 1, 1))).otherwise(F.col("jobs"))
    return d.select("doc", S("doc").alias("path"), F.to_json(F.struct(F.when(k % 11 == 3, 2).otherwise(1).alias("version"), jobs_.alias("jobs"))).alias("value"))


def progress_lines(spark, sf):
    """Progress records of one job per user, with other lines between."""
    i = F.col("event_id")
    c = F.round(F.col("value") * 100).cast("long")
    line = F.concat(
        F.when(i % 2 == 0, "[consumer] ").otherwise(""), F.lit("Encoding: "), c.cast("string"), F.when(i % 3 != 0, "/2000").otherwise(""), F.lit(" Frames @ "),
        F.when(i % 4 == 0, F.concat((i % 500).cast("string"), F.lit(" fpm"))).otherwise(F.concat((i % 90).cast("string"), F.lit(".25 fps"))),
        F.lit(" | "), (i % 9000).cast("string"), F.lit(".5 kb/s | Size: "), (i % 40).cast("string"), F.lit(".25 MB"), F.when(i % 5 != 0, F.concat(F.lit(" ["), (i % 700).cast("string"), F.lit(".5 MB]"))).otherwise(""),
        F.lit(" | Time: 0:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":07"), F.when(i % 5 != 0, F.concat(F.lit(" [-1:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("]"))).otherwise(""))
    text = F.when(i % 7 == 0, "Muxing").when(i % 7 == 1, F.concat(F.lit("Encoding: x Frames @ "), S("event_id"))).otherwise(line)
    return v.events(spark, sf).select(S("user_id").alias("job_id"), i.alias("n"), text.alias("value"))


@query("read_tool_logs", """
WITH p AS (SELECT user_id::VARCHAR AS job_id, event_id AS n, CAST(round(value * 100) AS BIGINT) AS frames, event_id AS i FROM events WHERE event_id % 7 > 1)
SELECT job_id, n, frames, CASE WHEN i % 3 <> 0 THEN CAST(2000 AS BIGINT) END AS total_frames, CASE WHEN i % 3 <> 0 THEN least(frames / 2000 * 100e0, 100e0) END AS percent,
  CASE WHEN i % 4 = 0 THEN (i % 500) / 60e0 ELSE i % 90 + 0.25e0 END AS fps, i % 9000 + 0.5e0 AS bitrate_kbps, i % 40 * 1000000 + 250000 AS size_bytes,
  CASE WHEN i % 5 <> 0 THEN i % 700 * 1000000 + 500000 END AS estimated_size_bytes, i % 60 * 60 + 7 AS elapsed_s, CASE WHEN i % 5 <> 0 THEN 3600 + i % 60 END AS eta_s FROM p""")
def read_tool_logs(spark, sf):
    return rec.parse_progress(progress_lines(spark, sf)).drop("value")


@query("read_crop_samples", """
WITH c AS (SELECT o_custkey AS file_id, o_orderkey % 3 AS position, o_orderkey AS n, 1900 - o_orderkey % 7 AS w, 1000 - o_orderkey % 5 AS h, o_orderkey % 23 AS x, o_orderkey % 97 AS y FROM orders),
e AS (SELECT *, x // 2 * 2 AS x0, y // 2 * 2 AS y0, (x + w + 1) // 2 * 2 AS x1, (y + h + 1) // 2 * 2 AS y1 FROM c)
SELECT file_id, position, n, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM e WHERE n % 31 <> 0 AND x + w <= 1920 AND y + h <= 1080 AND x1 <= 1920 AND y1 <= 1080""")
def read_crop_samples(spark, sf):
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    line = F.when(k % 31 == 0, "[Parsed_cropdetect] no crop here").otherwise(
        F.concat(F.lit("[Parsed_cropdetect] x1:0 crop=1:1:1 t:3 crop="), F.concat_ws(":", t(1900 - k % 7), t(1000 - k % 5), t(k % 23), t(k % 97)), F.lit(" end")))
    lines = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.lit("").alias("path"), (k % 3).alias("position"), k.alias("n"), line.alias("value"),
                                                F.lit(1920).cast("long").alias("frame_w"), F.lit(1080).cast("long").alias("frame_h"))
    return rec.parse_crop_samples(lines).drop("frame_w", "frame_h")


@query("read_field_samples", """
WITH l AS (SELECT o_custkey AS file_id, o_orderkey % 3 AS position, max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS m, max(o_orderkey) FILTER (o_orderkey % 2 = 1) AS r FROM orders GROUP BY ALL)
SELECT file_id, position, coalesce(m % 100, 0) AS tff, coalesce(m % 50, 0) AS bff, coalesce(m % 20, 0) AS progressive, coalesce(m % 10, 0) AS undetermined,
  coalesce(r % 7 + r % 5, 0) AS repeated, coalesce(r % 90, 0) AS neither FROM l""")
def read_field_samples(spark, sf):
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    line = F.when(k % 2 == 0, F.concat(F.lit("[idet] Multi frame detection: TFF: "), t(k % 100), F.lit(" BFF:  "), t(k % 50), F.lit(" Progressive: "), t(k % 20), F.lit(" Undetermined:"), t(k % 10))).otherwise(
        F.concat(F.lit("[idet] Repeated Fields: Neither:  "), t(k % 90), F.lit(" Top:  "), t(k % 7), F.lit(" Bottom: "), t(k % 5)))
    lines = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.lit("").alias("path"), (k % 3).alias("position"), k.alias("n"), line.alias("value"))
    return rec.parse_field_samples(lines)


@query("read_gap_samples", """
SELECT o_custkey AS file_id, o_orderkey % 3 AS position, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS n, o_orderkey % 997 / 8e0 AS value FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 13 <> 5""")
def read_gap_samples(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 1, "frame:1 pts:2").when(k % 13 == 5, "lavfi.signalstats.YDIF=nan").otherwise(F.concat(F.lit("lavfi.signalstats.YDIF="), (k % 997 / 8.0).cast("string")))
    lines = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.lit("").alias("path"), (k % 3).alias("position"), k.alias("n"), line.alias("value"))
    return rec.parse_gap_samples(lines)


@query("read_loudness_reports", """
SELECT c_custkey AS file_id, CASE WHEN c_custkey % 6 <> 0 THEN -70 + c_custkey % 640 / 8e0 END AS integrated, CASE WHEN c_custkey % 6 <> 0 THEN -(c_custkey % 160) / 8e0 END AS peak, c_custkey % 24 / 2e0 AS lra
FROM customer WHERE c_custkey % 17 <> 3 AND c_custkey % 19 <> 4""")
def read_loudness_reports(spark, sf):
    return docs.parse_loudness_reports(_loudness_documents(spark, sf))[0]


def _loudness_documents(spark, sf):
    k = F.col("c_custkey")
    t = lambda c: c.cast("string")
    i = F.when(k % 6 == 0, "-inf").when(k % 19 == 4, "300.0").otherwise(t(-70 + k % 640 / 8.0))
    j = F.concat(F.lit('{"input_i" : "'), i, F.lit('", "input_tp" : "'), F.when(k % 6 == 0, "-inf").otherwise(t(-(k % 160) / 8.0)), F.lit('", "input_lra" : "'), t(k % 24 / 2.0), F.lit('"}\n'))
    text = F.when(k % 17 == 3, "no json at all").otherwise(F.concat(F.lit('frame 1 {"input_i": "1"}\n[loudnorm]\n'), j))
    # The value 300 is reached only where the loudness is not silent.
    text = F.when((k % 19 == 4) & (k % 6 == 0), "nothing").otherwise(text)
    return v.table(spark, sf, "customer").select(k.alias("file_id"), F.lit("").alias("path"), text.alias("value"))


@query("read_dynamic_metadata", """
SELECT o_orderkey // 64 AS file_id, o_orderkey % 64 AS frame, o_orderkey % 7 AS scene_id FROM orders WHERE o_orderkey // 64 % 5 <> 2 AND o_orderkey // 64 % 7 <> 3""")
def read_dynamic_metadata(spark, sf):
    o = v.table(spark, sf, "orders").withColumn("file_id", F.expr("o_orderkey div 64"))
    d = _groups(o, ["file_id"], "o_orderkey", F.col("o_orderkey") % 7, "ids")
    k = F.col("file_id")
    info = F.transform("ids", lambda s, i: F.struct((i + F.when(k % 5 == 2, 1).otherwise(0)).alias("SequenceFrameIndex"), F.lit(1).alias("NumberOfWindows"), s.alias("SceneId")))
    d = d.select("file_id", F.lit("").alias("path"), (F.size("ids") + F.when(k % 7 == 3, 1).otherwise(0)).alias("frames"), F.to_json(F.struct(info.alias("SceneInfo"))).alias("value"))
    return docs.parse_dynamic_metadata(d)[0].drop("hash")


@query("read_probe_documents", """
WITH l AS (SELECT *, l_linenumber AS i FROM lineitem),
g AS (SELECT l_orderkey AS file_id, i AS stream_index, min(l_quantity) AS q, min(l_partkey) AS p FROM l GROUP BY ALL)
SELECT file_id, CAST(stream_index AS BIGINT) AS stream_index, CASE WHEN i = 1 THEN 'video' WHEN i < 5 THEN 'audio' ELSE 'unknown' END AS kind,
  CASE WHEN p % 4 = 0 THEN q WHEN p % 4 = 1 THEN 62.5e0 END AS duration_s,
  CASE WHEN p % 3 = 0 THEN '25/1' WHEN p % 3 = 1 THEN '24000/1001' END AS frame_rate,
  CASE WHEN p % 5 = 0 THEN CAST(12 AS BIGINT) WHEN i = 1 THEN CAST(10 AS BIGINT) END AS bit_depth,
  CASE WHEN p % 6 = 0 THEN 'HDR / PQ' WHEN p % 6 = 1 THEN 'HDR / HLG' END AS hdr_format,
  CASE WHEN i = 1 THEN p % 2 = 0 END AS has_static_hdr, CASE WHEN i = 1 AND p % 7 <> 0 THEN CAST(8 AS BIGINT) END AS dolby_profile,
  CASE WHEN p % 2 = 0 THEN 'T' || p::VARCHAR WHEN p % 3 = 0 THEN 'handler' END AS title
FROM (SELECT *, stream_index AS i FROM g) WHERE file_id % 50 <> 7""")
def read_probe_documents(spark, sf):
    s = docs.parse_probe_documents(probe_docs(spark, sf))[1]
    rate = F.concat_ws("/", "frame_rate.num", "frame_rate.den")
    return s.select("file_id", "stream_index", "kind", "duration_s", F.when(F.col("frame_rate").isNotNull(), rate).alias("frame_rate"), "bit_depth", "hdr_format", "has_static_hdr", "dolby_profile", "title")


@query("read_probe_files", """
WITH g AS (SELECT l_orderkey AS file_id, l_linenumber AS i, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT file_id, CASE WHEN file_id % 3 = 0 THEN file_id % 1000 / 8e0 ELSE max(CASE WHEN p % 4 = 0 THEN q WHEN p % 4 = 1 THEN 62.5e0 END) END AS duration_s, 'Film ' || file_id::VARCHAR AS title, count(*) * 1000 AS bit_rate
FROM g WHERE file_id % 50 <> 7 GROUP BY file_id""")
def read_probe_files(spark, sf):
    return docs.parse_probe_documents(probe_docs(spark, sf))[0].select("file_id", "duration_s", "title", "bit_rate")


def probe_docs(spark, sf):
    """One probe document per order, with a stream per line number; every fiftieth is torn."""
    g = v.lineitem(spark, sf).groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("i")).agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))

    def joined(*members):
        """A JSON object of those members that are not null, by name and JSON text."""
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), text) for name, text in members]), F.lit("}"))

    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    record = '{"side_data_type":"DOVI configuration record","dv_profile":'

    def stream(line):
        i, p, q = line["i"], line["p"], line["q"].cast("string")
        mark = F.when(p % 2 == 0, "Mastering display metadata").otherwise("nothing")
        sides = F.concat(F.lit('[{"side_data_type":"'), mark, F.lit(f'"}},{record}8}},{record}'), F.when(p % 7 == 0, "5").otherwise("8"), F.lit("}]"))
        kind = F.when(i == 1, "video").when(i < 5, "audio").otherwise(" ")
        tags = joined(("DURATION", F.when(p % 4 == 1, '"0:01:02.5"').when(p % 4 == 2, '"0:61:02.5"')), ("TITLE", F.when(p % 2 == 0, quoted(F.concat(F.lit("T"), p.cast("string"))))),
                      ("handler_name", F.when(p % 3 == 0, '"handler"').otherwise('"SoundHandler"')))
        return joined(
            ("index", i.cast("string")), ("codec_type", quoted(kind)), ("duration", F.when(p % 4 == 0, quoted(q)).when(p % 4 == 3, '"N/A"')),
            ("avg_frame_rate", F.when(p % 3 == 0, '"25/1"').otherwise('"0/0"')), ("r_frame_rate", F.when(p % 3 == 1, '"24000/1001"').otherwise('"90000/0"')),
            ("bits_per_raw_sample", F.when(p % 5 == 0, '"12"')), ("pix_fmt", F.when(i == 1, '"yuv420p10le"')),
            ("color_transfer", F.when(p % 6 == 0, '"smpte2084"').when(p % 6 == 1, '"arib-std-b67"').when(p % 6 == 2, '"unknown"')), ("side_data_list", sides), ("tags", tags))

    # Only the numbers of a line are shuffled and sorted (a line number occurs once in a file), and texts are joined, as trees of structs cost more than the parsing.
    d = g.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("i", "p", "q"))).alias("lines"))
    k = F.col("file_id")
    tags = joined(("Title", quoted(F.concat(F.lit("Film "), S("file_id")))))
    fmt = joined(("duration", F.when(k % 3 == 0, (k % 1000 / 8.0).cast("string"))), ("tags", tags), ("bit_rate", quoted((F.size("lines") * 1000).cast("string"))))
    d = d.select("file_id", joined(("format", fmt), ("streams", F.concat(F.lit("["), F.array_join(F.transform("lines", stream), ","), F.lit("]")))).alias("text"))
    text = F.col("text")
    torn = F.when(k % 50 == 7, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    return d.select("file_id", S("file_id").alias("path"), torn.alias("value"))


@query("read_chunk_progress", """
WITH c AS (SELECT l_orderkey AS job_id, l_linenumber::VARCHAR AS chunk, min(CAST(l_quantity AS BIGINT)) AS frames FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
t AS (SELECT job_id, sum(frames) AS done FROM c GROUP BY job_id)
SELECT job_id, chunk, frames FROM c JOIN t USING (job_id) WHERE done <= 150 AND job_id % 9 <> 4 AND job_id % 10 <> 3""")
def read_chunk_progress(spark, sf):
    c = v.lineitem(spark, sf).where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("job_id"), S("l_linenumber").alias("chunk")).agg(F.min(F.col("l_quantity").cast("long")).alias("frames"))
    d = c.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk", F.struct("frames")))).alias("done"))
    k = F.col("job_id")
    text = F.to_json(F.struct(F.when(k % 9 == 4, 151).otherwise(150).alias("frames"), "done"))
    torn = F.when(k % 10 == 3, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    rows = docs.parse_chunk_progress(d.select("job_id", F.lit(150).cast("long").alias("total_frames"), torn.alias("value")))
    return rows.where("done").select("job_id", "chunk", "frames")


def _listing(spark, sf):
    """Page addresses as file paths; their extension follows the page number and some are links or repeats."""
    p = v.table(spark, sf, "pages")
    k = F.col("page_id")
    ext = F.when(k % 4 == 0, "MKV").when(k % 4 == 1, "mp4").when(k % 4 == 2, "srt").otherwise("opus")
    return p.select(F.concat(F.lit("/m/"), F.when(k % 20 == 0, "same").otherwise(S("page_id")), F.lit("."), ext).alias("path"), F.length("html").cast("long").alias("size_bytes"), (k % 30 == 9).alias("is_link"))


LISTING = """
li AS (SELECT '/m/' || CASE WHEN page_id % 20 = 0 THEN 'same' ELSE page_id::VARCHAR END || '.' || CASE page_id % 4 WHEN 0 THEN 'MKV' WHEN 1 THEN 'mp4' WHEN 2 THEN 'srt' ELSE 'opus' END AS path, length(html) AS size_bytes,
  page_id % 4 <> 2 AND page_id % 30 <> 9 AS media FROM pages),
me AS (SELECT path, min(size_bytes) AS size_bytes FROM li WHERE media GROUP BY path)
"""


@query("scan_inventory", f"WITH {LISTING} SELECT * FROM me")
def scan_inventory(spark, sf):
    return docs.scan_inventory(_listing(spark, sf))[0]


@query("scan_inventory_summary", f"WITH {LISTING} SELECT count(*) AS entries, count(*) - (SELECT count(*) FROM me) AS skipped, (SELECT count(*) FROM me) AS media, false AS truncated FROM li")
def scan_inventory_summary(spark, sf):
    return docs.scan_inventory(_listing(spark, sf))[1]


@query("file_verdict", """
WITH b AS (SELECT user_id % 10 AS file_id, event_id AS n, CASE WHEN event_id % 1021 = 9 THEN 'unexpected field' WHEN event_id % 1031 = 2 THEN 'repeated field'
  WHEN event_id % 1009 = 5 AND event_id % 17 <> 0 THEN 'negative duration' WHEN event_id % 1013 = 7 THEN 'no usable size' END AS reason FROM events)
SELECT file_id, count(*) FILTER (reason IS NULL) AS rows, count(reason) AS rejected, min(n) FILTER (reason IS NOT NULL) AS first_bad,
  arg_min(reason, n) FILTER (reason IS NOT NULL) AS reason, count(reason) = 0 AS ok FROM b GROUP BY file_id""")
def file_verdict(spark, sf):
    return readers.file_verdict(*rec.parse_packet_records(_packet_lines(spark, sf, hashed=False)))


@query("scalar_expressions", """
SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 3599.5 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock,
  ((o_orderkey % 900 + 1) * 1001 // gcd((o_orderkey % 900 + 1) * 1001, 24000))::VARCHAR || '/' || (24000 // gcd((o_orderkey % 900 + 1) * 1001, 24000))::VARCHAR AS rate,
  CASE WHEN round((o_orderkey % 9000) * 4e0 / 3 / 2) * 2 > 0 THEN CAST(round((o_orderkey % 9000) * 4e0 / 3 / 2) * 2 AS BIGINT) END AS display_width
FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS s FROM orders)""")
def scalar_expressions(spark, sf):
    k = F.col("o_orderkey")
    pair = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    rate = X.reduced(pair((k % 900 + 1) * 1001, F.lit(24000)))
    return v.table(spark, sf, "orders").select(
        k.alias("id"), X.short_clock("o_totalprice").alias("clock"), F.concat_ws("/", rate["num"], rate["den"]).alias("rate"),
        X.display_width((k % 9000).cast("double"), pair(F.lit(4), F.lit(3))).alias("display_width"))
