"""Registered queries: sampling, pooling, ladders, detectors, loudness, budgets, reports."""

from pyspark.sql import functions as F

from reeltally.operators import scoring
from reeltally.queries import stand_ins as v
from reeltally.queries.registry import query
from reeltally.sources import sinks


@query("every_nth", "SELECT file_id, stream_index, ordinal, ordinal // 7 AS sample, hash FROM frames WHERE ordinal % 7 = 0")
def every_nth(spark, sf):
    return scoring.every_nth(v.frames(spark, sf), 7).select("file_id", "stream_index", "ordinal", "sample", "hash")


def order_files(spark, sf):
    """Orders as files whose duration in seconds comes from the price."""
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), (F.floor("o_totalprice") % 4000 + 1).cast("double").alias("duration_s"))


SAMPLES = """
f AS (SELECT o_orderkey AS file_id, CAST(floor(o_totalprice) % 4000 + 1 AS DOUBLE) AS d FROM orders),
p AS (SELECT *, least(d * 0.05e0, 60e0) AS skip, d - least(d * 0.05e0, 60e0) * 2e0 < 5 * 20e0 AS tight FROM f),
q AS (SELECT *, CASE WHEN tight THEN 0e0 ELSE skip END AS a, CASE WHEN tight THEN d ELSE d - skip * 2e0 END AS span FROM p),
n AS (SELECT *, CASE WHEN d <= 20 THEN 1 ELSE least(5, greatest(CAST(floor(span / 20e0) AS BIGINT), 1)) END AS n FROM q),
samples AS (SELECT file_id, d, CAST(k AS BIGINT) AS sample, CASE WHEN d <= 20 THEN 0e0 ELSE least(greatest(a + (k + 0.5e0) * (span / n) - 10e0, 0e0), d - 20e0) END AS start_s,
  CASE WHEN d <= 20 THEN d ELSE 20e0 END AS length_s FROM n, range(5) t(k) WHERE k < n)
"""


@query("plan_samples", f"WITH {SAMPLES} SELECT file_id, sample, round(start_s, 6) AS start_s, length_s FROM samples")
def plan_samples(spark, sf):
    return scoring.plan_samples(order_files(spark, sf), 5, 20.0).select("file_id", "sample", F.round("start_s", 6).alias("start_s"), "length_s")


@query("sampled_fraction", f"WITH {SAMPLES} SELECT file_id, sum(length_s) AS sampled_s, round(least(sum(length_s) / any_value(d), 1e0), 6) AS fraction FROM samples GROUP BY file_id")
def sampled_fraction(spark, sf):
    f = order_files(spark, sf)
    r = scoring.sampled_fraction(scoring.plan_samples(f, 5, 20.0), f)
    return r.withColumn("fraction", F.round("fraction", 6))


METRICS = ["psnr", "xpsnr", "ssim", "vmaf", "ssimulacra2", "butteraugli"]
SCORES = """
pts AS (SELECT file_id, crf, frames, m.metric, CASE WHEN score_centi IS NULL AND (m.k < 2 OR file_id % 3 = 0) THEN NULL
   WHEN m.k = 2 THEN coalesce(score_centi, 5000) / 9973e0 WHEN m.k = 5 THEN (10000 - coalesce(score_centi, 5000)) / 151e0 ELSE coalesce(score_centi, 5000) / 97e0 END AS score
  FROM rung_samples, (VALUES ('psnr', 0), ('xpsnr', 1), ('ssim', 2), ('vmaf', 3), ('ssimulacra2', 4), ('butteraugli', 5)) m(metric, k)),
pooled AS (SELECT file_id, crf, metric, CAST(sum(frames) AS DOUBLE) AS weight,
  CASE WHEN metric IN ('psnr', 'xpsnr') THEN CASE WHEN sum(coalesce(pow(10e0, -score / 10), 0) * frames) > 0 THEN -10 * log10(sum(coalesce(pow(10e0, -score / 10), 0) * frames) / sum(frames)) END
  WHEN count(*) = count(score) THEN sum(score * frames) / sum(frames) END AS score FROM pts GROUP BY file_id, crf, metric)
"""


def _points(spark, sf):
    r = v.rung_samples(spark, sf)
    m = F.posexplode(F.array(*[F.lit(x) for x in METRICS])).alias("k", "metric")
    d = r.select("*", m)
    c = F.coalesce("score_centi", F.lit(5000))
    hole = F.col("score_centi").isNull() & ((F.col("k") < 2) | (F.col("file_id") % 3 == 0))
    score = F.when(F.col("k") == 2, c / 9973.0).when(F.col("k") == 5, (10000 - c) / 151.0).otherwise(c / 97.0)
    return d.withColumn("score", F.when(~hole, score)).drop("k")


@query("pool_scores", f"WITH {SCORES} SELECT file_id, crf, metric, weight, round(score, 6) AS score FROM pooled")
def pool_scores(spark, sf):
    return scoring.pool_scores(_points(spark, sf), keys=["file_id", "crf"], weight="frames").withColumn("score", F.round("score", 6))


@query("recommend_rung", f"""WITH {SCORES},
t AS (SELECT *, round(score, 6) AS s FROM pooled)
SELECT file_id, metric, count(*) AS rungs, max(crf) FILTER (CASE metric WHEN 'psnr' THEN coalesce(s >= 45, true) WHEN 'ssim' THEN s >= 0.98 WHEN 'vmaf' THEN s >= 95
  WHEN 'ssimulacra2' THEN s >= 80 WHEN 'butteraugli' THEN s <= 4 ELSE false END) AS recommended_crf FROM t GROUP BY ALL""")
def recommend_rung(spark, sf):
    pooled = scoring.pool_scores(_points(spark, sf), keys=["file_id", "crf"], weight="frames").withColumn("score", F.round("score", 6))
    return scoring.recommend_rung(pooled)


@query("ladder_summary", """
WITH r AS (SELECT file_id, crf, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(seconds) AS BIGINT) AS seconds FROM rung_samples GROUP BY ALL)
SELECT *, round(bytes * 8e0 / seconds / 1000, 6) AS bitrate_kbps, CAST(round(bytes * 60e0 / seconds) AS BIGINT) AS bytes_per_minute,
  CAST(round(bytes * (600e0 + file_id) / seconds) AS BIGINT) AS projected_bytes FROM r""")
def ladder_summary(spark, sf):
    r = v.rung_samples(spark, sf)
    files = r.select("file_id").distinct().withColumn("duration_s", 600.0 + F.col("file_id"))
    return scoring.ladder_summary(r, files).withColumn("bitrate_kbps", F.round("bitrate_kbps", 6))


@query("xpsnr_frame_score", """
WITH e AS (SELECT file_id, (4 * pow(10e0, -(3000 + score_centi % 997) / 100e0 / 10) + pow(10e0, -(3500 + score_centi % 883) / 100e0 / 10)
  + CASE WHEN score_centi % 50 = 0 THEN 0 ELSE pow(10e0, -(3600 + score_centi % 701) / 100e0 / 10) END) / 6 AS err FROM frames)
SELECT file_id, round(-10 * log10(avg(err)), 6) AS score FROM e GROUP BY file_id""")
def xpsnr_frame_score(spark, sf):
    c = F.col("score_centi")
    vv = F.when(c % 50 == 0, float("inf")).otherwise((3600 + c % 701) / 100.0)
    err = scoring.xpsnr_frame_error((3000 + c % 997) / 100.0, (3500 + c % 883) / 100.0, vv)
    f = v.frames(spark, sf).groupBy("file_id").agg(F.avg(err).alias("e"))
    return f.select("file_id", F.round(scoring.error_score(F.col("e")), 6).alias("score"))


CROPS = """
crops AS (SELECT l_suppkey AS file_id, CAST(1920 AS BIGINT) AS frame_w, CAST(1080 AS BIGINT) AS frame_h,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber < 7 THEN 0 ELSE 2 * CAST(round(l_tax * 100) AS BIGINT) END AS x,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber < 7 THEN 132 ELSE 2 * CAST(round(l_discount * 100) AS BIGINT) END AS y,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber < 7 THEN 1920 ELSE 1900 - l_linenumber * 4 END AS w,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber < 7 THEN 816 ELSE 1000 - l_linenumber * 2 END AS h FROM lineitem)
"""


def crop_samples(spark, sf):
    ln = F.col("l_linenumber").cast("long")
    fixed = (F.col("l_suppkey") % 3 == 0) & (ln < 7)
    pick = lambda a, b: F.when(fixed, F.lit(a).cast("long")).otherwise(b)
    return v.lineitem(spark, sf).select(
        F.col("l_suppkey").alias("file_id"), F.lit(1920).cast("long").alias("frame_w"), F.lit(1080).cast("long").alias("frame_h"),
        pick(0, 2 * F.round(F.col("l_tax") * 100).cast("long")).alias("x"), pick(132, 2 * F.round(F.col("l_discount") * 100).cast("long")).alias("y"),
        pick(1920, 1900 - ln * 4).alias("w"), pick(816, 1000 - ln * 2).alias("h"))


def _crop_sql(tie: str, union: str) -> str:
    return f"""WITH {CROPS},
c AS (SELECT file_id, frame_w, frame_h, x, y, w, h, count(*) AS n FROM crops GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, w * h DESC, {tie}) AS k FROM c),
u AS (SELECT file_id, CAST(sum(n) AS BIGINT) AS total, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM c GROUP BY file_id),
d AS (SELECT r.*, total, {union}, n * 100 > total * 80 AS clear FROM r JOIN u USING (file_id) WHERE k = 1)
SELECT file_id, CASE WHEN clear THEN x ELSE a0 END AS crop_left, CASE WHEN clear THEN y ELSE b0 END AS crop_top,
  frame_w - CASE WHEN clear THEN x + w ELSE a1 END AS crop_right, frame_h - CASE WHEN clear THEN y + h ELSE b1 END AS crop_bottom,
  (n * 100 + total // 2) // total AS agreement_pct FROM d"""


@query("crop_consensus", _crop_sql("x DESC, y DESC, w DESC, h DESC", "x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1"))
def crop_consensus(spark, sf):
    return scoring.crop_consensus(crop_samples(spark, sf))


@query("crop_consensus_paired", _crop_sql("w DESC, h DESC, x DESC, y DESC",
       "x0 // 2 * 2 AS a0, y0 // 2 * 2 AS b0, least((x1 + 1) // 2 * 2, frame_w) AS a1, least((y1 + 1) // 2 * 2, frame_h) AS b1"))
def crop_consensus_paired(spark, sf):
    return scoring.crop_consensus(crop_samples(spark, sf), paired=True)


FIELDS = """
fields AS (SELECT l_suppkey AS file_id, CASE WHEN l_suppkey % 4 = 1 THEN CAST(l_quantity AS BIGINT) ELSE l_linenumber END AS tff,
  CASE WHEN l_suppkey % 4 = 2 THEN CAST(l_quantity AS BIGINT) ELSE l_linenumber % 2 END AS bff, CAST(round(l_discount * 100) AS BIGINT) AS progressive,
  CAST(round(l_tax * 100) AS BIGINT) AS undetermined, CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 1 END AS repeated, CAST(4 AS BIGINT) AS neither FROM lineitem),
gaps AS (SELECT l_suppkey AS file_id, l_orderkey % 11 AS n, CASE WHEN l_suppkey % 6 = 2 AND l_orderkey % 11 % 2 = 1 THEN 5 * l_quantity ELSE l_quantity END AS value FROM lineitem),
gr AS (SELECT file_id, avg(value) FILTER (n >= 1 AND n % 2 = 0) AS a, avg(value) FILTER (n >= 1 AND n % 2 = 1) AS b FROM gaps GROUP BY file_id),
ratio AS (SELECT file_id, CASE WHEN greatest(a, b) >= 0.5 AND a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN least(a, b) < 0.0001 THEN 1e12 ELSE greatest(a, b) / least(a, b) END END AS gap_ratio FROM gr)
"""


def field_samples(spark, sf):
    s, ln, q = F.col("l_suppkey"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    return v.lineitem(spark, sf).select(
        s.alias("file_id"), F.when(s % 4 == 1, q).otherwise(ln).alias("tff"), F.when(s % 4 == 2, q).otherwise(ln % 2).alias("bff"),
        F.round(F.col("l_discount") * 100).cast("long").alias("progressive"), F.round(F.col("l_tax") * 100).cast("long").alias("undetermined"),
        F.when(s % 5 == 0, 3).otherwise(1).cast("long").alias("repeated"), F.lit(4).cast("long").alias("neither"))


def gap_samples(spark, sf):
    n = F.col("l_orderkey") % 11
    value = F.when((F.col("l_suppkey") % 6 == 2) & (n % 2 == 1), 5 * F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return v.lineitem(spark, sf).select(F.col("l_suppkey").alias("file_id"), n.alias("n"), value.alias("value"))


@query("field_gap_ratio", f"WITH {FIELDS} SELECT file_id, round(gap_ratio, 6) AS gap_ratio FROM ratio")
def field_gap_ratio(spark, sf):
    return scoring.field_gap_ratio(gap_samples(spark, sf)).withColumn("gap_ratio", F.round("gap_ratio", 6))


@query("field_order_verdict", f"""WITH {FIELDS},
s AS (SELECT file_id, CAST(sum(tff) AS BIGINT) AS tff, CAST(sum(bff) AS BIGINT) AS bff, CAST(sum(progressive) AS BIGINT) AS progressive,
  CAST(sum(undetermined) AS BIGINT) AS undetermined, CAST(sum(repeated) AS BIGINT) AS repeated, CAST(sum(neither) AS BIGINT) AS neither FROM fields GROUP BY file_id),
c AS (SELECT *, greatest(tff, bff) > 0 AND greatest(tff, bff) * 4 >= (tff + bff) * 3 AND (tff + bff > progressive OR (tff + bff) * 5 > tff + bff + progressive + undetermined) AS combed
  FROM s LEFT JOIN ratio USING (file_id)),
o AS (SELECT *, CASE WHEN combed AND NOT coalesce(gap_ratio >= 4, false) THEN CASE WHEN bff > tff THEN 'bottom first' ELSE 'top first' END ELSE 'progressive' END AS measured,
  CASE file_id % 10 WHEN 7 THEN 'progressive' WHEN 8 THEN 'top first' WHEN 9 THEN 'bottom first' END AS said FROM c)
SELECT file_id, tff, bff, progressive, undetermined, coalesce(said, measured) AS field_order, said IS NOT NULL AS declared,
  said IS NULL AND measured <> 'progressive' AND repeated > 0 AND repeated * 5 > repeated + neither AS telecined,
  round(CASE WHEN said IS NULL AND combed THEN gap_ratio END, 6) AS gap_ratio FROM o""")
def field_order_verdict(spark, sf):
    s = field_samples(spark, sf)
    ratio = scoring.field_gap_ratio(gap_samples(spark, sf))
    k = F.col("file_id") % 10
    said = s.select("file_id").distinct().withColumn("field_order", F.when(k == 7, "progressive").when(k == 8, "tb").when(k == 9, "bt").otherwise("unknown"))
    r = scoring.field_order_verdict(s, ratio, said)
    return r.select("file_id", "tff", "bff", "progressive", "undetermined", "field_order", "declared", "telecined", F.round("gap_ratio", 6).alias("gap_ratio"))


@query("gain_proposal", """
WITH l AS (SELECT c_custkey AS file_id, CASE WHEN c_custkey % 13 <> 0 THEN -70 + c_custkey % 640 / 8e0 END AS i, CASE WHEN c_custkey % 17 <> 0 THEN -20 + c_custkey % 320 / 16e0 END AS p FROM customer),
g AS (SELECT *, CASE WHEN i IS NOT NULL AND p IS NOT NULL THEN least(-23 - i, -1 - p, 24) END AS safe FROM l)
SELECT file_id, i AS integrated, p AS peak, CASE WHEN safe >= -60 THEN CAST(floor(safe * 10) AS BIGINT) END AS gain_tenths_db,
  coalesce(i IS NOT NULL AND p IS NOT NULL AND -1 - p < -23 - i, false) AS limited_by_peak FROM g""")
def gain_proposal(spark, sf):
    k = F.col("c_custkey")
    l = v.table(spark, sf, "customer").select(
        k.alias("file_id"), F.when(k % 13 != 0, -70 + k % 640 / 8.0).alias("integrated"), F.when(k % 17 != 0, -20 + k % 320 / 16.0).alias("peak"),
        F.lit(-23.0).alias("target_lufs"), F.lit(-1.0).alias("peak_limit_db"))
    return scoring.gain_proposal(l).drop("target_lufs", "peak_limit_db")


@query("size_budget", """
WITH o AS (SELECT file_id, CAST(coalesce(sum(size) FILTER (stream_index <> 0), 0) AS BIGINT) AS other_bytes FROM packets GROUP BY file_id),
t AS (SELECT file_id, other_bytes, CASE WHEN file_id < 5 THEN (file_id * 1000 * 1048576 + 5) // 10 ELSE file_id * 3 * 1048576 END AS target_bytes, CAST(60 * (file_id + 1) AS DOUBLE) AS seconds FROM o),
a AS (SELECT *, target_bytes - other_bytes - (target_bytes // 100 + 65536) AS available_bytes FROM t),
k AS (SELECT *, CASE WHEN available_bytes >= 0 THEN CAST(floor(available_bytes * 8e0 / seconds / 1000) AS BIGINT) END AS k FROM a)
SELECT file_id, target_bytes, seconds, other_bytes, available_bytes, CASE WHEN k BETWEEN 1 AND 100000 THEN k END AS kbps,
  CASE WHEN available_bytes < 0 THEN 'target cannot hold the other streams' WHEN NOT coalesce(k BETWEEN 1 AND 100000, false) THEN 'bitrate out of range' END AS reason FROM k""")
def size_budget(spark, sf):
    p = v.packets(spark, sf).withColumn("kind", F.when(F.col("stream_index") == 0, "video").otherwise("audio"))
    f = F.col("file_id")
    size = F.when(f < 5, scoring.target_bytes(tenths=f * 1000)).otherwise(scoring.target_bytes(mib=f * 3))
    t = p.select("file_id").distinct().select("file_id", size.alias("target_bytes"), (60 * (f + 1)).cast("double").alias("seconds"))
    return scoring.size_budget(p, t).drop("ok")


@query("downsample_series", """
WITH n AS (SELECT file_id, stream_index, count(*) AS n, (count(*) + 99) // 100 AS s FROM frames GROUP BY ALL)
SELECT file_id, stream_index, ordinal, score_centi FROM frames JOIN n USING (file_id, stream_index) WHERE (ordinal % s = 0 AND ordinal // s < 99) OR ordinal = n - 1""")
def downsample_series(spark, sf):
    return scoring.downsample_series(v.frames(spark, sf), 100).select("file_id", "stream_index", "ordinal", "score_centi")


@query("write_report_csv", """
SELECT file_id, ordinal AS comparison_frame, ordinal + 10 AS reference_frame, ordinal + 20 AS candidate_frame,
  CASE WHEN score_centi % 100 = 0 THEN 'infinity' ELSE CAST(score_centi AS VARCHAR) END AS score FROM frames""")
def write_report_csv(spark, sf):
    """Writes the quality series as CSV and reads it back."""
    from reeltally.plans.session import shared_dir

    f = v.frames(spark, sf)
    pts = f.select("file_id", F.col("ordinal").alias("frame"), F.when(F.col("score_centi") % 100 != 0, F.col("score_centi")).alias("score"))
    path = shared_dir(spark)
    series = sinks.quality_csv(pts, 10, 20, keep=["file_id"])
    meta = sinks.metadata_csv(f.groupBy("file_id").agg(F.count(F.lit(1)).alias("frame_count")), ["file_id"], ["frame_count"])
    sinks.write_report_csv(series, meta, path, partition=["file_id"])
    schema = "comparison_frame long, reference_frame long, candidate_frame long, score string, file_id long"
    return spark.read.schema(schema).csv(f"{path}/series", header=True)


@query("report_metadata_csv", """
WITH m AS (SELECT c_custkey AS file_id, CASE WHEN c_custkey % 4 = 0 THEN '=' WHEN c_custkey % 4 = 1 THEN '"' ELSE '' END || c_name AS source_path, CAST(c_acctbal * 100 AS BIGINT)::VARCHAR AS packet_bytes FROM customer)
SELECT file_id, '"' || field || '"' AS field, '"' || CASE WHEN regexp_matches(value, '^[=+@-]') THEN chr(39) ELSE '' END || replace(value, '"', '""') || '"' AS value
FROM (SELECT file_id, 'source_path' AS field, source_path AS value FROM m UNION ALL SELECT file_id, 'packet_bytes', packet_bytes FROM m)""")
def report_metadata_csv(spark, sf):
    k = F.col("c_custkey")
    lead = F.when(k % 4 == 0, "=").when(k % 4 == 1, '"').otherwise("")
    m = v.table(spark, sf, "customer").select(k.alias("file_id"), F.concat(lead, "c_name").alias("source_path"), F.round(F.col("c_acctbal") * 100).cast("long").alias("packet_bytes"))
    return sinks.metadata_csv(m, ["file_id"], ["source_path", "packet_bytes"])


@query("validate_report", """
SELECT file_id, 'quality' AS kind, count(*) AS points, min(ordinal) FILTER (o_orderkey % 3001 = 0) AS first_bad, count(*) FILTER (o_orderkey % 3001 = 0) = 0 AS ok FROM frames GROUP BY file_id
UNION ALL
SELECT file_id, 'bitrate', count(*), min(ordinal) FILTER (o_orderkey % 2501 = 0 AND ordinal > 0), count(*) FILTER (o_orderkey % 2501 = 0 AND ordinal > 0) = 0 FROM frames GROUP BY file_id""")
def validate_report(spark, sf):
    f = v.frames(spark, sf).withColumn("i", F.col("ordinal"))
    head = f.groupBy("file_id").agg((F.count(F.lit(1)) * 2).alias("frame_count"), F.min("hash").alias("fingerprint")).withColumns(
        {"step": F.lit(2).cast("long"), "metric": F.lit("vmaf")})
    q = f.select("file_id", "i", (F.col("i") * 2 + F.when(F.col("o_orderkey") % 3001 == 0, 1).otherwise(0)).alias("frame"), (F.col("score_centi") / 100.0).alias("score"))
    bad = (F.col("o_orderkey") % 2501 == 0) & (F.col("i") > 0)
    b = f.select("file_id", "i", (F.col("i") - F.when(bad, 1).otherwise(0)).cast("double").alias("start_s"), F.lit(1.0).alias("mbps"), F.col("score_centi").alias("packet_bytes"))
    cols = ["file_id", "kind", "points", "first_bad", "ok"]
    one = sinks.validate_report(q, head, keys=["file_id"], kind="quality").withColumn("kind", F.lit("quality")).select(*cols)
    two = sinks.validate_report(b, head, keys=["file_id"], kind="bitrate").withColumn("kind", F.lit("bitrate")).select(*cols)
    return one.unionByName(two)
