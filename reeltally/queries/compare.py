"""Registered queries: comparisons, digests, duplicate runs, keyframes."""

from pyspark.sql import functions as F

from reeltally.operators import compare
from reeltally.queries import stand_ins as v
from reeltally.queries.registry import query


def _pairs(spark, sf):
    """Frames of file 2k against file 2k+1."""
    f = v.frames(spark, sf).select(F.expr("file_id div 2").alias("pair_id"), "file_id", "ordinal", "t_us", "hash", "score_centi")
    side = lambda n: f.where(F.col("file_id") % 2 == n).drop("file_id")
    return side(0), side(1)


@query("pair_by_ordinal", """
WITH l AS (SELECT file_id // 2 AS pair_id, * FROM frames WHERE file_id % 2 = 0), r AS (SELECT file_id // 2 AS pair_id, * FROM frames WHERE file_id % 2 = 1)
SELECT pair_id, ordinal, l.t_us AS l_t_us, r.t_us AS r_t_us,
  CASE WHEN r.t_us IS NULL THEN 'left' WHEN l.t_us IS NULL THEN 'right' ELSE 'both' END AS side
FROM l FULL JOIN r USING (pair_id, ordinal)
""")
def pair_by_ordinal(spark, sf):
    l, r = _pairs(spark, sf)
    return compare.pair_by_ordinal(l, r).select("pair_id", "ordinal", "l_t_us", "r_t_us", "side")


@query("pair_verdict", """
WITH l AS (SELECT file_id // 2 AS pair_id, * FROM frames WHERE file_id % 2 = 0), r AS (SELECT file_id // 2 AS pair_id, * FROM frames WHERE file_id % 2 = 1),
j AS (SELECT pair_id, ordinal, l.t_us AS a, r.t_us AS b FROM l FULL JOIN r USING (pair_id, ordinal))
SELECT pair_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS left_extra,
  count(*) FILTER (a IS NULL) AS right_extra, min(ordinal) FILTER (a IS NULL OR b IS NULL) AS first_bad,
  CASE WHEN count(*) FILTER (b IS NULL) > 0 THEN 'reference has more' WHEN count(*) FILTER (a IS NULL) > 0 THEN 'candidate has more' END AS reason
FROM j GROUP BY pair_id
""")
def pair_verdict(spark, sf):
    l, r = _pairs(spark, sf)
    return compare.pair_verdict(compare.pair_by_ordinal(l, r)).drop("ok")


@query("pair_with_clock_tolerance", """
WITH l AS (SELECT file_id // 2 AS pair_id, ordinal, t_us AS a, hash AS h FROM frames WHERE file_id % 2 = 0),
r AS (SELECT file_id // 2 AS pair_id, ordinal, t_us + (ordinal % 3) * 300 AS b, hash AS h2 FROM frames WHERE file_id % 2 = 1),
j AS (SELECT *, a - b AS d FROM l FULL JOIN r USING (pair_id, ordinal)),
o AS (SELECT pair_id, d AS d0 FROM j WHERE ordinal = 0),
g AS (SELECT pair_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS left_extra,
 count(*) FILTER (a IS NULL) AS right_extra, max(abs(d - d0)) AS max_clock_error_us,
 count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND h <> h2) AS geometry_changes FROM j JOIN o USING (pair_id) GROUP BY pair_id)
SELECT *, CASE WHEN max_clock_error_us > 2100 THEN 'frame timing differs' WHEN left_extra > 0 THEN 'reference has more'
 WHEN right_extra > 0 THEN 'candidate has more' WHEN geometry_changes > 0 THEN 'geometry differs' END AS reason FROM g
""")
def pair_with_clock_tolerance(spark, sf):
    l, r = _pairs(spark, sf)
    r = r.withColumn("t_us", F.col("t_us") + (F.col("ordinal") % 3) * 300)
    return compare.pair_with_clock_tolerance(l, r, geometry=["hash"]).drop("ok")


# The copy is two seconds late; every 997th packet is resized, the leading packets of stream 1
# lack their DTS, and the last packets of stream 2 of odd files are cut off.
COPY = """
copy AS (SELECT file_id, stream_index, ordinal, pts_us + 2000000 + event_id % 3 * 500 AS pts_us,
  CASE WHEN stream_index = 1 AND ordinal < 3 + file_id * 3 THEN NULL ELSE dts_us + 2000000 END AS dts_us,
  duration_us, size + CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS size, hash FROM packets
  WHERE NOT (stream_index = 2 AND file_id % 2 = 1 AND ordinal >= 100))
"""


def _copy(spark, sf):
    i = F.col("event_id")
    lead = (F.col("stream_index") == 1) & (F.col("ordinal") < 3 + F.col("file_id") * 3)
    return v.packets(spark, sf, keep_id=True).where(
        ~((F.col("stream_index") == 2) & (F.col("file_id") % 2 == 1) & (F.col("ordinal") >= 100))
    ).select(
        "file_id", "stream_index", "ordinal", (F.col("pts_us") + 2_000_000 + i % 3 * 500).alias("pts_us"),
        F.when(~lead, F.col("dts_us") + 2_000_000).alias("dts_us"), "duration_us",
        (F.col("size") + F.when(i % 997 == 0, 1).otherwise(0)).alias("size"), "hash")


@query("packet_fidelity_diff", f"""
WITH {COPY},
j AS (SELECT file_id, stream_index, ordinal, s.hash AS lh, c.hash AS rh, s.size AS lz, c.size AS rz, s.pts_us AS lp, c.pts_us AS rp,
  s.dts_us AS ld, c.dts_us AS rd, s.duration_us AS lu, c.duration_us AS ru FROM packets s FULL JOIN copy c USING (file_id, stream_index, ordinal)),
w AS (SELECT *, lag(ld) OVER q AS lprev, lag(rd) OVER q AS rprev,
  coalesce(bool_or(ld IS NOT NULL) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lseen,
  coalesce(bool_or(rd IS NOT NULL) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rseen
  FROM j WINDOW q AS (PARTITION BY file_id, stream_index ORDER BY ordinal)),
c AS (SELECT *, lh IS NOT NULL AND rh IS NOT NULL AS paired,
  coalesce(abs(lp + 2000000 - rp) <= 2000, lp IS NULL AND rp IS NULL) AS pts_ok,
  coalesce(abs(ld + 2000000 - rd) <= 2000, ld IS NULL AND rd IS NULL) AS dts_ok,
  lu IS NULL OR ru IS NULL OR abs(lu - ru) <= 2000 AS dur_ok,
  coalesce((ld IS NULL AND rd IS NOT NULL AND NOT lseen AND rd <= rp AND coalesce(rd >= rprev, true))
   OR (rd IS NULL AND ld IS NOT NULL AND NOT rseen AND ld <= lp AND coalesce(ld >= lprev, true)), false) AS maybe FROM w),
k AS (SELECT *, count(*) FILTER (paired AND maybe AND lh = rh AND lz = rz AND pts_ok AND dur_ok) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) AS used FROM c),
b AS (SELECT *, NOT paired OR lh <> rh OR lz <> rz OR NOT pts_ok OR NOT dur_ok OR (NOT dts_ok AND NOT (maybe AND used <= 16)) AS bad FROM k),
g AS (SELECT file_id, stream_index, count(*) FILTER (paired) AS matched, count(*) FILTER (rh IS NULL) AS missing, count(*) FILTER (lh IS NULL) AS extra,
  min(ordinal) FILTER (bad) AS first_bad, CAST(max(used) AS BIGINT) AS leading_without_dts FROM b GROUP BY ALL)
SELECT *, CASE WHEN first_bad < matched THEN 'content or timing changed' WHEN extra > 0 THEN 'extra packets' WHEN missing > 0 THEN 'missing packets' END AS reason FROM g
""")
def packet_fidelity_diff(spark, sf):
    s = v.packets(spark, sf)
    return compare.packet_fidelity_diff(
        s, _copy(spark, sf), offset_us=2_000_000, reconstruct_initial_dts=True, omit_initial_dts=True).drop("ok")


@query("locate_subsequence", """
WITH t AS (SELECT file_id, stream_index, ordinal - (40 + file_id) AS n, pts_us - 5000000 AS p, dts_us - 5000000 AS d, duration_us AS u,
  size + CASE WHEN file_id = 7 AND ordinal = 90 THEN 1 ELSE 0 END AS z, hash AS h FROM packets WHERE ordinal >= 40 + file_id),
h AS (SELECT * FROM t WHERE n = 0),
m AS (SELECT s.file_id, s.stream_index, min(s.ordinal) AS start FROM packets s JOIN h ON s.file_id = h.file_id AND s.stream_index = h.stream_index
  AND s.hash = h.h AND s.size = h.z AND coalesce(abs(s.pts_us - 5000000 - h.p) <= 2000, s.pts_us IS NULL AND h.p IS NULL)
  AND coalesce(abs(s.dts_us - 5000000 - h.d) <= 2000, s.dts_us IS NULL AND h.d IS NULL)
  AND coalesce(abs(s.duration_us - h.u) <= 2000, s.duration_us IS NULL AND h.u IS NULL) GROUP BY ALL),
j AS (SELECT t.*, m.start, coalesce(s.hash = t.h AND s.size = t.z AND coalesce(abs(s.pts_us - 5000000 - p) <= 2000, s.pts_us IS NULL AND p IS NULL)
  AND coalesce(abs(s.dts_us - 5000000 - d) <= 2000, s.dts_us IS NULL AND d IS NULL) AND coalesce(abs(s.duration_us - u) <= 2000, s.duration_us IS NULL AND u IS NULL), false) AS good,
  s.pts_us - 5000000 AS sp, s.duration_us AS su
  FROM t LEFT JOIN m USING (file_id, stream_index) LEFT JOIN packets s ON s.file_id = t.file_id AND s.stream_index = t.stream_index AND s.ordinal = m.start + t.n)
SELECT file_id, stream_index, count(*) AS packets, min(start) AS start, min(n) FILTER (NOT good) AS first_bad, max(sp) FILTER (n = 0) AS first_us,
  max(sp + su) AS end_us, count(*) FILTER (NOT good) = 0 AS ok FROM j GROUP BY file_id, stream_index
""")
def locate_subsequence(spark, sf):
    s = v.packets(spark, sf)
    o, f = F.col("ordinal"), F.col("file_id")
    t = s.where(o >= 40 + f).select(
        "file_id", "stream_index", (o - (40 + f)).alias("ordinal"), (F.col("pts_us") - 5_000_000).alias("pts_us"),
        (F.col("dts_us") - 5_000_000).alias("dts_us"), "duration_us",
        (F.col("size") + F.when((f == 7) & (o == 90), 1).otherwise(0)).alias("size"), "hash")
    return compare.locate_subsequence(s, t, shift_us=-5_000_000).drop("filler", "reason")


def _tree(rows: str, text: str, order: str = "ordinal", name: str = "digest") -> str:
    """Four digest levels of 4096, as nested SQL."""
    sql = f"SELECT file_id, stream_index, {order} AS i, {text} AS d FROM {rows}"
    for _ in range(3):
        sql = f"SELECT file_id, stream_index, i // 4096 AS i, sha256(string_agg(d, chr(10) ORDER BY i)) AS d FROM ({sql}) GROUP BY file_id, stream_index, i // 4096"
    return f"SELECT file_id, stream_index, sha256(string_agg(d, chr(10) ORDER BY i)) AS {name} FROM ({sql}) GROUP BY file_id, stream_index"


PACKET_TEXT = "concat_ws(chr(31), coalesce(pts_us::VARCHAR, 'N/A'), coalesce(dts_us::VARCHAR, 'N/A'), size::VARCHAR, flags, hash)"


@query("ordered_digest", f"""
WITH t AS ({_tree('packets', PACKET_TEXT)}),
c AS (SELECT file_id, stream_index, count(*) AS packets, count(duration_us) AS durations,
  max_by(pts_us + duration_us, ordinal) FILTER (pts_us IS NOT NULL AND duration_us IS NOT NULL) AS last_end_us FROM packets GROUP BY ALL)
SELECT * FROM t JOIN c USING (file_id, stream_index)
""")
def ordered_digest(spark, sf):
    return compare.ordered_digest(v.packets(spark, sf))


@query("digest_match", """
WITH d AS (SELECT file_id, stream_index, count(*) FILTER (event_id % 997 = 0) AS changed, count(*) AS n FROM packets GROUP BY ALL)
SELECT file_id, stream_index, n AS e_packets, n AS a_packets, CASE WHEN changed > 0 THEN 'content or timing differs' END AS reason FROM d
""")
def digest_match(spark, sf):
    p = v.packets(spark, sf, keep_id=True)
    changed = p.withColumn("size", F.col("size") + F.when(F.col("event_id") % 997 == 0, 1).otherwise(0))
    m = compare.digest_match(compare.ordered_digest(p), compare.ordered_digest(changed))
    return m.select("file_id", "stream_index", "e_packets", "a_packets", "reason")


@query("clock_digest", f"""
WITH l AS (SELECT *, coalesce(t_us - lag(t_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal), 0) AS step,
  lag(t_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) AS prev FROM frames),
t AS ({_tree('l', 'step::VARCHAR')}),
c AS (SELECT file_id, stream_index, count(*) AS frames, min(t_us) FILTER (ordinal = 0) AS origin_ticks, count(*) FILTER (t_us <= prev) = 0 AS ok FROM l GROUP BY ALL)
SELECT * FROM t JOIN c USING (file_id, stream_index)
""")
def clock_digest(spark, sf):
    return compare.clock_digest(v.frames(spark, sf), tick="t_us").drop("first_bad", "reason")


@query("clock_digest_audio", f"""
WITH l AS (SELECT *, 1024 + ordinal % 7 AS samples, coalesce(t_us - lag(t_us) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal), 0) AS step FROM frames),
t AS ({_tree('l', 'concat_ws(chr(31), step::VARCHAR, samples::VARCHAR)')}),
c AS (SELECT file_id, stream_index, count(*) AS frames, CAST(sum(samples) AS BIGINT) AS samples FROM l GROUP BY ALL)
SELECT * FROM t JOIN c USING (file_id, stream_index)
""")
def clock_digest_audio(spark, sf):
    f = v.frames(spark, sf).withColumn("samples", 1024 + F.col("ordinal") % 7)
    return compare.clock_digest(f, tick="t_us", samples="samples").select("file_id", "stream_index", "digest", "frames", "samples")


RUNS = """
l AS (SELECT file_id, stream_index, ordinal, CASE WHEN lag(hash) OVER w = hash THEN 0 ELSE 1 END AS fresh,
  CASE WHEN ordinal > 0 AND t_us <> lag(t_us) OVER w + 41708 THEN ordinal END AS gap FROM frames WINDOW w AS (PARTITION BY file_id, stream_index ORDER BY ordinal)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id, stream_index ORDER BY ordinal) AS run FROM l),
n AS (SELECT file_id, stream_index, run, count(*) AS len FROM r GROUP BY ALL),
p AS (SELECT *, lag(len) OVER (PARTITION BY file_id, stream_index ORDER BY run) AS prev_len FROM n),
g AS (SELECT file_id, stream_index, min(gap) AS first_gap FROM l GROUP BY ALL),
profile AS (SELECT file_id, stream_index, CAST(sum(len) AS BIGINT) AS frames, count(*) AS "unique", CAST(sum(len) AS BIGINT) - count(*) AS duplicates,
  count(*) FILTER (len > 1) AS repeated_runs, min(len) AS min_run, max(len) AS max_run,
  array_to_string(list_sort(list_distinct(list(len))), ',') AS run_lengths, count(*) FILTER (prev_len <> len) AS length_changes FROM p GROUP BY ALL)
"""


@query("duplicate_run_profile", f"""WITH {RUNS}
SELECT *, first_gap IS NULL AS ok FROM profile JOIN g USING (file_id, stream_index)""")
def duplicate_run_profile(spark, sf):
    p = compare.duplicate_run_profile(v.frames(spark, sf))
    return p.withColumn("run_lengths", F.array_join(F.col("run_lengths").cast("array<string>"), ",")).drop("reason", "bad_hashes")


@query("padded_capture_guard", f"""WITH {RUNS}
SELECT file_id, stream_index, frames, duplicates, max_run, frames = (frames // 2) * 2 AND frames >= 8 AND "unique" >= 4 AND duplicates >= 2
  AND repeated_runs >= 2 AND max_run <= 8 AND duplicates * 5 <= frames * 4 AS guarded FROM profile
""")
def padded_capture_guard(spark, sf):
    p = compare.duplicate_run_profile(v.frames(spark, sf)).withColumn("expected_frames", F.expr("(frames div 2) * 2"))
    return compare.padded_capture_guard(p).select("file_id", "stream_index", "frames", "duplicates", "max_run", "guarded")


def _requests(spark, sf):
    """A request per purchase, at its time rounded down to ten minutes."""
    p = v.events(spark, sf).where("event_type = 'purchase'")
    return p.select((F.col("user_id") % 10).alias("file_id"), F.expr("(user_id div 10) % 3").alias("stream_index"),
                    F.col("event_id").alias("request_id"), F.expr("t_us div 600000000 * 600000000").alias("t_us"))


REQUESTS = """
asks AS (SELECT user_id % 10 AS file_id, (user_id // 10) % 3 AS stream_index, event_id AS request_id, t_us // 600000000 * 600000000 AS t_us FROM ev WHERE event_type = 'purchase'),
marks AS (SELECT file_id, stream_index, pts_us AS k FROM packets WHERE is_key AND pts_us >= 0)
"""


@query("snap_to_keyframe", f"""WITH {REQUESTS}
SELECT a.file_id, a.stream_index, a.request_id, a.t_us, m.k AS keyframe_us FROM
  (SELECT *, t_us + 1 AS at FROM asks) a ASOF LEFT JOIN marks m ON a.file_id = m.file_id AND a.stream_index = m.stream_index AND a.at >= m.k
""")
def snap_to_keyframe(spark, sf):
    keys = v.packets(spark, sf).where("is_key and pts_us is not null")
    return compare.snap_to_keyframe(_requests(spark, sf), keys, key_t="pts_us", block_us=86_400_000_000)


@query("snap_to_keyframe_minimum", f"""WITH {REQUESTS},
s AS (SELECT a.*, m.k FROM (SELECT *, t_us + 2000 AS at, t_us - (request_id % 5) * 3600000000 AS lo FROM asks) a
  ASOF LEFT JOIN marks m ON a.file_id = m.file_id AND a.stream_index = m.stream_index AND a.at >= m.k)
SELECT file_id, stream_index, request_id, t_us, coalesce(CASE WHEN k >= lo - 2000 THEN k END, CASE WHEN t_us <= lo + 2000 THEN lo END) AS keyframe_us FROM s
""")
def snap_to_keyframe_minimum(spark, sf):
    keys = v.packets(spark, sf).where("is_key and pts_us is not null")
    asks = _requests(spark, sf).withColumn("lo", F.col("t_us") - (F.col("request_id") % 5) * 3_600_000_000)
    return compare.snap_to_keyframe(asks, keys, key_t="pts_us", minimum="lo", tolerance_us=2000, block_us=86_400_000_000)
