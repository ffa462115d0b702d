"""Registered queries: stream headers and packet listings."""

from pyspark.sql import functions as F

from reeltally.operators import headers
from reeltally.queries import stand_ins as v
from reeltally.queries.catalog import STREAMS, streams
from reeltally.queries.registry import query


@query("planned_streams_check", f"""WITH {STREAMS},
x AS (SELECT *, file_id % 6 = 1 AND stream_index = 0 AS chapter, row_number() OVER (PARTITION BY file_id ORDER BY stream_index) - 1 - CASE WHEN file_id % 6 = 1 THEN 1 ELSE 0 END AS place FROM st),
f AS (SELECT file_id, place, kind, CASE WHEN kind = 'video' AND file_id % 8 = 3 THEN 'unknown' ELSE 'c' END AS codec FROM x WHERE NOT chapter),
p AS (SELECT o_orderkey AS file_id, CAST(i AS BIGINT) AS place, CASE i WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS kind FROM orders, range(3) t(i)),
j AS (SELECT coalesce(p.file_id, f.file_id) AS file_id, coalesce(p.place, f.place) AS place, p.kind, f.kind AS actual, codec FROM p FULL JOIN f ON p.file_id = f.file_id AND p.place = f.place),
g AS (SELECT file_id, count(kind) AS planned, count(actual) AS found, min(place) FILTER (kind IS DISTINCT FROM actual) AS first_difference,
  count(*) FILTER (kind = 'video' AND (codec IS NULL OR codec = 'unknown' OR actual <> 'video')) AS blind FROM j GROUP BY file_id)
SELECT file_id, planned, found, first_difference, CASE WHEN first_difference IS NOT NULL THEN 'streams differ from the plan' WHEN blind > 0 THEN 'no readable video header' END AS reason FROM g""")
def planned_streams_check(spark, sf):
    s = streams(spark, sf)
    k, i = F.col("file_id"), F.col("stream_index")
    s = s.withColumn("codec", F.when((F.col("kind") == "video") & (k % 8 == 3), "unknown").otherwise(F.col("codec"))).withColumn("chapter_track", (k % 6 == 1) & (i == 0))
    kinds = F.posexplode(F.array(F.lit("video"), F.lit("audio"), F.lit("subtitle"))).alias("position", "kind")
    plan = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), kinds)
    return headers.planned_streams_check(s, plan).drop("ok")


LISTING = """
l AS (SELECT file_id, stream_index, ordinal, CASE WHEN file_id % 3 = 0 AND event_id % 997 = 3 THEN NULL ELSE coalesce(pts_us, dts_us) END AS t,
  CASE WHEN file_id % 3 = 1 AND stream_index = 1 AND event_id % 701 = 2 THEN '_D' WHEN ordinal % 12 = 0 AND NOT (file_id = 4 AND stream_index = 2 AND ordinal = 0) THEN 'K_' ELSE '__' END AS flags FROM packets),
c AS (SELECT *, CASE WHEN t IS NULL THEN 'no presentation time' WHEN flags LIKE '%D%' THEN 'discarded or corrupt' WHEN ordinal = 0 AND flags NOT LIKE '%K%' THEN 'first packet is not a keyframe' END AS why FROM l),
verdict AS (SELECT file_id, stream_index, count(*) AS packets, bool_or(flags LIKE '%D%') AS discarded, min(ordinal) FILTER (why IS NOT NULL) AS first_bad,
  arg_min(why, ordinal) FILTER (why IS NOT NULL) AS reason FROM c GROUP BY ALL)
"""


def _listing(spark, sf):
    i, f = F.col("event_id"), F.col("file_id")
    first = (f == 4) & (F.col("stream_index") == 2) & (F.col("ordinal") == 0)
    flags = F.when((f % 3 == 1) & (F.col("stream_index") == 1) & (i % 701 == 2), "_D").when((F.col("ordinal") % 12 == 0) & ~first, "K_").otherwise("__")
    t = F.when(~((f % 3 == 0) & (i % 997 == 3)), F.coalesce("pts_us", "dts_us"))
    return v.packets(spark, sf, keep_id=True).select("file_id", "stream_index", "ordinal", t.alias("pts_us"), flags.alias("flags"))


@query("packet_frame_verdict", f"WITH {LISTING} SELECT * FROM verdict")
def packet_frame_verdict(spark, sf):
    return headers.packet_frame_plan(_listing(spark, sf))[1].drop("ok")


@query("packet_frame_plan", f"""WITH {LISTING}
SELECT file_id, stream_index, row_number() OVER (PARTITION BY file_id, stream_index ORDER BY t, ordinal) - 1 AS frame, ordinal, t AS pts_us
FROM l JOIN verdict USING (file_id, stream_index) WHERE reason IS NULL""")
def packet_frame_plan(spark, sf):
    return headers.packet_frame_plan(_listing(spark, sf))[0]


@query("display_transform", """
WITH m AS (SELECT o_orderkey AS id, [1, 0, -1, 0, -1, 1, 0, 0][o_orderkey % 8 + 1] AS a, [0, -1, 0, 1, 0, 0, 1, -1][o_orderkey % 8 + 1] AS b,
  [0, 1, 0, -1, 0, 0, 1, -1][o_orderkey % 8 + 1] AS d, [1, 0, -1, 0, 1, -1, 0, 0][o_orderkey % 8 + 1] AS e,
  o_orderkey % 11 = 5 OR o_orderkey % 13 = 7 AS damaged FROM orders)
SELECT id, CASE WHEN NOT damaged THEN [0, 90, 180, 270, 0, 180, 90, 270][id % 8 + 1]::BIGINT END AS degrees, CASE WHEN NOT damaged THEN a * e - b * d < 0 END AS mirrored,
  CASE WHEN NOT damaged THEN a = 0 END AS swaps_axes FROM m""")
def display_transform(spark, sf):
    """Matrices of the eight classes from the order number; some are sheared or cut short."""
    k = F.col("o_orderkey")
    pick = lambda *xs: (F.get(F.array(*[F.lit(x) for x in xs]), (k % 8).cast("int")) * headers.MATRIX_UNIT).cast("string")
    a, b, d, e = pick(1, 0, -1, 0, -1, 1, 0, 0), pick(0, -1, 0, 1, 0, 0, 1, -1), pick(0, 1, 0, -1, 0, 0, 1, -1), pick(1, 0, -1, 0, 1, -1, 0, 0)
    shear = F.when(k % 11 == 5, "7").otherwise("0")
    top, middle = F.concat(F.lit("\n00000000: "), a, F.lit(" "), b, F.lit(" "), shear), F.concat(F.lit("00000001: "), d, F.lit(" "), e, F.lit(" 0"))
    bottom = F.when(k % 13 != 7, F.concat(F.lit("00000002: "), (k % 1000 * 65536).cast("string"), F.lit(f" -65536 {headers.MATRIX_LAST}\n"))).otherwise("")
    out = v.table(spark, sf, "orders").select(k.alias("id"), headers.display_transform(F.concat_ws("\n", top, middle, bottom)).alias("x"))
    return out.select("id", "x.degrees", "x.mirrored", "x.swaps_axes")
