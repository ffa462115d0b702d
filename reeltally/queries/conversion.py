"""Registered queries: checks after a conversion."""

from pyspark.sql import functions as F

from reeltally.operators import conversion
from reeltally.queries import stand_ins as v
from reeltally.queries.cues import CUES, cue_rows
from reeltally.queries.registry import query

@query("cue_text_check", f"""WITH {CUES},
c AS (SELECT file_id, n, file_id % 9 = 4 AND n = 0 AS gone, file_id % 13 = 6 AND n = 1 AS odd, n % 7 = 3 AND file_id % 3 = 0 AND file_id % 2 = 0 AS moved,
  n % 11 = 5 AND file_id % 5 = 1 AS other FROM cues),
b AS (SELECT *, NOT gone AND (odd OR moved OR other) AS bad FROM c),
g AS (SELECT file_id, count(*) AS source_cues, count(*) FILTER (NOT gone) AS target_cues, count(*) FILTER (bad AND odd AND NOT moved) AS unreadable,
  count(*) FILTER (bad AND (moved OR NOT odd)) AS changed, min(n) FILTER (bad) AS first_bad, arg_min(moved OR NOT odd, n) FILTER (bad) AS plain FROM b GROUP BY file_id)
SELECT file_id, source_cues, target_cues, unreadable, changed, first_bad, CASE WHEN source_cues <> target_cues THEN 'cue count changed' WHEN plain THEN 'readable text, order or timing changed'
  WHEN first_bad IS NOT NULL THEN 'markup has no certain readable text' END AS reason FROM g""")
def cue_text_check(spark, sf):
    """Cues with markup of three formats, some moved, changed, lost or with unknown markup."""
    c = cue_rows(spark, sf).select("file_id", "n", "start_ms", "end_ms", F.regexp_replace("body", "[<>&{}\\\\\\\\]", "_").alias("body"))
    f, n = F.col("file_id"), F.col("n")
    number = n.cast("string")
    odd = F.when((f % 13 == 6) & (n == 1), "<weird>").otherwise("")
    source = c.withColumn("format", F.lit("srt")).withColumn("body", F.concat(F.lit("<i>"), "body", F.lit("</i> &amp; "), number, odd))
    ass = f % 2 == 1
    body = F.concat("body", F.when((n % 11 == 5) & (f % 5 == 1), "!").otherwise(""))
    marked = F.when(ass, F.concat(F.lit("{\\i1}"), body, F.lit("{\\i0} & "), number)).otherwise(F.concat(F.lit("<c.x>"), body, F.lit("</c> &#38; "), number))
    target = c.where(~((f % 9 == 4) & (n == 0))).withColumn("format", F.when(ass, "ass").otherwise("webvtt")).withColumn("body", marked)
    target = target.withColumn("start_ms", F.col("start_ms") + F.when((n % 7 == 3) & (f % 3 == 0), 5).otherwise(0))
    return conversion.cue_text_check(source, target).drop("ok")


HEAD = "010160000000900000000000" + "1EF000FCFDF8F800000F"  # 22 bytes in front of the number of arrays


@query("codec_config_match", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unreadable configuration' WHEN o_orderkey % 5 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) THEN 'configuration differs' END AS reason FROM orders""")
def codec_config_match(spark, sf):
    """Configuration records of three arrays, dumped as sixteen bytes a line; some change a bit, a unit or an offset."""
    k = F.col("o_orderkey")

    def record(complete, delta):
        parts = [F.lit(HEAD + "03")]
        for j in range(3):
            kind = F.when(complete, F.lit(f"{0xA0 + j:02X}")).otherwise(F.lit(f"{0x20 + j:02X}"))
            parts += [kind, F.lit("00010004"), F.lpad(F.hex(k * 3 + j + (delta if j == 2 else 0)), 8, "0")]
        return F.concat(*parts)

    def dump(digits, first):
        def line(i):
            offset = F.lpad(F.hex((i + F.when(i == 0, first).otherwise(0)) * 16), 8, "0")
            groups = F.regexp_replace(F.substring(digits, i * 32 + 1, F.lit(32)), "(.{4})", "$1 ")
            return F.concat(F.lower(offset), F.lit(": "), F.rpad(groups, 41, " "), F.lit("................\n"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), ((F.length(digits) - 1) / 32).cast("long")), line), "")

    source = record(F.lit(False), F.lit(0))
    output = record(k % 3 == 0, F.when(k % 5 == 0, 1).otherwise(0))
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 1, "hevc").otherwise("h264").alias("codec"), source.alias("s"), output.alias("o"))
    rows = rows.select("o_orderkey", "codec", dump(F.col("s"), F.lit(0)).alias("source_dump"), dump(F.col("o"), F.when(k % 11 == 0, 1).otherwise(0)).alias("output_dump"))
    return conversion.codec_config_match(rows).select("o_orderkey", "reason")


@query("timecode_check", """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 4 THEN 'no valid rate' WHEN c_custkey % 4 = 3 THEN 'rate differs' WHEN c_custkey % 7 = 5 THEN 'no duration' WHEN c_custkey % 5 = 2 THEN 'duration differs' END AS reason FROM customer""")
def timecode_check(spark, sf):
    k = F.col("c_custkey")
    rates = F.array(*[F.lit(x) for x in ("24000/1001", "25/1", "48000/2002", "30/1")])
    film = k % 2 == 0
    num, den = F.when(film, 24000).when(k % 4 == 1, 25).otherwise(24).cast("long"), F.when(film, 1001).otherwise(1).cast("long")
    seconds = k * den / num + F.when(k % 5 == 2, 1.0).otherwise(0.04)
    tracks = v.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 6 == 4, "24").otherwise(F.element_at(rates, (k % 4 + 1).cast("int"))).alias("rate"),
        F.when(k % 7 == 5, "N/A").otherwise(F.format_string("%.6f", seconds)).alias("duration"), num.alias("rate_num"), den.alias("rate_den"), k.alias("frames"))
    return conversion.timecode_check(tracks).select("c_custkey", "reason")
