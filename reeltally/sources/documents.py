"""Whole-document sources: probe JSON, cues, scenes, history, loudness, dynamic metadata, chunk progress.

``parse_*`` takes ``path, value`` (optionally ``file_id``), one document per row, and returns
``(rows, ..., quarantine)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.plans.verdicts import reason
from reeltally.sources.lines import judged, with_file_id

PROBE_SCHEMA = """
format struct<duration:string, start_time:string, format_name:string, bit_rate:string, tags:map<string,string>>,
streams array<struct<index:bigint, codec_type:string, codec_name:string, codec_tag_string:string, codec_long_name:string, profile:string,
  bit_rate:string, duration:string, start_time:string, time_base:string, avg_frame_rate:string, r_frame_rate:string, width:bigint, height:bigint,
  sample_aspect_ratio:string, display_aspect_ratio:string, field_order:string, sample_rate:string, channels:bigint,
  channel_layout:string, pix_fmt:string, bits_per_raw_sample:string, color_primaries:string, color_transfer:string,
  color_space:string, color_range:string, chroma_location:string, nb_frames:string, nb_read_packets:string, extradata_hash:string,
  extradata_size:bigint, disposition:map<string,string>, tags:map<string,string>, side_data_list:array<map<string,string>>>>,
chapters array<struct<start_time:string, end_time:string, tags:map<string,string>>>,
_corrupt string
"""
# 8-bit pixel formats, and depths that a planar format name may end in.
EIGHT_BIT = (
    "yuv420p", "yuv422p", "yuv444p", "yuvj420p", "yuvj422p", "yuvj444p", "nv12", "nv21", "gray", "rgb24", "bgr24", "bgr0", "rgba", "bgra",
)
NAMED_DEPTHS = {
    "rgb48le": 16, "rgb48be": 16, "rgba64le": 16, "rgba64be": 16, "p010le": 10, "p010be": 10, "p012le": 12, "p012be": 12, "p016le": 16, "p016be": 16,
}
PLANAR_DEPTHS = (9, 10, 12, 14, 16)
TRANSFER_CLASS = {"smpte2084": "HDR / PQ", "arib-std-b67": "HDR / HLG"}
DOLBY_RECORD = "DOVI configuration record"


def _positive_int(text: Column) -> Column:
    n = X.unsigned(text)
    return F.when(n > 0, n)


def _nonnegative(text: Column) -> Column:
    n = X.finite(text, None)
    return F.when(n >= 0, n)


def pixel_depth(fmt: Column) -> Column:
    """Bit depth from a pixel format name, for known families only."""
    out = F.when(fmt.isin(*EIGHT_BIT), 8)
    planar = fmt.rlike("^(yuv|gbr|gray)")
    depth = F.lit(None).cast("int")
    for d in reversed(PLANAR_DEPTHS):
        depth = F.when(fmt.rlike(f"{d}(le|be)$"), d).otherwise(depth)
    out = out.when(planar, depth)
    for name, d in NAMED_DEPTHS.items():
        out = out.when(fmt == name, d)
    return out.cast("long")


def _hdr(side: Column) -> tuple[Column, Column, Column]:
    """Static flag, dynamic formats in first-seen order and the one Dolby profile."""
    kind = lambda m: F.lower(F.coalesce(F.try_element_at(m, F.lit("side_data_type")), F.lit("")))
    static = F.exists(side, lambda m: kind(m).contains("mastering display") | kind(m).contains("content light level"))
    dolby = lambda m: kind(m).contains("dovi") | kind(m).contains("dolby vision")
    plus = lambda m: kind(m).contains("hdr10+") | kind(m).contains("smpte2094-40") | kind(m).contains("smpte 2094-40")
    named = F.transform(side, lambda m: F.when(dolby(m), "Dolby Vision").when(plus(m), "HDR10+"))
    dynamic = F.array_distinct(F.array_compact(named))
    records = F.filter(side, lambda m: F.try_element_at(m, F.lit("side_data_type")) == DOLBY_RECORD)
    profiles = F.array_distinct(F.array_compact(F.transform(records, lambda m: X.unsigned(F.try_element_at(m, F.lit("dv_profile"))))))
    profile = F.when((F.size(profiles) == 1) & (profiles[0].between(1, 255)), profiles[0])
    return static, dynamic, profile


def parse_probe_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Probe JSON to ``(files, streams, chapters, quarantine)``.

    Extra columns of ``documents`` (``size_bytes``, ``modified_at``) are kept on ``files``.
    """
    extra = [c for c in documents.columns if c not in ("value", "path", "file_id")]
    d = with_file_id(documents).withColumn("doc", F.from_json("value", PROBE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}))
    why = reason(
        (F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "unreadable document"),
        (F.exists(F.coalesce("doc.streams", F.array()), lambda s: s["index"].isNull()), "stream without index"),
    )
    rows = judged(d, why)
    bad = rows.where(F.col("__reason").isNotNull()).select("file_id", "path", "value", F.col("__reason").alias("reason"))
    good = rows.where(F.col("__reason").isNull())
    own = lambda s: F.coalesce(_nonnegative(s["duration"]), X.tag_clock(X.tag(s["tags"], "duration")))
    streams_max = F.array_max(F.transform(F.coalesce("doc.streams", F.array()), own))
    duration = F.coalesce(_nonnegative(F.col("doc.format.duration")), streams_max)
    files = good.select(
        "file_id", "path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("name"), *extra,
        duration.alias("duration_s"), X.nonblank(F.col("doc.format.format_name")).alias("format"),
        X.tag(F.col("doc.format.tags"), "title").alias("title"), X.tag(F.col("doc.format.tags"), "language").alias("language"),
        _positive_int(F.col("doc.format.bit_rate")).alias("bit_rate"), F.col("doc.format.tags").alias("tags"),
    )
    s = F.col("s")
    e = d.select("file_id", F.posexplode(F.when(why.isNull(), F.col("doc.streams"))).alias("position", "s"))
    transfer = X.known_colour(s["color_transfer"])
    hdr = F.lit(None).cast("string")
    for k, name in TRANSFER_CLASS.items():
        hdr = F.when(transfer == k, name).otherwise(hdr)
    side = F.coalesce(s["side_data_list"], F.array().cast("array<map<string,string>>"))
    static, dynamic, profile = _hdr(side)
    video = s["codec_type"] == "video"
    raw_depth = _positive_int(s["bits_per_raw_sample"])
    flag = s["disposition"]["default"]
    handler = X.once(X.tag(s["tags"], "handler_name"), lambda h: F.when(~h.isin(*X.GENERIC_HANDLERS), h))
    title = F.coalesce(X.tag(s["tags"], "title"), X.tag(s["tags"], "name"), handler)
    aspect = lambda c: F.when(X.rational(c, ":").isNotNull(), c)
    avg, nominal = X.rational(s["avg_frame_rate"]), X.rational(s["r_frame_rate"])
    turned = F.array_compact(F.transform(side, lambda m: X.finite(F.try_element_at(m, F.lit("rotation")), None)))
    streams = e.select(
        "file_id", s["index"].alias("stream_index"), F.col("position").cast("long").alias("position"),
        F.coalesce(X.nonblank(s["codec_type"]), F.lit("unknown")).alias("kind"), X.nonblank(s["codec_name"]).alias("codec"),
        X.nonblank(s["codec_tag_string"]).alias("codec_tag"), X.known_colour(s["profile"]).alias("profile"), _positive_int(s["bit_rate"]).alias("bit_rate"),
        X.finite(s["start_time"], None).alias("start_s"), own(s).alias("duration_s"), avg.alias("avg_rate"), nominal.alias("nominal_rate"),
        F.coalesce(avg, nominal).alias("frame_rate"), X.rational(s["time_base"]).alias("time_base"), s["width"].alias("width"), s["height"].alias("height"),
        aspect(s["sample_aspect_ratio"]).alias("sample_aspect_ratio"), aspect(s["display_aspect_ratio"]).alias("display_aspect_ratio"),
        F.coalesce(F.get(turned, F.lit(0)), X.finite(X.tag(s["tags"], "rotate"), None)).alias("rotation"),
        X.nonblank(s["field_order"]).alias("field_order"), _positive_int(s["sample_rate"]).alias("sample_rate"), s["channels"].alias("channels"),
        X.nonblank(s["channel_layout"]).alias("channel_layout"), X.nonblank(s["pix_fmt"]).alias("pixel_format"),
        F.coalesce(F.when(raw_depth <= 64, raw_depth), pixel_depth(s["pix_fmt"])).alias("bit_depth"),
        X.known_colour(s["color_primaries"]).alias("color_primaries"), transfer.alias("color_transfer"), X.known_colour(s["color_space"]).alias("color_space"),
        X.known_colour(s["color_range"]).alias("color_range"), X.known_colour(s["chroma_location"]).alias("chroma_location"), hdr.alias("hdr_format"),
        F.when(video, static).alias("has_static_hdr"), F.when(video, dynamic).alias("dynamic_hdr"), F.when(video, profile).alias("dolby_profile"),
        F.when(flag.isin("1", "true"), True).when(flag.isin("0", "false"), False).alias("is_default"),
        F.coalesce(s["disposition"]["attached_pic"].isin("1", "true"), F.lit(False)).alias("attached_pic"),
        X.tag(s["tags"], "language").alias("language"), title.alias("title"), X.tag(s["tags"], "filename").alias("attachment_name"),
        X.tag(s["tags"], "mimetype").alias("attachment_type"), s["nb_frames"].alias("nb_frames"), X.unsigned(s["nb_read_packets"]).alias("packet_count"),
        s["extradata_hash"].alias("extradata_hash"), s["extradata_size"].alias("extradata_size"), s["tags"].alias("tags"), s["disposition"].alias("disposition"),
    )
    chapters = good.select("file_id", F.posexplode("doc.chapters").alias("position", "c")).select(
        "file_id", F.col("position").cast("long").alias("position"), X.seconds_us(F.col("c.start_time")).alias("start_us"),
        X.seconds_us(F.col("c.end_time")).alias("end_us"), F.col("c.tags").alias("tags"),
    )
    return files, streams, chapters, bad


def parse_cue_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRT, WebVTT and ASS documents to cues.  ``documents`` also carries ``format`` (srt, webvtt or ass).

    One unusable block, time or interval rejects its whole document.
    """
    d = with_file_id(documents).withColumn("__t", F.replace("value", F.lit("\r\n"), F.lit("\n")))
    is_ass = F.col("format") == "ass"
    blocks = F.filter(F.split("__t", "\n\n"), lambda b: X.strip(b) != "")
    timing = r"(?:^|\n)([^\n]*?) --> ([^\n]*)"
    heading = lambda b: (F.col("format") == "webvtt") & b.startswith("WEBVTT") & ~b.contains(" --> ")
    kept = F.filter(blocks, lambda b: ~heading(b))

    def text_cue(b: Column) -> Column:
        tail = F.regexp_extract(b, timing, 2)
        body = F.regexp_extract(b, r"(?s)(?:^|\n)[^\n]*? --> [^\n]*\n?(.*)$", 1)
        return F.struct(
            X.cue_clock(F.regexp_extract(b, timing, 1)).alias("start"), X.cue_clock(F.regexp_extract(tail, r"^([^ ]*)", 1)).alias("end"),
            F.regexp_replace(body, r"\n+$", "").alias("body"), F.array().cast("array<string>").alias("fields"),
            F.regexp_extract(tail, r"^[^ ]* (.*)$", 1).alias("settings"), b.contains(" --> ").alias("shaped"),
        )

    lines = F.split("__t", "\n")
    events = F.filter(lines, lambda x: x.startswith("Dialogue: "))

    def ass_cue(x: Column) -> Column:
        f = F.split(X.tail(x, 11), ",", 10)
        return F.struct(
            X.cue_clock(F.get(f, F.lit(1))).alias("start"), X.cue_clock(F.get(f, F.lit(2))).alias("end"), F.coalesce(F.get(f, F.lit(9)), F.lit("")).alias("body"),
            f.alias("fields"), F.lit("").alias("settings"), (F.size(f) == 10).alias("shaped"),
        )

    cues = F.when(is_ass, F.transform(events, ass_cue)).otherwise(F.transform(kept, text_cue))
    before_events = F.regexp_extract("__t", r"(?s)^(.*?)(?:^|\n)\s*\[Events\]\s*(?:\n|$)", 1)
    has_events = F.col("__t").rlike(r"(?:^|\n)\s*\[Events\]\s*(?:\n|$)")
    fields_line = F.regexp_extract("__t", r"(?s)\[Events\].*?(?:^|\n)(Format:[^\n]*)", 1)
    standard = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
    d = d.withColumn("__cues", cues)
    any_cue = lambda test: F.exists("__cues", test)
    why = reason(
        (is_ass & ~has_events, "no events section"),
        (is_ass & (before_events.startswith("Dialogue: ") | before_events.contains("\nDialogue: ")), "event before the events section"),
        (is_ass & (fields_line != "") & (X.strip(fields_line) != standard), "unusual event field order"),
        (any_cue(lambda c: ~c["shaped"]), "unsupported block"),
        (any_cue(lambda c: c["start"].isNull() | c["end"].isNull()), "invalid timestamp"),
        (any_cue(lambda c: c["end"] <= c["start"]), "empty or reversed interval"),
    )
    d = judged(d, why)
    ms = lambda c: F.round(c * 1000.0).cast("long")
    rows = d.where(F.col("__reason").isNull()).select("file_id", "format", F.posexplode("__cues").alias("n", "c")).select(
        "file_id", F.col("n").cast("long").alias("n"), "format", ms(F.col("c.start")).alias("start_ms"), ms(F.col("c.end")).alias("end_ms"),
        F.col("c.body").alias("body"), F.col("c.fields").alias("fields"), F.col("c.settings").alias("settings"),
    )
    return rows, d.where(F.col("__reason").isNotNull()).select("file_id", "path", "value", F.col("__reason").alias("reason"))


def parse_scene_slices(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slice JSON to ``(slices, scenes, quarantine)``; ``documents`` also carries ``slice``."""
    scene = "array<struct<start_frame:bigint, end_frame:bigint>>"
    d = with_file_id(documents).withColumn("doc", F.from_json("value", f"frames bigint, scenes {scene}, split_scenes {scene}"))
    why = reason(
        (F.col("doc.frames").isNull(), "no frame count"),
        (F.coalesce(F.size("doc.scenes"), F.lit(0)) <= 0, "no scenes"),
        (F.exists("doc.scenes", lambda s: s["start_frame"].isNull() | s["end_frame"].isNull()), "invalid scene"),
    )
    d = judged(d, why)
    good = d.where(F.col("__reason").isNull())
    slices = good.select("file_id", "slice", F.col("doc.frames").alias("frames"), F.col("doc.split_scenes").isNotNull().alias("has_split"))
    part = lambda name: good.select("file_id", "slice", F.lit(name).alias("list"), F.posexplode(f"doc.{name}").alias("n", "s"))
    scenes = part("scenes").unionByName(part("split_scenes")).select(
        "file_id", "slice", "list", F.col("n").cast("long").alias("n"), F.col("s.start_frame").alias("start_frame"), F.col("s.end_frame").alias("end_frame")
    )
    return slices, scenes, d.where(F.col("__reason").isNotNull()).select("file_id", "path", "value", F.col("__reason").alias("reason"))


def parse_job_history(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versioned history documents to ``(jobs, job_logs, quarantine)``: version 1, ids non-empty and unique."""
    schema = (
        "version int, jobs array<struct<id:string, state:string, backend:string, progressSeconds:double, durationSeconds:double, "
        "inputBytes:string, outputBytes:string, errorCode:string, lastRunAt:bigint, logs:array<string>>>"
    )
    d = documents.withColumn("doc", F.from_json("value", schema))
    ids = F.transform("doc.jobs", lambda j: j["id"])
    why = reason(
        (F.col("doc.version").isNull() | F.col("doc.jobs").isNull(), "unreadable document"),
        (F.col("doc.version") != 1, "unsupported version"),
        (F.exists(ids, lambda i: i.isNull() | (i == "")), "empty job id"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "repeated job id"),
    )
    d = judged(d, why)
    j = d.where(F.col("__reason").isNull()).select("path", F.explode("doc.jobs").alias("j"))
    jobs = j.select(
        "path", F.col("j.id").alias("job_id"), F.col("j.state").alias("state"), F.col("j.backend").alias("backend"), F.col("j.progressSeconds").alias("progress_s"),
        F.col("j.durationSeconds").alias("duration_s"), X.unsigned(F.col("j.inputBytes")).alias("input_bytes"), X.unsigned(F.col("j.outputBytes")).alias("output_bytes"),
        F.col("j.errorCode").alias("error_code"), F.col("j.lastRunAt").alias("last_run_us"),
    )
    logs = j.select("path", F.col("j.id").alias("job_id"), F.posexplode("j.logs").alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    return jobs, logs, d.where(F.col("__reason").isNotNull()).select("path", "value", F.col("__reason").alias("reason"))


def parse_loudness_reports(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last JSON object of each log: integrated loudness, true peak and range; ``-inf`` is null."""
    last = F.regexp_extract("value", r"(?s)^.*(\{[^}]*\})", 1)
    d = with_file_id(documents).withColumn("__j", F.from_json(last, "input_i string, input_tp string, input_lra string"))
    d = d.withColumn("__found", last != "")
    num = lambda c: X.finite(F.col(f"__j.{c}"), 200.0)
    broken = lambda c: F.col(f"__j.{c}").isNull() | ((F.col(f"__j.{c}") != "-inf") & num(c).isNull())
    why = reason(
        (~F.col("__found"), "no measurements"),
        (broken("input_i") | broken("input_tp") | broken("input_lra"), "invalid measurement"),
        (num("input_lra") < 0, "negative loudness range"),
    )
    d = judged(d, why)
    rows = d.where(F.col("__reason").isNull()).select(
        "file_id", *(["stream_index"] if "stream_index" in documents.columns else []), num("input_i").alias("integrated"), num("input_tp").alias("peak"), num("input_lra").alias("lra")
    )
    return rows, d.where(F.col("__reason").isNotNull()).select("file_id", "path", "value", F.col("__reason").alias("reason"))


SCENE_FIELDS = "SequenceFrameIndex bigint, NumberOfWindows bigint, SceneId bigint"


def _scene_rows(d: DataFrame) -> DataFrame:
    """Rows of scene records ``r`` at ``frame``."""
    return d.select("file_id", F.col("frame").cast("long").alias("frame"), F.col("r.SceneId").alias("scene_id"), F.sha2(F.to_json("r"), 256).alias("hash"))


def parse_dynamic_metadata(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-frame dynamic HDR JSON: one record per frame in order, one window each.

    ``documents`` also carries ``frames``, the expected count.
    """
    d = with_file_id(documents).withColumn("__r", F.from_json("value", f"SceneInfo array<struct<{SCENE_FIELDS}>>")["SceneInfo"])
    bad_at = F.exists(
        F.transform("__r", lambda x, i: F.coalesce((x["SequenceFrameIndex"] == i) & (x["NumberOfWindows"] == 1), F.lit(False))), lambda ok: ~ok
    )
    why = reason(
        (F.col("__r").isNull(), "unreadable document"),
        (F.size("__r") != F.col("frames"), "record count differs"),
        (bad_at, "invalid frame index or windows"),
    )
    d = judged(d, why)
    rows = _scene_rows(d.where(F.col("__reason").isNull()).select("file_id", F.posexplode("__r").alias("frame", "r")))
    return rows, d.where(F.col("__reason").isNotNull()).select("file_id", "path", "value", F.col("__reason").alias("reason"))


def judge_scene_count(context: DataFrame):
    """Documents must hold as many records as ``context`` expects ``frames`` of their ``path``."""

    def judge(documents: DataFrame) -> DataFrame:
        d = documents.join(context.select("path", "frames"), "path", "left")
        broken = F.when(F.col("reason").isNotNull(), "unreadable document")
        return d.withColumn("reason", F.coalesce(broken, F.when(F.col("records") != F.col("frames"), "record count differs"))).drop("frames")

    return judge


def parse_scene_objects(records: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_dynamic_metadata` on records that were cut out of documents, their counts judged before.

    A record with another index or more windows puts its whole document into quarantine, with the first such record as its value.
    """
    d = with_file_id(records).withColumn("r", F.from_json("value", SCENE_FIELDS)).withColumnRenamed("n", "frame")
    good = F.coalesce((F.col("r.SequenceFrameIndex") == F.col("frame")) & (F.col("r.NumberOfWindows") == 1), F.lit(False))
    d = judged(d, F.when(~good, "invalid frame index or windows"))
    bad = d.where(F.col("__reason").isNotNull()).groupBy("file_id", "path").agg(F.min_by("value", "frame").alias("value"), F.first("__reason").alias("reason"))
    whole = with_file_id(documents.where("reason is not null")).select("file_id", "path", F.lit(None).cast("string").alias("value"), "reason")
    # One row for each refused document: Spark broadcasts them by measured size.
    return _scene_rows(d.join(bad.select("path"), "path", "left_anti")), whole.unionByName(bad)


def parse_chunk_progress(documents: DataFrame) -> DataFrame:
    """Progress snapshots ``{frames, done: {chunk: {frames}}}`` to one row per finished chunk.

    ``documents`` carries ``job_id, total_frames``.  Torn JSON, another total or more frames done than
    planned make a snapshot worthless, and it is left out.
    """
    d = documents.withColumn("__p", F.from_json("value", "frames bigint, done map<string,struct<frames:bigint>>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    parts = F.transform(F.map_values("__p.done"), lambda x: x["frames"])
    done = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    sound = (
        F.col("__p._corrupt").isNull() & (F.col("__p.frames") == F.col("total_frames")) & F.col("__p.done").isNotNull()
        & ~F.exists(parts, lambda x: x.isNull() | (x < 0)) & (done <= F.col("total_frames"))
    )
    rows = d.where(F.coalesce(sound, F.lit(False))).select("job_id", "total_frames", F.explode_outer("__p.done").alias("chunk", "c"))
    return rows.select("job_id", "total_frames", "chunk", F.col("c.frames").alias("frames"), F.col("chunk").isNotNull().alias("done"), F.lit(0).cast("long").alias("bytes"))


def list_files(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """``path, length, modified_at`` of every file below ``path`` without reading contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def source_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """:func:`fingerprints` of every file below ``path``.  Spark's listing leaves out empty files."""
    return fingerprints(list_files(spark, path))


def fingerprints(listing: DataFrame) -> DataFrame:
    """Fingerprint of each file of a listing: path, length, time and three 64 KiB samples.

    The listing (``path, size_bytes, modified_at``) is dealt over tasks, which read only the samples, so a file may have any length.
    Small files may lie in bundles: ``bundle`` is then the file that holds ``path``'s bytes from ``offset`` on, and a task opens a bundle once
    for all its files that it reads.  A file that cannot be read or ends before its listed length raises.
    """
    from reeltally.operators.catalog import file_fingerprint

    size = 65_536

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, file = None, None
        try:
            for batch in batches:
                for lo in range(0, len(batch), 64):  # 12 MB of samples at most
                    part = batch.iloc[lo : lo + 64]
                    samples: dict[str, list[bytes]] = {"head": [], "middle": [], "tail": []}
                    for name, begin, length in zip(part["bundle"], part["offset"], part["size_bytes"]):
                        if name != held:
                            if file is not None:
                                file.close()
                            held, file = name, opened(name)
                        last = max(length - size, 0)
                        for sample, offset in zip(samples.values(), (0, last // 2, last)):
                            file.seek(begin + offset)
                            sample.append(file.read(min(size, length)))
                            if len(sample[-1]) < min(size, length):
                                raise OSError(f"{name} ends before its {begin + length} bytes")
                    yield part[["path", "size_bytes", "us"]].assign(**samples)
        finally:
            if file is not None:
                file.close()

    bundled = "bundle" in listing.columns
    place = (F.col("bundle"), F.col("offset")) if bundled else (F.col("path").alias("bundle"), F.lit(0).cast("long").alias("offset"))
    listed = listing.select("path", "size_bytes", F.unix_micros("modified_at").alias("us"), *place)
    listed = listed.repartition(listing.sparkSession.sparkContext.defaultParallelism)
    if bundled:
        listed = listed.sortWithinPartitions("bundle", "offset")
    d = listed.mapInPandas(run, "path string, size_bytes long, us long, head binary, middle binary, tail binary")
    samples = {name: F.col(name) for name in ("head", "middle", "tail")}
    return d.select("path", file_fingerprint(F.col("path"), F.col("size_bytes"), F.col("us"), samples).alias("fingerprint"))


def opened(path: str):
    """A file of a listing for reading at any place: local, or in a store that Arrow knows."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" or not colon:
        return open("/" + (rest or path).lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(name)


def scan_inventory(listing: DataFrame, max_media: int | None = None, *, fold_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """Media files of a listing, once per path and sorted, with a one-row summary.

    A listing entry may carry ``is_link``; links and non-media files count as skipped.  A limit keeps the
    first ``max_media`` paths and sets ``truncated``; without one the whole library is returned.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    link = F.coalesce(F.col("is_link"), F.lit(False)) if "is_link" in listing.columns else F.lit(False)
    key = F.lower("path") if fold_case else F.col("path")
    d = listing.withColumn("path_key", key).withColumn("__media", ext.isin(*X.MEDIA_EXTENSIONS) & ~link)
    # One whole entry of each path, the first by its columns; repeats are combined before the shuffle.
    keep = [c for c in listing.columns if c not in ("path", "is_link")]
    media = d.where("__media").groupBy("path_key").agg(F.min(F.struct("path", *keep)).alias("m")).select("path_key", "m.*")
    # Both counts meet in one more aggregate rather than in a join of single rows.
    none = F.lit(0).cast("long")
    counts = d.agg(F.count(F.lit(1)).alias("entries"), none.alias("found"))
    found = media.agg(none.alias("entries"), F.count(F.lit(1)).alias("found"))
    limit = F.lit(max_media).cast("long")
    summary = counts.unionByName(found).agg(F.sum("entries").alias("entries"), F.sum("found").alias("found")).select(
        "entries", (F.col("entries") - F.col("found")).alias("skipped"), F.coalesce(F.least("found", limit), "found").alias("media"),
        F.coalesce(F.col("found") > limit, F.lit(False)).alias("truncated"),
    )
    rows = media.drop("path_key").orderBy("path")
    return (rows if max_media is None else rows.limit(max_media)), summary
