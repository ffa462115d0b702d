"""Packet, frame, hash, metric, grain, log and detector records: text lines to typed rows.

Every ``parse_*`` takes numbered lines (``path, n, value``, optionally ``file_id``) and returns
``(rows, quarantine)``.  All parsing is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.functions import exprs as X
from reeltally.plans.blocks import attach, numbered, running
from reeltally.plans.verdicts import reason, with_verdict
from reeltally.sources.lines import judged, read_bundles, read_lines, repeated, split_quarantine, unexpected, with_fields, with_file_id

# Accepted record fields, pixel formats and colour tags.
PACKET_FIELDS = ("stream_index", "pts_time", "dts_time", "duration_time", "size")
FRAME_FIELDS = (
    "best_effort_timestamp_time", "interlaced_frame", "sample_aspect_ratio", "width", "height", "pix_fmt", "color_range",
    "color_space", "color_transfer", "color_primaries", "chroma_location",
)
PIXEL_FORMATS = ("yuv420p", "yuv422p", "yuv444p", "yuv420p10le", "yuv422p10le", "yuv444p10le", "yuva420p")
SDR_TAGS = ("bt709", "bt470bg", "smpte170m")
RANGES = ("tv", "pc")
SITINGS = ("left", "center", "topleft")
HASH_HEADER = "#hash: SHA256"
COLUMN_HEADER = "#stream#, dts,        pts, duration,     size, hash"


TIMES = {"pts_us": "pts_time", "dts_us": "dts_time", "duration_us": "duration_time"}


def _typed_packets(lines: DataFrame, extra: list[str]) -> DataFrame:
    """Raw fields and typed packet columns; ``__odd_time`` marks an unusable time field."""
    d = with_fields(with_file_id(lines), [*PACKET_FIELDS, *extra])
    d = d.withColumns({c: X.seconds_us(F.col(f"__f_{f}")) for c, f in TIMES.items()})
    d = d.withColumn("size", X.unsigned(F.col("__f_size"))).withColumn("stream_index", X.unsigned(F.col("__f_stream_index")))
    odd = F.lit(False)
    for c, f in TIMES.items():
        raw = F.col(f"__f_{f}")
        odd = odd | (raw.isNotNull() & (raw != "N/A") & F.col(c).isNull())
    return d.withColumn("__odd_time", odd)


def parse_packet_records(lines: DataFrame, *, stream_index: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict packet records: only the five known fields, none repeated, size required."""
    d = _typed_packets(lines, [])
    other = F.lit(False) if stream_index is None else F.col("stream_index") != stream_index
    why = reason(
        (unexpected(PACKET_FIELDS), "unexpected field"),
        (repeated(PACKET_FIELDS), "repeated field"),
        (F.col("stream_index").isNull(), "no stream index"),
        (other, "different stream"),
        (F.col("__odd_time"), "invalid time"),
        (F.col("duration_us") < 0, "negative duration"),
        (F.col("size").isNull(), "no usable size"),
    )
    keep = ["file_id", "stream_index", "n", "pts_us", "dts_us", "duration_us", "size"]
    rows, bad = split_quarantine(judged(d, why), keep, ["file_id", "path", "n", "value"])
    return numbered(rows, order=["n"]).drop("n"), bad


def parse_packet_hashes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packet records with payload hash: ``SHA256:`` and 64 hex digits required; unknown fields ignored."""
    d = _typed_packets(lines, ["data_hash", "flags"])
    raw = F.col("__f_data_hash")
    d = d.withColumn("hash", F.when(raw.rlike("^SHA256:[0-9a-fA-F]{64}$"), F.substring(raw, 8, 64)))
    d = d.withColumn("stream_index", F.coalesce("stream_index", F.lit(0).cast("long"))).withColumn("flags", F.col("__f_flags"))
    why = reason(
        (F.col("__odd_time"), "invalid time"),
        (F.col("size").isNull(), "no usable size"),
        (F.col("hash").isNull(), "no content hash"),
    )
    keep = ["file_id", "stream_index", "n", "pts_us", "dts_us", "duration_us", "size", "flags", "hash"]
    rows, bad = split_quarantine(judged(d, why), keep, ["file_id", "path", "n", "value"])
    return numbered(rows, order=["n"]).drop("n"), bad


def _frame_columns(get) -> tuple[dict[str, Column], Column]:
    """Typed frame columns and the reject reason; ``get`` maps a field name to its text."""
    t = X.seconds_us(get("best_effort_timestamp_time"))
    sar_text = get("sample_aspect_ratio")
    sar = F.when(sar_text == "N/A", F.struct(F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))).otherwise(X.rational(sar_text, ":"))
    w, h, fmt = X.unsigned(get("width")), X.unsigned(get("height")), get("pix_fmt")
    site = get("chroma_location")
    is422, is444 = fmt.startswith("yuv422p"), fmt.startswith("yuv444p")
    unset = site.isNull() | site.isin("unknown", "unspecified")
    site = F.when(is444, F.lit(None).cast("string")).when(is422 & unset, "left").otherwise(site)
    listed = lambda c, allowed: F.coalesce(c.isin(*allowed), F.lit(False))
    why = reason(
        (get("best_effort_timestamp_time").isNull(), "no timestamp"),
        (t.isNull(), "invalid timestamp"),
        (~listed(get("interlaced_frame"), ("0", "false")), "not progressive"),
        (sar.isNull() | (sar["num"] / sar["den"] > 100), "invalid aspect ratio"),
        (~F.coalesce((w > 0) & (h > 0), F.lit(False)), "size out of range"),
        (~listed(fmt, PIXEL_FORMATS), "unsupported pixel format"),
        (~listed(get("color_transfer"), SDR_TAGS), "not tagged SDR"),
        (
            ~listed(get("color_range"), RANGES) | ~listed(get("color_space"), SDR_TAGS) | ~listed(get("color_primaries"), SDR_TAGS)
            | (~is444 & ~listed(site, SITINGS)),
            "incomplete colour metadata",
        ),
    )
    cols = {
        "t_us": t, "width": w, "height": h, "sar": sar, "pix_fmt": fmt, "color_range": get("color_range"), "color_space": get("color_space"),
        "color_transfer": get("color_transfer"), "color_primaries": get("color_primaries"), "chroma_location": site,
    }
    return cols, why


FRAME_COLUMNS = (
    "t_us", "width", "height", "sar", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries", "chroma_location",
)


def parse_frame_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compact frame records of a comparable progressive SDR video."""
    d = with_fields(with_file_id(lines), FRAME_FIELDS)
    cols, why = _frame_columns(lambda f: F.col(f"__f_{f}"))
    shape = reason(
(repeated(FRAME_FIELDS), "repeated field"))
    d = judged(d.withColumns(cols), F.coalesce(shape, why))
    rows, bad = split_quarantine(d, ["file_id", "n", *FRAME_COLUMNS], ["file_id", "path", "n", "value"])
    return numbered(rows, keys=["file_id"], order=["n"]).drop("n"), bad


def _frame_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantine of frame structs ``f`` at ``ordinal``; ``broken`` marks those that could not be read."""
    cols, why = _frame_columns(lambda name: F.col("f")[name])
    d = judged(objects.withColumns(cols), F.when(F.col("broken"), "unreadable record").otherwise(why))
    rejected = d.where(F.col("__reason").isNotNull()).select(
        "file_id", "path", F.col("ordinal").alias("n"), F.lit(None).cast("string").alias("value"), F.col("__reason").alias("reason")
    )
    return d.where(F.col("__reason").isNull()).select("file_id", "ordinal", *FRAME_COLUMNS), rejected


def _whole_document(documents: DataFrame, why: str) -> DataFrame:
    """Quarantine rows of documents as a whole."""
    return documents.select("file_id", "path", F.lit(None).cast("long").alias("n"), "value", F.lit(why).alias("reason"))


def _read_objects(records: DataFrame, fields: str) -> DataFrame:
    """Records ``path, n, value`` as structs ``f`` at ``ordinal``; text that is no object is ``broken``."""
    kept = {"columnNameOfCorruptRecord": "_corrupt"}
    d = with_file_id(records).withColumn("f", F.from_json("value", f"{fields}, _corrupt string", kept))
    return d.select("file_id", "path", F.col("n").alias("ordinal"), "f", F.col("f._corrupt").isNotNull().alias("broken"))


def parse_frame_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON frame documents ``{"frames": [...]}``; numbers may be text."""
    doc = F.from_json("value", f"frames array<struct<{', '.join(f'{f}:string' for f in FRAME_FIELDS)}>>")
    d = with_file_id(documents).withColumn("doc", doc)
    f = d.where(F.col("doc.frames").isNotNull()).select("file_id", "path", F.posexplode("doc.frames").alias("ordinal", "f"), F.lit(False).alias("broken"))
    rows, rejected = _frame_objects(f.withColumn("ordinal", F.col("ordinal").cast("long")))
    return rows, _whole_document(d.where(F.col("doc.frames").isNull()), "no frames array").unionByName(rejected)


def parse_frame_objects(records: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_frame_documents` on what :func:`~reeltally.sources.json_splits.read_json_records` cut out of documents.

    A record that is no JSON is quarantined by its position; it does not take its document with it.  Documents are quarantined without their text.
    """
    rows, rejected = _frame_objects(_read_objects(records, ", ".join(f"{f} string" for f in FRAME_FIELDS)))
    return rows, _whole_document(refused(documents), "no frames array").unionByName(rejected)


def refused(documents: DataFrame) -> DataFrame:
    """Documents with a reason, in the form of a quarantine."""
    return with_file_id(documents.where("reason is not null")).withColumn("value", F.lit(None).cast("string"))


def parse_metric_lines(lines: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """Per-frame score lines: ``ssim`` (``All:``), ``psnr`` (``psnr_avg:``) or ``xpsnr`` (three channels).

    ``frame`` is the reported ordinal from zero and ``n`` the record position; see :func:`metric_verdict`.
    XPSNR rows carry the weighted frame error; every other score is used as reported, infinite PSNR as null.
    """
    # Texts, then numbers, then what follows from them, each a step of one row: written as one expression, every rule repeats the searches.
    once = lambda d, **columns: judged(d.withColumns(columns), F.lit(None).cast("string")).drop("__reason")
    v = X.strip("value")
    if metric in ("ssim", "psnr"):
        name = "All" if metric == "ssim" else "psnr_avg"
        # The text behind a mark is never empty, so an empty one stands for none.
        get = lambda k: F.regexp_extract(v, rf"(?:^|\s){k}:(\S+)", 1)
        src = once(once(with_file_id(lines), __n=get("n"), __raw=get(name)), __frame=X.unsigned("__n") - 1, __score=X.finite("__raw", None))
        frame, score = F.col("__frame"), F.col("__score")
        raw = F.when(F.col("__raw") != "", F.col("__raw"))
        infinite = F.lit(metric == "psnr") & (raw == "inf")
        in_range = score.between(-1.0, 1.0) if metric == "ssim" else score >= 0
        why = reason(
            (frame.isNull() | (frame < 0), "no frame number"),
            (raw.isNull(), "no metric value"),
            (~F.coalesce(in_range, F.lit(False)) & ~F.coalesce(infinite, F.lit(False)), "score out of range"),
        )
        out = [score.alias("score"), F.lit(None).cast("double").alias("error")]
    elif metric == "xpsnr":
        p = r"^n:\s+([0-9]+)\s+XPSNR\s+y:\s+(\S+)\s+XPSNR\s+u:\s+(\S+)\s+XPSNR\s+v:\s+(\S+)$"
        src = once(with_file_id(lines).where(v.startswith("n:")), **{f"__t{i}": F.regexp_extract(v, p, i) for i in (1, 2, 3, 4)})
        part = lambda i: F.when(F.col(f"__t{i}") == "inf", float("inf")).otherwise(X.finite(f"__t{i}", None))
        src = once(src, __frame=X.unsigned("__t1") - 1, __y=part(2), __u=part(3), __w=part(4))
        frame, y, u, w = (F.col(c) for c in ("__frame", "__y", "__u", "__w"))
        err = lambda c: F.when(c == float("inf"), 0.0).otherwise(F.pow(F.lit(10.0), -c / 10.0))
        src = once(src, __error=(err(y) * 4.0 + err(u) + err(w)) / 6.0)
        error = F.col("__error")
        valid = (y >= 0) & (u >= 0) & (w >= 0)
        why = reason((F.col("__t2") == "", "invalid record"), (~F.coalesce(valid, F.lit(False)), "invalid channel value"))
        out = [F.when(error > 0, F.log10(error) * -10.0).alias("score"), error.alias("error")]
    else:
        raise ValueError(metric)
    d = src.select("*", F.lit(metric).alias("metric"), frame.alias("frame"), *out)
    d = judged(d, why)
    return split_quarantine(d, ["file_id", "metric", "n", "frame", "score", "error"], ["file_id", "path", "n", "value"])


METRIC_FIELDS = "frameNum bigint, metrics map<string,double>"


def _metric_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    score = F.try_element_at(F.col("f.metrics"), F.lit("vmaf"))
    why = reason(
        (F.col("broken"), "unreadable record"), (F.col("f.frameNum").isNull(), "no frame number"), (score.isNull(), "no metric value"),
        (~score.between(-1000.0, 1000.0), "score out of range"),
    )
    e = judged(objects, why).select("file_id", "path", F.col("ordinal").cast("long").alias("n"), F.lit(None).cast("string").alias("value"), F.lit("vmaf").alias("metric"),
                                    F.col("f.frameNum").alias("frame"), score.alias("score"), F.lit(None).cast("double").alias("error"), "__reason")
    return split_quarantine(e, ["file_id", "metric", "n", "frame", "score", "error"], ["file_id", "path", "n", "value"])


def parse_metric_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VMAF JSON documents ``{"frames": [{"frameNum": 0, "metrics": {"vmaf": 95.1}}]}``."""
    d = with_file_id(documents).withColumn("doc", F.from_json("value", f"frames array<struct<{METRIC_FIELDS}>>"))
    f = d.select("file_id", "path", F.posexplode("doc.frames").alias("ordinal", "f"), F.lit(False).alias("broken"))
    rows, rejected = _metric_objects(f)
    return rows, _whole_document(d.where(F.col("doc.frames").isNull()), "no frames array").unionByName(rejected)


def parse_metric_objects(records: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_metric_documents` on records that were cut out of documents; see :func:`parse_frame_objects`."""
    rows, rejected = _metric_objects(_read_objects(records, METRIC_FIELDS))
    return rows, _whole_document(refused(documents), "no frames array").unionByName(rejected)


def metric_verdict(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Frames must be numbered 0..n-1 in record order and match the expected count."""
    d = rows.groupBy("file_id", "metric").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("n").alias("__n0"),
        F.max("n").alias("__n1"),
        F.min(F.col("frame") - F.col("n")).alias("__lo"),
        F.max(F.col("frame") - F.col("n")).alias("__hi"),
        F.min("frame").alias("first_frame"),
    )
    dense = (F.col("first_frame") == 0) & (F.col("__lo") == F.col("__hi")) & (F.col("__n1") - F.col("__n0") + 1 == F.col("frames"))
    if expected is not None:
        d = d.join(expected.select("file_id", "expected_frames"), "file_id", "left")
    else:
        d = d.withColumn("expected_frames", F.col("frames"))
    return with_verdict(
        d.withColumn("__dense", dense), (~F.col("__dense"), "frames skipped or repeated"), (F.col("frames") != F.col("expected_frames"), "frame count differs")
    ).drop("__n0", "__n1", "__lo", "__hi", "__dense")


def parse_frame_hashes(lines: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Checksum listings with header lines.

    Every record needs its stream's ``#tb`` header above it.  ``strict`` is the cadence form: SHA-256 and
    column headers required, stream 0 only, decode time equal to presentation time, size above zero.
    """
    d = with_file_id(lines).withColumn("__v", X.strip("value"))
    head = d.where(F.col("__v").startswith("#"))
    tb = r"^#tb\s+([0-9]+):\s*([0-9]+)\s*/\s*([0-9]+)"
    bases = head.where(F.col("__v").rlike(tb)).select(
        "path", F.regexp_extract("__v", tb, 1).try_cast("bigint").alias("stream_index"), "n", F.col("n").alias("__tb_n"),
        F.regexp_extract("__v", tb, 2).try_cast("bigint").alias("num"), F.regexp_extract("__v", tb, 3).try_cast("bigint").alias("den"),
    )
    marks = head.groupBy("path").agg(
        F.min(F.when(F.col("__v") == HASH_HEADER, F.col("n"))).alias("__hash_n"), F.min(F.when(F.col("__v") == COLUMN_HEADER, F.col("n"))).alias("__cols_n")
    )
    part = lambda i: X.strip(F.get(F.split("__v", ","), F.lit(i)))
    body = d.where(~F.col("__v").startswith("#")).withColumn("stream_index", X.unsigned(part(0)))
    # The header that counts is the last one above the record: a running maximum of header positions.
    lines_and_heads = body.unionByName(bases.select("path", "stream_index", "n", "__tb_n"), allowMissingColumns=True)
    body = running(lines_and_heads, keys=["path", "stream_index"], order=["n"], maxes={"__above": "__tb_n"}).where("__tb_n is null")
    body = body.drop("__tb_n").withColumnRenamed("__above", "__tb_n")
    body = attach(attach(body, bases.drop("n"), ["path", "stream_index", "__tb_n"], spread="n"), marks, ["path"], spread="n")
    ticks = lambda c: F.when(c != "NOPTS", X.signed(c))
    dts, pts, dur, size, digest = ticks(part(1)), ticks(part(2)), ticks(part(3)), X.unsigned(part(4)), part(5)
    broken = lambda c, v: (c != "NOPTS") & v.isNull()
    rules = [
        (F.size(F.split("__v", ",")) < 6, "too few fields"),
        (F.coalesce(F.col("__tb_n") > F.col("n"), F.lit(True)) | (F.col("den") <= 0), "no timebase"),
        (broken(part(1), dts) | broken(part(2), pts) | broken(part(3), dur), "invalid timestamp"),
        (size.isNull(), "no usable size"),
    ]
    if strict:
        late = lambda c: F.coalesce(F.col(c) > F.col("n"), F.lit(True))
        rules = [(late("__hash_n") | late("__cols_n"), "no SHA-256 header"), *rules[:2], (F.size(F.split("__v", ",")) != 6, "too many fields"), *rules[2:]]
        rules += [
            (~F.coalesce(F.col("stream_index") == 0, F.lit(False)), "different stream"),
            (~F.coalesce(dts == pts, F.lit(False)) | (size == 0), "reordered or empty frame"),
            (~F.coalesce(dur > 0, F.lit(False)), "no duration"),
            (~digest.rlike("^[0-9a-fA-F]{64}$"), "invalid digest"),
        ]
    us = lambda c: F.round(c * F.col("num") * 1e6 / F.col("den")).cast("long")
    e = judged(body, reason(*rules)).select(
        "file_id", "path", "n", "value", "stream_index", pts.alias("pts_ticks"), dts.alias("dts_ticks"), dur.alias("duration_ticks"),
        us(pts).alias("pts_us"), us(dts).alias("dts_us"), us(dur).alias("duration_us"), size.alias("size"), digest.alias("hash"), "__reason",
    )
    keep = ["file_id", "stream_index", "n", "pts_ticks", "dts_ticks", "duration_ticks", "pts_us", "dts_us", "duration_us", "size", "hash"]
    rows, bad = split_quarantine(e, keep, ["file_id", "path", "n", "value"])
    return numbered(rows, order=["n"]).drop("n"), bad


def parse_grain_segments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment lines ``E start end ...`` of film-grain tables; other lines are ignored."""
    f = F.split(X.strip("value"), r"[ \t]+")
    e = with_file_id(lines).where(F.get(f, F.lit(0)) == "E")
    start, end = X.unsigned(F.get(f, F.lit(1))), X.unsigned(F.get(f, F.lit(2)))
    why = reason((F.size(f) < 6, "too few fields"), (start.isNull() | end.isNull(), "invalid timestamp"), (end <= start, "invalid interval"))
    d = judged(e, why).select("file_id", "path", "n", "value", start.alias("start_tick"), end.alias("end_tick"), "__reason")
    return split_quarantine(d, ["file_id", "n", "start_tick", "end_tick"], ["file_id", "path", "n", "value"])


def parse_progress(lines: DataFrame, *, text: str = "value") -> DataFrame:
    """Encoder progress columns of the log lines that are progress records."""
    line = F.regexp_replace(X.strip(text), r"^\[consumer\] ", "")
    p = r"^Encoding:(.*?) Frames @ (.*)$"
    count, metrics = X.strip(F.regexp_extract(line, p, 1)), F.regexp_extract(line, p, 2)
    frames = X.unsigned(F.regexp_extract(count, r"^([^/]*)(?:/.*)?$", 1))
    total = F.when(F.contains(count, F.lit("/")), X.unsigned(F.regexp_extract(count, r"/(.*)$", 1)))
    total = F.when(total > 0, total)
    part = lambda i: X.strip(F.get(F.split(metrics, r"\|"), F.lit(i)))
    number = lambda t: F.when(X.finite(X.strip(t), None) >= 0, X.finite(X.strip(t), None))
    suffix = lambda t, s: F.when(t.endswith(s), F.substring(t, F.lit(1), F.length(t) - len(s)))
    speed = part(0)
    fps = F.coalesce(number(suffix(speed, "fps")), number(suffix(speed, "fpm")) / 60.0)
    size_bytes = lambda t: F.round(number(suffix(t, " MB")) * 1e6).cast("long")
    size = F.when(part(2).startswith("Size: "), X.tail(part(2), 7))
    clock = F.when(part(3).startswith("Time: "), X.tail(part(3), 7))
    now = lambda t: F.regexp_extract(t, r"^(.*?)(?: \[.*)?$", 1)
    later = lambda t: F.when(t.rlike(r" \[.*\]$"), F.regexp_extract(t, r"^.*? \[(.*)\]$", 1))

    def seconds(t: Column) -> Column:
        g = lambda i: X.unsigned(F.regexp_extract(t, r"^([0-9]+):([0-9]+):([0-9]+)$", i))
        return F.when((g(2) < 60) & (g(3) < 60), g(1) * 3600 + g(2) * 60 + g(3))

    eta = F.when(later(clock).startswith("-"), X.tail(later(clock), 2))
    d = lines.withColumns({
        "frames": frames, "total_frames": total, "percent": F.when(total.isNotNull(), F.least(frames / total * 100.0, F.lit(100.0))), "fps": fps,
        "bitrate_kbps": number(suffix(part(1), "kb/s")), "size_bytes": size_bytes(now(size)), "estimated_size_bytes": size_bytes(later(size)),
        "elapsed_s": seconds(now(clock)), "eta_s": seconds(eta),
    })
    return d.where(line.rlike(p) & F.col("frames").isNotNull())


def read_tool_logs(spark: SparkSession, path: str, *, glob: str = "*.log", bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Log lines of many jobs and the progress records among them; the job is the file's stem.

    Logs in different folders may share a stem; ``file_id`` tells them apart.
    """
    lines = read_bundles(spark, path, lines=True) if bundled else read_lines(spark, path, glob=glob, skip_blank=False)
    job = F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1)
    d = lines.select(job.alias("job_id"), X.path_id("path").alias("file_id"), "n", F.col("value").alias("text"))
    return d, parse_progress(d, text="text")


def parse_crop_samples(lines: DataFrame, *, per_position: int | None = None) -> DataFrame:
    """Crop rectangles moved outward to even edges; unusable ones dropped.

    ``lines`` also carries ``position, frame_w, frame_h``.  ``per_position`` keeps the first so many of a position.
    """
    from pyspark.sql import Window as W

    p = r"^.*crop=([0-9]+):([0-9]+):([0-9]+):([0-9]+)(?:\s.*)?$"
    g = lambda i: F.regexp_extract("value", p, i).try_cast("bigint")
    w, h, x, y = (g(i) for i in (1, 2, 3, 4))
    x0, x1 = X.even_out(x, x + w)
    y0, y1 = X.even_out(y, y + h)
    d = with_file_id(lines).where(F.col("value").rlike(p)).withColumns({"__w": w, "__h": h, "__x1": x + w, "__y1": y + h, "x": x0, "y": y0, "__ex": x1, "__ey": y1})
    d = d.where(
        (F.col("__w") > 0) & (F.col("__h") > 0) & (F.col("__x1") <= F.col("frame_w")) & (F.col("__y1") <= F.col("frame_h"))
        & (F.col("__ex") <= F.col("frame_w")) & (F.col("__ey") <= F.col("frame_h")) & (F.col("__ex") - F.col("x") >= 64) & (F.col("__ey") - F.col("y") >= 64)
    )
    d = d.withColumn("w", F.col("__ex") - F.col("x")).withColumn("h", F.col("__ey") - F.col("y"))
    if per_position is not None:
        d = d.withColumn("__r", F.row_number().over(W.partitionBy("file_id", "position").orderBy("n"))).where(F.col("__r") <= per_position)
    return d.select("file_id", "position", "n", "x", "y", "w", "h", "frame_w", "frame_h")


def parse_field_samples(lines: DataFrame) -> DataFrame:
    """Final field-detector counters per ``(file_id, position)``: the last line of each kind counts."""
    v = F.col("value")
    n = lambda label: F.coalesce(X.unsigned(F.regexp_extract(v, rf"{label}:\s*(\S+)", 1)), F.lit(0).cast("long"))
    multi, rep = F.contains(v, F.lit("Multi frame detection:")), F.contains(v, F.lit("Repeated Fields:"))
    last = lambda hit, value: F.coalesce(F.max_by(F.when(hit, value), F.when(hit, F.col("n"))), F.lit(0).cast("long"))
    return with_file_id(lines).where(multi | rep).groupBy("file_id", "position").agg(
        last(multi, n("TFF")).alias("tff"), last(multi, n("BFF")).alias("bff"), last(multi, n("Progressive")).alias("progressive"),
        last(multi, n("Undetermined")).alias("undetermined"), last(rep, n("Top") + n("Bottom")).alias("repeated"), last(rep, n("Neither")).alias("neither"),
    )


def parse_gap_samples(lines: DataFrame) -> DataFrame:
    """Field differences per sampled position, numbered from zero in log order."""
    raw = X.strip(F.regexp_extract("value", r"lavfi\.signalstats\.YDIF=(.*)$", 1))
    d = with_file_id(lines).where(F.contains("value", F.lit("lavfi.signalstats.YDIF="))).withColumn("value", X.finite(raw, None)).where(F.col("value") >= 0)
    d = numbered(d.select("file_id", "position", F.col("n").alias("__line"), "value"), keys=["file_id", "position"], order=["__line"], name="n")
    return d.select("file_id", "position", "n", "value")
