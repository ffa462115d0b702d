"""Record and document parsing on small text fixtures, including damaged input."""

import json
import os

import pytest
from pyspark.sql import functions as F

from reeltally.sources import documents as docs
from reeltally.sources import records as rec
from reeltally.sources.lines import read_documents, read_lines


def lines(spark, text, **extra):
    rows = [(1, "f", i, t) for i, t in enumerate(text)]
    d = spark.createDataFrame(rows, "file_id long, path string, n long, value string")
    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


def doc(spark, *texts, **extra):
    d = spark.createDataFrame([(i, f"/d/{i}", t) for i, t in enumerate(texts)], "file_id long, path string, value string")
    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


def reasons(bad):
    return [r.reason for r in bad.orderBy("n").collect()]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(text[:3000]) + "\n")
    (tmp_path / "b.txt").write_text("\n\n".join(text[3000:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = read_lines(spark, str(tmp_path), glob="*.txt")
        assert d.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(r.path[-5:], r.n): r.value for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a.txt", i): t for i, t in enumerate(text[:3000])} | {("b.txt", i): t for i, t in enumerate(text[3000:])}
    assert got == want


GOOD = "stream_index=2|pts_time=1.500000|dts_time=N/A|duration_time=0.5|size=200"


def test_strict_packets(spark):
    bad = [
        ("stream_index=1|size=1", "different stream"), ("stream_index=2|size=1|size=2", "repeated field"), ("stream_index=2|pts_time=NaN|size=1", "invalid time"),
        ("stream_index=2|pts_time=inf|size=1", "invalid time"), ("stream_index=2|duration_time=-1|size=1", "negative duration"), ("stream_index=2|pts_time=1", "no usable size"),
        ("stream_index=2|size=1|pos=3", "unexpected field"), ("stream_index=2|size=18446744073709551616", "no usable size"), ("stream_index=2|size=1|pts_time=1d", "invalid time"),
        ("stream_index=2|pts_time=20000000000000|size=1", "invalid time"), ("stream_index=2|oops|size=1", "unexpected field"),
    ]
    rows, q = rec.parse_packet_records(lines(spark, [GOOD, *[b for b, _ in bad], GOOD + "|"]), stream_index=2)
    assert reasons(q) == [r for _, r in bad]
    got = [(r.ordinal, r.pts_us, r.dts_us, r.duration_us, r.size) for r in rows.orderBy("ordinal").collect()]
    assert got == [(0, 1_500_000, None, 500_000, 200), (1, 1_500_000, None, 500_000, 200)]


def test_hash_packets(spark):
    h = "SHA256:" + "aB" * 32
    rows, q = rec.parse_packet_hashes(lines(spark, [f"pts_time=0|size=3|data_hash={h}|flags=K__|pos=9", "pts_time=0|size=3|data_hash=SHA256:12", "pts_time=x|size=3|data_hash=" + h]))
    r = rows.first()
    assert (r.size, r.flags, r.hash) == (3, "K__", "aB" * 32)
    assert reasons(q) == ["no content hash", "invalid time"]


def test_listing_needs_headers(spark):
    head = [rec.HASH_HEADER, rec.COLUMN_HEADER, "#tb 0: 1/24"]
    body = "0, 0, 0, 1, 10, " + "a" * 64
    rows, q = rec.parse_frame_hashes(lines(spark, [*head, body, "0, 1, 1, 1, 10, " + "b" * 64, "0, 2, 3, 1, 10, " + "b" * 64]), strict=True)
    assert [r.pts_us for r in rows.orderBy("ordinal").collect()] == [0, 41667] and reasons(q) == ["reordered or empty frame"]
    rows, q = rec.parse_frame_hashes(lines(spark, [body, "#tb 0: 1/24", body]))
    assert rows.count() == 1 and reasons(q) == ["no timebase"]
    assert reasons(rec.parse_frame_hashes(lines(spark, ["#tb 0: 1/24", body]), strict=True)[1]) == ["no SHA-256 header"]


@pytest.mark.parametrize("text,want", [
    ("Encoding: 120/2400 Frames @ 24.50 fps | 1000.5 kb/s | Size: 1.50 MB [30.00 MB] | Time: 0:00:10 [-0:03:10]", (120, 2400, 5.0, 24.5, 1000.5, 1_500_000, 30_000_000, 10, 190)),
    ("[consumer] Encoding:  60 Frames @ 90.0 fpm | 1.0 kb/s", (60, None, None, 1.5, 1.0, None, None, None, None)),
    ("Encoding: 300/200 Frames @ 1 fps", (300, 200, 100.0, 1.0, None, None, None, None, None)),
    ("Muxing", None), ("Encoding: x Frames @ 1 fps", None),
])
def test_progress(spark, text, want):
    rows = rec.parse_progress(lines(spark, [text])).collect()
    if want is None:
        assert rows == []
    else:
        r = rows[0]
        assert (r.frames, r.total_frames, r.percent, r.fps, r.bitrate_kbps, r.size_bytes, r.estimated_size_bytes, r.elapsed_s, r.eta_s) == want


def test_metric_gaps(spark):
    good = ["n:1 All:0.9", "n:2 All:0.8"]
    v = rec.metric_verdict(rec.parse_metric_lines(lines(spark, good), "ssim")[0]).first()
    assert v.ok and v.frames == 2
    for text in (["n:2 All:0.9"], ["n:1 All:0.9", "n:3 All:0.9"], ["n:1 All:0.9", "n:1 All:0.9"]):
        assert not rec.metric_verdict(rec.parse_metric_lines(lines(spark, text), "ssim")[0]).first().ok
    assert reasons(rec.parse_metric_lines(lines(spark, ["n:1 All:1.5", "n:0 All:1", "All:1"]), "ssim")[1]) == ["score out of range", "no frame number", "no frame number"]
    psnr = rec.parse_metric_lines(lines(spark, ["n:1 psnr_avg:inf", "n:2 psnr_avg:nan"]), "psnr")
    assert psnr[0].first().score is None and reasons(psnr[1]) == ["score out of range"]


def test_crop_lines(spark):
    text = ["x crop=160:80:1:9", "crop=0:1:2:3", "crop=200:80:0:0", "crop=62:80:0:0", "none"]
    got = [(r.x, r.y, r.w, r.h) for r in rec.parse_crop_samples(lines(spark, text, position=0, frame_w=192, frame_h=112)).collect()]
    assert got == [(0, 8, 162, 82)]


def test_duration_fallbacks(spark):
    make = lambda stream: json.dumps({"format": {"duration": "x"}, "streams": [dict(index=0, codec_type="video", **stream)]})
    d = doc(spark, make({"duration": "0"}), make({"tags": {"DURATION": "0:00:01.0"}}), make({"duration": "NaN"}), make({"tags": {"duration": "0:60:01"}}), "{torn")
    files, streams, _, bad = docs.parse_probe_documents(d)
    assert {r.file_id: r.duration_s for r in streams.collect()} == {0: 0.0, 1: 1.0, 2: None, 3: None}
    assert {r.file_id: r.duration_s for r in files.collect()} == {0: 0.0, 1: 1.0, 2: None, 3: None}
    assert [r.file_id for r in bad.collect()] == [4]


def test_probe_fields(spark):
    side = [{"side_data_type": "DOVI configuration record", "dv_profile": 8}, {"side_data_type": "HDR Dynamic Metadata SMPTE2094-40 (HDR10+)"}, {"side_data_type": "Content light level metadata"}]
    s = dict(index=3, codec_type="video", pix_fmt="yuv420p10le", avg_frame_rate="0/0", r_frame_rate="25/1", color_transfer="smpte2084", color_space="unknown", side_data_list=side,
             disposition={"default": 1}, tags={"handler_name": "VideoHandler", "Language": "eng"}, sample_rate=48000, bit_rate="123")
    r = docs.parse_probe_documents(doc(spark, json.dumps({"streams": [s]})))[1].first()
    assert (r.stream_index, r.bit_depth, r.frame_rate.num, r.avg_rate, r.hdr_format, r.color_space) == (3, 10, 25, None, "HDR / PQ", None)
    assert (r.has_static_hdr, r.dynamic_hdr, r.dolby_profile, r.is_default, r.title, r.language) == (True, ["Dolby Vision", "HDR10+"], 8, True, None, "eng")
    assert (r.sample_rate, r.bit_rate) == (48000, 123)


SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000 X1:0\r\nBye\r\n"
VTT = "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nHi\n"
ASS = "[Script Info]\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,a, b\n"


def test_cues(spark):
    get = lambda t, f: docs.parse_cue_documents(doc(spark, t, format=f))
    srt = get(SRT, "srt")[0].orderBy("n").collect()
    assert [(r.start_ms, r.end_ms, r.body, r.settings) for r in srt] == [(1000, 2500, "Hello\nthere", ""), (3000, 4000, "Bye", "X1:0")]
    vtt = get(VTT, "webvtt")[0].collect()
    assert [(r.start_ms, r.body, r.settings) for r in vtt] == [(1000, "Hi", "align:start")]
    ass = get(ASS, "ass")[0].collect()
    assert [(r.start_ms, r.end_ms, r.body, len(r.fields)) for r in ass] == [(1000, 2500, "a, b", 10)]


@pytest.mark.parametrize("text,fmt,why", [
    ("hello", "srt", "unsupported block"), ("1\n00:00:02,000 --> 00:00:01,000\nx", "srt", "empty or reversed interval"), ("1\n1x --> 00:00:01,000\nx", "srt", "invalid timestamp"),
    (ASS.replace("[Events]", "[Other]"), "ass", "no events section"), (ASS.replace(",Default,,0,0,0,,a, b", ""), "ass", "unsupported block"),
    (ASS.replace("Layer, Start", "Start, Layer"), "ass", "unusual event field order"),
])
def test_bad_cues(spark, text, fmt, why):
    rows, bad = docs.parse_cue_documents(doc(spark, text, format=fmt))
    assert rows.count() == 0 and [r.reason for r in bad.collect()] == [why]


def test_written_cues_read_back(spark, tmp_path):
    from reeltally.sources.sinks import write_cues

    c = docs.parse_cue_documents(doc(spark, SRT, format="srt"))[0]
    write_cues(c, str(tmp_path / "out"))
    back = read_documents(spark, str(tmp_path / "out"), glob="*.txt").withColumn("file_id", F.lit(0).cast("long")).withColumn("format", F.lit("srt"))
    again = docs.parse_cue_documents(back)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, c.collect()))


def test_history(spark):
    ok = {"version": 1, "jobs": [{"id": "a", "state": "failed", "logs": ["x", "y"]}]}
    twice = {"version": 1, "jobs": [{"id": "a"}, {"id": "a"}]}
    jobs, logs, bad = docs.parse_job_history(doc(spark, json.dumps(ok), json.dumps({"version": 2, "jobs": []}), json.dumps(twice), json.dumps({"version": 1, "jobs": [{"id": ""}]}), "{"))
    assert [r.job_id for r in jobs.collect()] == ["a"] and [r.n for r in logs.collect()] == [0, 1]
    assert sorted(r.reason for r in bad.collect()) == ["empty job id", "repeated job id", "unreadable document", "unsupported version"]


def test_loudness(spark):
    good = 'noise {"input_i": "1"}\n{"input_i" : "-17.52", "input_tp" : "0.05", "input_lra" : "13.7"}\n'
    rows, bad = docs.parse_loudness_reports(doc(spark, good, good.replace("-17.52", "-inf"), good.replace("13.7", "-1"), good.replace("0.05", "inf"), "no"))
    assert [(r.integrated, r.peak) for r in rows.orderBy("file_id").collect()] == [(-17.52, 0.05), (None, 0.05)]
    assert sorted(r.reason for r in bad.collect()) == ["invalid measurement", "negative loudness range", "no measurements"]


def test_chunk_snapshots(spark):
    good = '{"frames":236,"done":{"0":{"frames":55},"1":{"frames":11}}}'
    texts = [good, good[:-1], good.replace("236", "235"), good.replace("55", "255"), '{"frames":236,"done":{}}']
    d = spark.createDataFrame(list(enumerate(texts)), "job_id long, value string").withColumn("total_frames", F.lit(236).cast("long"))
    got = docs.parse_chunk_progress(d).groupBy("job_id").agg(F.sum("frames").alias("f"), F.count("chunk").alias("c")).collect()
    assert sorted((r.job_id, r.f, r.c) for r in got) == [(0, 66, 2), (4, None, 0)]


def test_inventory(spark, tmp_path):
    for name in ("a.MKV", "sub/b.mp4", "c.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 10)
    listing = docs.list_files(spark, str(tmp_path))
    rows, summary = docs.scan_inventory(listing)
    assert [r.path.rsplit("/", 1)[1] for r in rows.collect()] == ["a.MKV", "b.mp4"]
    s = summary.first()
    assert (s.entries, s.skipped, s.media, s.truncated) == (3, 1, 2, False)
    limited, summary = docs.scan_inventory(listing, 1)
    assert limited.count() == 1 and summary.first().truncated


def test_fingerprints_see_changes(spark, tmp_path):
    p = tmp_path / "a.mkv"
    p.write_bytes(b"x" * 200_000)
    first = docs.source_fingerprints(spark, str(tmp_path)).first().fingerprint
    p.write_bytes(b"x" * 100_000 + b"y" + b"x" * 99_999)
    assert docs.source_fingerprints(spark, str(tmp_path)).first().fingerprint != first


def test_fingerprints_of_files_of_any_length(spark, tmp_path):
    length = (1 << 31) + 500_001
    p = tmp_path / "a film #1 100%.mkv"
    (tmp_path / "short.mkv").write_bytes(b"x")
    marks = set()
    for at in (None, 0, (length - 65_536) // 2, length - 1, 100_000_000):  # the last one lies outside the samples
        with p.open("wb") as file:
            file.truncate(length)
            if at is not None:
                file.seek(at)
                file.write(b"y")
        os.utime(p, (1_700_000_000, 1_700_000_000))
        rows = {r.path.rsplit("/", 1)[1]: r.fingerprint for r in docs.source_fingerprints(spark, str(tmp_path)).collect()}
        assert set(rows) == {p.name, "short.mkv"}
        marks.add(rows[p.name])
    assert len(marks) == 4


def test_every_crop_counts(spark):
    """No rectangle of a position is left out, however many there are."""
    text = [f"[Parsed_cropdetect] crop=1900:1000:{i % 16}:{i % 70}" for i in range(130)]
    rows = rec.parse_crop_samples(lines(spark, text, position=1, frame_w=1920, frame_h=1080))
    assert sorted(r.n for r in rows.collect()) == list(range(130))


def test_bundles_of_small_files(spark, tmp_path):
    """Some hundred small files lie in few; names, places and line ends of every one come back."""
    from reeltally.sources.lines import read_bundles, write_bundles

    d = spark.range(300).select("id", F.concat(F.lit("a\n\t\"{ü}\r\n"), F.col("id").cast("string")).alias("value")).repartition(3)
    write_bundles(d, str(tmp_path / "d"), F.concat(F.lit("x="), F.col("id").cast("string")))
    rows = {r.path.rsplit("/", 1)[1]: r.value for r in read_bundles(spark, str(tmp_path / "d")).collect()}
    assert rows == {f"x={i}": f'a\n\t"{{ü}}\r\n{i}' for i in range(300)}
    lines = d.select(F.lit("log").alias("name"), F.col("id").alias("n"), "value").unionByName(spark.createDataFrame([("log", 300, "")], "name string, n long, value string"))
    write_bundles(lines, str(tmp_path / "l"), F.col("name"))
    back = read_bundles(spark, str(tmp_path / "l"), lines=True)
    assert back.select("path").distinct().count() == 1 and sorted(r.n for r in back.collect()) == list(range(301))
    assert [r.value for r in back.where("n = 300").collect()] == [""]


@pytest.mark.parametrize("name", ["ingest_loudness_reports", "ingest_job_history", "ingest_scene_slices", "ingest_tool_logs"])
def test_small_files_are_gathered(spark, sf, tmp_path, monkeypatch, name):
    """The files written are as many as the tasks, not as the documents."""
    import __spark_entry__ as entry
    from reeltally.queries import ingest

    monkeypatch.setattr(ingest, "shared_dir", lambda spark: str(tmp_path / "out"))
    assert entry.queries()[name](spark, sf).count() > 0
    assert len(list((tmp_path / "out").rglob("part-*"))) <= 16


@pytest.mark.parametrize("metric", ["psnr", "ssim", "xpsnr"])
def test_metric_lines_are_searched_once(spark, metric):
    """No rule repeats the searches of a line: each text is extracted in one place of the plan."""
    d = spark.range(3).select(F.lit(1).alias("file_id"), F.lit("f").alias("path"), F.col("id").alias("n"), F.concat(F.lit("n: x"), F.col("id").cast("string")).alias("value"))
    plan = rec.parse_metric_lines(d, metric)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract") <= 4
