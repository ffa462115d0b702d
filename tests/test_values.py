"""Small cases with known results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reeltally.operators import catalog, clocks, compare, cues, jobs, rates, scoring

PACKETS = "file_id long, stream_index long, ordinal long, pts_us long, dts_us long, duration_us long, size long"


def packets(spark, rows):
    return spark.createDataFrame([(1, 2, i, *r) for i, r in enumerate(rows)], PACKETS)


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_windows_and_totals(spark):
    p = packets(spark, [(1_500_000, None, 500_000, 200), (-500_000, None, 500_000, 100), (None, 1_000_000, 500_000, 300), (None, None, None, 50)])
    w = rates.windowed_rate(p, 1_000_000).orderBy("start_us").collect()
    assert [r.packet_bytes for r in w] == [100, 0, 500] and w[0].start_us == -1_000_000
    t = one(rates.packet_totals(p))
    assert (t["packet_bytes"], t["untimed_bytes"], t["dts_fallback_count"]) == (650, 50, 1)
    assert (t["start_us"], t["end_us"]) == (-500_000, 2_000_000)
    assert t["average_mbps"] == pytest.approx(600 * 8 / 2.5 / 1e6)


def test_unknown_end(spark):
    p = packets(spark, [(0, None, 500_000, 100), (1_000_000, None, None, 100)])
    t = one(rates.packet_totals(p))
    assert t["end_us"] is None and t["average_mbps"] is None
    assert rates.windowed_rate(p, 1_000_000).count() == 2


def test_long_streams_keep_every_window(spark):
    far = lambda s: packets(spark, [(0, None, None, 1), (s * 1_000_000, None, None, 1)])
    assert rates.windowed_rate(far(7199), 1_000_000).count() == 7200
    assert rates.windowed_rate(far(90_000), 1_000_000).count() == 90_001
    summary, series = rates.bitrate_report(far(7200), 1_000_000, max_windows=7200)
    assert one(summary)["reason"] == "too many windows" and series.count() == 7201
    summary, _ = rates.bitrate_report(far(7200), 1_000_000)
    assert one(summary)["ok"] and one(summary)["windows"] == 7201


def crops(spark, rects):
    return spark.createDataFrame([(1, *r, 192, 112) for r in rects], "file_id long, x long, y long, w long, h long, frame_w long, frame_h long")


def test_crop_consensus(spark):
    a, b = (0, 8, 160, 80), (32, 8, 160, 80)
    r = one(scoring.crop_consensus(crops(spark, [a, b])))
    assert (r["crop_left"], r["crop_right"], r["crop_top"], r["crop_bottom"], r["agreement_pct"]) == (0, 0, 8, 24, 50)
    assert one(scoring.crop_consensus(crops(spark, [a] * 9 + [b])))["crop_right"] == 32


@pytest.mark.parametrize("counts,gap,want", [
    ((79, 96, 27, 0), None, "progressive"), ((202, 0, 0, 0), 1.02, "top first"), ((0, 202, 0, 0), 1.1, "bottom first"),
    ((202, 0, 0, 0), 6.9, "progressive"), ((0, 0, 0, 0), None, "undetermined"),
])
def test_field_order(spark, counts, gap, want):
    s = spark.createDataFrame([(1, *counts, 0, 0)], "file_id long, tff long, bff long, progressive long, undetermined long, repeated long, neither long")
    g = spark.createDataFrame([(1, gap)], "file_id long, gap_ratio double")
    assert one(scoring.field_order_verdict(s, g))["field_order"] == want


@pytest.mark.parametrize("metric,points,want", [
    ("psnr", [(40.0, 10), (None, 10)], 43.0103), ("psnr", [(None, 10)], None), ("ssimulacra2", [(80.0, 2), (None, 2)], None),
    ("xpsnr", [(40.0, 10), (30.0, 30)], 31.1079), ("butteraugli", [(2.0, 1), (6.0, 3)], 5.0),
])
def test_pool_scores(spark, metric, points, want):
    d = spark.createDataFrame([(1, metric, s, w) for s, w in points], "file_id long, metric string, score double, frames long")
    got = one(scoring.pool_scores(d, keys=["file_id"], weight="frames"))["score"]
    assert got is None if want is None else got == pytest.approx(want, abs=2e-3)


def test_recommendation(spark):
    rungs = [("ssimulacra2", 18, 90.0), ("ssimulacra2", 28, 82.0), ("ssimulacra2", 42, 60.0), ("butteraugli", 18, 1.0), ("butteraugli", 28, 3.0), ("butteraugli", 42, 7.0)]
    d = spark.createDataFrame([(1, *r) for r in rungs], "file_id long, metric string, crf long, score double")
    assert {r.metric: r.recommended_crf for r in scoring.recommend_rung(d).collect()} == {"ssimulacra2": 28, "butteraugli": 28}


def test_xpsnr_frames(spark):
    e = scoring.xpsnr_frame_error(F.lit(40.0), F.lit(30.0), F.lit(30.0))
    assert spark.range(1).select(scoring.error_score(e)).first()[0] == pytest.approx(33.9794, abs=1e-4)
    inf = F.lit(float("inf"))
    assert spark.range(1).select(scoring.error_score(scoring.xpsnr_frame_error(inf, inf, inf))).first()[0] is None


def test_slice_bounds(spark):
    f = spark.createDataFrame([(1, 5001, 4)], "file_id long, frames long, slices long")
    assert [r.from_frame for r in catalog.slice_bounds(f).orderBy("slice").collect()] + [5001] == [0, 1250, 2500, 3750, 5001]


def test_gain(spark):
    d = spark.createDataFrame([(-17.52, 0.05, -23.0, -1.0)], "integrated double, peak double, target_lufs double, peak_limit_db double")
    assert one(scoring.gain_proposal(d))["gain_tenths_db"] == -55


def test_sample_plan(spark):
    f = spark.createDataFrame([(1, 10.0), (2, 3600.0)], "file_id long, duration_s double")
    got = [(r.file_id, r.start_s, r.length_s) for r in scoring.plan_samples(f, 2, 20.0).orderBy("file_id", "sample").collect()]
    assert got == [(1, 0.0, 10.0), (2, 60 + 0.5 * 1740 - 10, 20.0), (2, 60 + 1.5 * 1740 - 10, 20.0)]


def test_duplicate_runs(spark):
    digest = {c: c * 64 for c in "abc"}
    f = spark.createDataFrame([(1, 0, i, i * 40, 40, digest[c]) for i, c in enumerate("aabbbcab")], "file_id long, stream_index long, ordinal long, t_us long, duration_us long, hash string")
    for size in (1, 3, 65536):
        r = one(compare.duplicate_run_profile(f, block_rows=size))
        assert (r["frames"], r["unique"], r["duplicates"], r["repeated_runs"], r["min_run"], r["max_run"]) == (8, 5, 3, 2, 1, 3)
        assert r["run_lengths"] == [1, 2, 3] and r["length_changes"] == 2 and r["ok"]


def heap_depth_ok(times, limit):
    import heapq

    heap, last, count = [], None, 0
    def emit():
        nonlocal last
        t = heapq.heappop(heap)
        good = last is None or t > last
        last = t
        return good
    good = True
    for t in times:
        heapq.heappush(heap, t)
        if len(heap) > limit:
            good &= emit()
    while heap:
        good &= emit()
    return good


def test_reorder_check_equals_a_bounded_heap(spark):
    r = random.Random(9)
    data, want = [], {}
    for f in range(60):
        n = r.randint(1, 14)
        times = list(range(n))
        for _ in range(r.randint(0, 4)):
            a, b = r.randrange(n), r.randrange(n)
            times[a], times[b] = times[b], times[a]
        if r.random() < 0.2 and n > 1:
            times[0] = times[-1]
        want[f] = heap_depth_ok(times, 3)
        data += [(f, 0, i, t * 1000) for i, t in enumerate(times)]
    p = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, pts_us long")
    rate = p.groupBy("file_id", "stream_index").agg(F.count("*").alias("expected_frames")).selectExpr("*", "25L rate_num", "1L rate_den", "1000000000000L tolerance_us")
    got = {x.file_id: x.ok for x in clocks.reorder_check(p, rate, limit=3, block_us=3000).collect()}
    assert got == want


def test_film_clock_falls_back(spark):
    f = spark.createDataFrame([(1, 0, i, round(i * 125e6 / 2997)) for i in range(2000)], "file_id long, stream_index long, ordinal long, t_us long")
    r = spark.createDataFrame([(1, 0, 24000, 1001, 50)], "file_id long, stream_index long, rate_num long, rate_den long, tolerance_us long")
    x = one(clocks.constant_clock_check(f, r))
    assert x["ok"] and x["reconciled"] and x["used_num"] == 2997


def test_leading_dts_limit(spark):
    n = 20
    src = packets(spark, [(i * 1000, None if i < n else i * 1000, 1000, 10) for i in range(40)]).withColumn("hash", F.lit("h"))
    out = packets(spark, [(i * 1000, i * 1000, 1000, 10) for i in range(40)]).withColumn("hash", F.lit("h"))
    r = one(compare.packet_fidelity_diff(src, out, reconstruct_initial_dts=True))
    assert r["first_bad"] == 16 and not r["ok"]
    r = one(compare.packet_fidelity_diff(src, out, reconstruct_initial_dts=True, leading_limit=20))
    assert r["ok"] and r["leading_without_dts"] == 20
    assert one(compare.packet_fidelity_diff(src, out))["first_bad"] == 0


def test_aac_stretch(spark):
    src = packets(spark, [(0, 0, 1000, 1), (9000, 9000, 1000, 1)]).withColumn("hash", F.lit("h"))
    out = packets(spark, [(0, 0, 9000, 1), (9000, 9000, 1000, 1)]).withColumn("hash", F.lit("h"))
    assert not one(compare.packet_fidelity_diff(src, out))["ok"]
    assert one(compare.packet_fidelity_diff(src, out, aac_reshape=True))["ok"]


def test_filler_before_a_cut(spark):
    src = packets(spark, [(i * 1_000_000, i * 1_000_000, 1_000_000, 5 + i) for i in range(6)]).withColumn("hash", F.concat(F.lit("h"), "size"))
    run = src.where("ordinal between 2 and 4").select("file_id", "stream_index", (F.col("ordinal") - 1).alias("ordinal"), (F.col("pts_us") + 500_000).alias("pts_us"),
                                                      (F.col("dts_us") + 500_000).alias("dts_us"), "duration_us", "size", "hash")
    filler = spark.createDataFrame([(1, 2, 0, 0, 0, 500_000, 2, "empty")], PACKETS + ", hash string")
    r = one(compare.locate_subsequence(src, run.unionByName(filler), shift_us=500_000, filler_hash="empty"))
    assert (r["start"], r["packets"], r["ok"]) == (2, 4, True)


def test_digest_depends_on_order_not_partitions(spark):
    p = packets(spark, [(i * 10, i * 10, 10, i % 7) for i in range(300)]).withColumn("hash", F.lit("h")).withColumn("flags", F.lit("K"))
    a = one(compare.ordered_digest(p, fan=4))["digest"]
    assert one(compare.ordered_digest(p.repartition(13).orderBy(F.rand(3)), fan=4))["digest"] == a
    swapped = p.withColumn("size", F.when(F.col("ordinal") == 8, 2).when(F.col("ordinal") == 9, 1).otherwise(F.col("size")))
    assert one(compare.ordered_digest(swapped, fan=4))["digest"] != a


def test_log_owner_names(spark):
    names = ["1-2-3.log", "1-2-3.mux.log.1", "1-2.log", "a-2-3.log", "1-2-3.txt", "9-9-9.log"]
    f = spark.createDataFrame([(n, 0) for n in names], "name string, modified_us long")
    known = spark.createDataFrame([("9-9-9",)], "job_id string")
    assert sorted(r.name for r in jobs.orphan_logs(f, known, F.lit(10**15)).collect()) == ["1-2-3.log", "1-2-3.mux.log.1"]


@pytest.mark.parametrize("total,done,want", [(236, [55, 11], (66, 2, True)), (60, [55, 11], (66, 2, False))])
def test_chunk_progress(spark, total, done, want):
    c = spark.createDataFrame([("j", str(i), n, True, 1) for i, n in enumerate(done)], "job_id string, chunk string, frames long, done boolean, bytes long")
    t = spark.createDataFrame([("j", total)], "job_id string, total_frames long")
    r = one(jobs.chunk_progress(c, t))
    assert (r["done_frames"], r["done_chunks"], r["ok"]) == want


def test_locale_order(spark):
    f = spark.createDataFrame([(1, n + ".png") for n in ["z", "Z", "å", "ä", "a", "A"]], "folder long, name string")
    order = lambda c: [r.name[0] for r in catalog.order_folder_frames(f, collation=c).orderBy("position").collect()]
    assert order("UNICODE") == ["a", "A", "å", "ä", "z", "Z"]
    assert order("sv")[-2:] == ["å", "ä"]


def test_cut_animated_cue(spark):
    c = spark.createDataFrame([(1, 0, "ass", 0, 5000, "{\\fad(1)}x", ["0"] * 8 + ["", "x"], ""), (1, 1, "srt", 990, 994, "y", [], "")],
                              "file_id long, n long, format string, start_ms long, end_ms long, body string, fields array<string>, settings string")
    e = spark.createDataFrame([(1, 7, 993, 4000)], "file_id long, edit_id long, from_ms long, to_ms long")
    got = {r.n: (r.reason, r.start_ms, r.end_ms) for r in cues.clip_cues(c, e).collect()}
    assert got[0][0] == "cut through an animated cue" and got[1] == (None, 0, 1)


def test_partition_invariance(spark):
    from reeltally.queries import stand_ins as v

    sf = "/root/testdata/sf0.001"
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            p = v.packets(spark, sf).orderBy(F.rand(n))
            results.append((
                sorted(map(str, clocks.timeline_summary(p.withColumnRenamed("pts_us", "t_us"), block_rows=5).collect())),
                sorted(map(str, compare.ordered_digest(p, fan=4).collect())),
                sorted(map(str, clocks.repair_timestamps(p, t="pts_us", block_rows=3).select("file_id", "stream_index", "ordinal", "repaired_us").collect())),
            ))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_colliding_tag_keys_keep_one_value(spark):
    from reeltally.functions import exprs as X

    d = spark.sql("select map('Title', '1', 'TITLE', '2', 'Other', '3', 'BPS', '4') as tags")
    assert d.select(X.stable_tags("tags").alias("t")).first().t == {"title": "2", "other": "3"}


def test_shared_folder_is_required_off_one_machine():
    import pytest

    from reeltally.plans.session import base_dir

    class Session:
        def __init__(self, **conf):
            self.conf = type("Conf", (), {"get": lambda _, k, d=None: conf.get(k, d), "set": lambda _, k, v: conf.update({k: v})})()

    with pytest.raises(ValueError):
        base_dir(Session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(ValueError):
        base_dir(Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert base_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    local = Session(**{"spark.master": "local[4]"})
    assert base_dir(local) == base_dir(local)


def test_last_header_above_a_record_counts(spark):
    from reeltally.sources import records as rec

    text = ["#tb 0: 1/24", "0, 0, 0, 1, 10, a", "#tb 0: 1/48", "0, 48, 48, 1, 10, b", "#tb 1: 1/10", "0, 24, 24, 1, 10, c"]
    d = spark.createDataFrame([("f", "f", i, x) for i, x in enumerate(text)], "file_id string, path string, n long, value string")
    rows, _ = rec.parse_frame_hashes(d)
    assert [r.pts_us for r in rows.orderBy("ordinal").collect()] == [0, 1_000_000, 500_000]


def test_inventory_keeps_whole_entries(spark):
    from reeltally.sources.documents import scan_inventory

    d = spark.createDataFrame([("/m/A.mkv", 10, 900), ("/m/a.mkv", 99, 5)], "path string, size_bytes long, modified_us long")
    rows, _ = scan_inventory(d, fold_case=True)
    assert [tuple(r) for r in rows.collect()] == [("/m/A.mkv", 10, 900)]


def test_next_neighbour_notices_a_gap(spark):
    import pytest
    from pyspark.errors import PySparkException

    from reeltally.plans.blocks import neighbours

    d = lambda ids: spark.createDataFrame([(1, 0, i) for i in ids], "file_id long, stream_index long, ordinal long")
    with pytest.raises(PySparkException):
        neighbours(d([0, 1, 2, 4, 5]), next=["ordinal"], block_rows=3).collect()
    got = neighbours(d(range(7)), next=["ordinal"], block_rows=3).orderBy("ordinal").collect()
    assert [r.next_ordinal for r in got] == [1, 2, 3, 4, 5, 6, None]


def test_verdict_of_document_sources(spark):
    from reeltally.sources.documents import parse_probe_documents
    from reeltally.sources.readers import file_verdict

    d = spark.createDataFrame([("/a.json", "not json")], "path string, value string")
    *frames, bad = parse_probe_documents(d)
    assert [(r.rows, r.rejected, r.ok) for r in file_verdict(frames[0], bad).collect()] == [(0, 1, False)]


def test_wide_rates_get_a_verdict(spark):
    from reeltally.operators.catalog import duplicate_target_check

    rate = "struct<num:long,den:long>"
    rows = [(1, 1000, 400, (60_000_000_000, 1_001_000_000), (24_000_000_000, 1_001_000_000)), (2, 10, 4, (9_000_000_000_000_000_001, 7), (1, 2))]
    d = spark.createDataFrame(rows, f"file_id long, frames long, unique long, source_rate {rate}, target_rate {rate}")
    assert [(r.expected_unique, r.reason) for r in duplicate_target_check(d).orderBy("file_id").collect()] == [(400, None), (None, "rate out of range")]


def test_layout_needs_every_field(spark):
    import pytest

    from reeltally.operators.catalog import compare_stream_layout

    d = spark.createDataFrame([(1, 0, "video")], "pair_id long, position long, kind string")
    with pytest.raises(ValueError):
        compare_stream_layout(d, d)


def test_display_matrices(spark):
    from reeltally.operators.headers import display_transform

    unit, last = 65_536, 1_073_741_824
    text = lambda *m: "\n".join(f"0000000{i}: {m[3 * i]} {m[3 * i + 1]} {m[3 * i + 2]}" for i in range(3))
    cases = [
        (text(unit, 0, 0, 0, unit, 0, 0, 0, last), (0, False, False)),
        (text(0, -unit, 0, unit, 0, 0, 160 * unit, -96 * unit, last), (90, False, True)),
        ("\n" + text(-unit, 0, 0, 0, unit, 0, 0, 0, last) + "\n", (0, True, False)),
        (text(unit, 1, 0, 0, unit, 0, 0, 0, last), None),
        (text(unit, 0, 0, unit, 0, 0, 0, 0, last), None),
        (text(unit, 0, 0, 0, unit, 0, 0, 0, last) + "\n00000003: 0 0 0", None),
        (text(unit, 0, 0, 0, unit, 0, 0, 0, last).replace("0 0 1073741824", "0 0 bad"), None),
        ("", None),
        (None, None),
    ]
    d = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i long, m string")
    got = [tuple(r.x) if r.x else None for r in d.select("i", display_transform("m").alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize("block_rows", [1, 2, 3, 5, 8, 1000])
def test_run_profile_equals_the_runs(spark, block_rows):
    """Blocks of any size, runs over many blocks, null hashes, gaps at edges."""
    r = random.Random(block_rows)
    data, want = [], {}
    for f in range(30):
        hashes = []
        while len(hashes) < r.randrange(1, 40):
            hashes += [r.choice(["a" * 64, "b" * 64, "c" * 64, None, "x"])] * r.choice([1, 1, 2, 3, 9])
        t, times, gap = 0, [], None
        for i in range(len(hashes)):
            if r.random() < 0.03:
                t += 5
                gap = i if gap is None and i else gap
            dur = r.choice([10, 12])
            times.append((t, dur))
            t += dur
        runs = [len(list(g)) for _, g in itertools.groupby(hashes)]
        want[f] = (
            len(hashes), len(runs), len(hashes) - len(runs), sum(n > 1 for n in runs), min(runs), max(runs), sorted(set(runs)), sum(a != b for a, b in zip(runs, runs[1:])),
            gap, sum(h in (None, "x") for h in hashes),
        )
        data += [(f, 0, i, *times[i], h) for i, h in enumerate(hashes)]
    r.shuffle(data)
    d = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, t_us long, duration_us long, hash string")
    out = compare.duplicate_run_profile(d, block_rows=block_rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hash") <= 4 and "Python" not in plan
    assert {x.file_id: tuple(x)[2:12] for x in out.collect()} == want


def test_run_profile_needs_dense_ordinals(spark):
    d = spark.createDataFrame([(1, 0, i, i, 1, "a" * 64) for i in (0, 1, 3)], "file_id long, stream_index long, ordinal long, t_us long, duration_us long, hash string")
    for block_rows in (1, 2, 1000):
        with pytest.raises(Exception, match="not dense"):
            compare.duplicate_run_profile(d, block_rows=block_rows).collect()


@pytest.mark.parametrize("block_us", [1000, 7000, 10**9])
def test_reorder_facts(spark, block_us):
    """Depth, ties, residual and counts by sorting whole streams; untimed rows, negative times, no rate for a stream."""
    r = random.Random(block_us)
    data, want = [], {}
    for f in range(20):
        rows = [None if r.random() < 0.05 and f % 3 == 0 else 40_000 * i + r.randrange(-90_000, 90_000) // (1 + f % 5 * 9) for i in range(r.randrange(1, 60))]
        if f == 7:
            rows = [None, None]
        data += [(f, 0, i, t) for i, t in enumerate(rows)]
        timed = sorted((t, i) for i, t in enumerate(rows) if t is not None)
        off = [abs(t - k * 40_000 - 5) for k, (t, _) in enumerate(timed)]
        want[f] = (
            len(rows), rows.count(None), max((i - k for k, (_, i) in enumerate(timed)), default=None), len(timed) - len({t for t, _ in timed}) if timed else None, max(off, default=None),
        )
    p = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, pts_us long")
    schema = "file_id long, stream_index long, rate_num long, rate_den long, tolerance_us long, expected_frames long, origin_us long"
    rates_ = spark.createDataFrame([(f, 0, 25, 1, 50, 10, 5) for f in range(19)], schema)
    out = clocks.reorder_check(p, rates_, block_us=block_us)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[file_id#") <= 2 and plan.count("Exchange hash") <= 5
    got = {x.file_id: (x.packets, x.untimed, x.max_depth, x.duplicates, x.max_residual_us) for x in out.collect()}
    del want[19]
    assert got == want


def fidelity(left, right, limit):
    """(matched, missing, extra, first_bad, leading) of two lists of (pts, dts, duration, size, hash) by one walk; both leading rules on."""
    near = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) <= 2000
    seen, bad, leading, used = [False, False], None, 0, 0
    for i in range(max(len(left), len(right))):
        l, r = left[i] if i < len(left) else None, right[i] if i < len(right) else None
        wrong = l is None or r is None
        if not wrong:
            same = l[3:] == r[3:] and near(l[0], r[0]) and (l[2] is None or r[2] is None or near(l[2], r[2]))
            wrong = not same
            if same and not near(l[1], r[1]):
                wrong = True
                if (l[1] is None) != (r[1] is None):
                    full, prev, k = (r, right[i - 1][1] if i else None, 0) if l[1] is None else (l, left[i - 1][1] if i else None, 1)
                    if not seen[k] and full[0] is not None and full[1] <= full[0] and (prev is None or full[1] >= prev):
                        used += 1
                        wrong = used > limit
        seen = [seen[0] or l is not None and l[1] is not None, seen[1] or r is not None and r[1] is not None]
        if wrong and bad is None:
            bad = i
    return min(len(left), len(right)), max(len(left) - len(right), 0), max(len(right) - len(left), 0), bad, used


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7, 65536])
def test_fidelity_by_one_walk(spark, block_rows):
    r = random.Random(5)
    left, right, want = [], [], {}
    for f in range(40):
        n = r.randrange(1, 25)
        a = [(i * 1000 + 3000, i * 1000 + r.choice([0, 0, 0, 400]), r.choice([None, 1000]), r.randrange(3), "h") for i in range(n)]
        b = list(a)
        cut = r.randrange(0, 12)
        side = a if r.random() < 0.5 else b
        for i in range(min(cut, n)):
            if r.random() < 0.9:
                side[i] = (*side[i][:1], None, *side[i][2:])
        for _ in range(r.randrange(3)):
            i = r.randrange(n)
            b[i] = (b[i][0] + r.choice([0, 5000]), *b[i][1:3], r.randrange(3), b[i][4])
        b = b[: n - r.choice([0, 0, 0, 2])] + [(1, 1, 1, 1, "x")] * r.choice([0, 0, 0, 1])
        want[f] = fidelity(a, b, 4)
        left += [(f, 0, i, *x) for i, x in enumerate(a)]
        right += [(f, 0, i, *x) for i, x in enumerate(b)]
    schema = "file_id long, stream_index long, ordinal long, pts_us long, dts_us long, duration_us long, size long, hash string"
    out = compare.packet_fidelity_diff(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), reconstruct_initial_dts=True, omit_initial_dts=True, leading_limit=4, block_rows=block_rows
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Exchange hash") <= 3 and "Python" not in plan
    got = {x.file_id: (x.matched, x.missing, x.extra, x.first_bad, x.leading_without_dts) for x in out.collect()}
    assert got == want
