"""Streams against their batch twins, over several micro-batches."""

import random

import pandas as pd
from pyspark.sql import functions as F

from reeltally.operators import clocks, rates, thinning
from reeltally.queries import stand_ins as v
from reeltally.streaming import native, stateful
from reeltally.streaming.runner import open_stream, run_available


def arriving(spark, df, path, files=3):
    """Writes ``df`` as several files in order and opens them one per micro-batch."""
    for i in range(files):
        df.where(F.pmod(F.col("arrival"), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    return open_stream(spark, path, df.schema, files_per_trigger=1)


def rows(df):
    return sorted(map(str, df.collect()))


def test_windowed_rate(spark, sf, tmp_path):
    p = v.packets(spark, sf).select("file_id", "stream_index", F.coalesce("pts_us", "dts_us").alias("t_us"), "size", F.col("ordinal").alias("arrival"))
    w = 6 * 3600 * 1_000_000
    s = arriving(spark, p, str(tmp_path / "in"))
    out = run_available(native.stream_windowed_rate(s, w, watermark="60 days"))
    assert out.select("batch").distinct().count() > 1
    got = native.fill_windows(out, w).select("file_id", "stream_index", "start_us", "packet_bytes")
    want = rates.windowed_rate(p.withColumnRenamed("t_us", "pts_us").withColumn("dts_us", F.lit(None).cast("long")), w).drop("mbps")
    assert rows(got) == rows(want)


def test_clock_check(spark, tmp_path):
    r = random.Random(3)
    data = []
    for f in range(4):
        for i in range(50):
            t = i * 1000 + r.randint(-40, 40) - (f == 2 and i == 31) * 2500 + (f == 3 and i == 32) * 700
            data.append((f, 0, i, t, i // 17))
    d = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, t_us long, arrival long")
    s = arriving(spark, d, str(tmp_path / "in"))
    out = run_available(stateful.stream_clock_check(s, frame_us=1000.0, origin_us=0.0, tolerance_us=600.0, part_rows=8))
    got = {x.file_id: (x.frames, x.first_bad, x.reason) for x in stateful.clock_verdict(out).collect()}
    assert got == {0: (50, None, None), 1: (50, None, None), 2: (50, 31, "timestamps not strictly increasing"), 3: (50, 32, "not a constant frame clock")}
    mono = {x.file_id: x.first_bad for x in clocks.monotone_check(d, block_rows=8).collect()}
    assert mono[2] == 31 and mono[0] is None


def log(seed, n=300):
    r = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 100, 900, 2500, 9000, 14000])
        out.append((1 + i % 2, i // 2, t, r.random() < 0.8, f"frame {r.randint(0, 2)}"))
    return out


COLS = "job_id long, n long, t_ms long, redraw boolean, text string"


def reference_thin(data):
    out = []
    for job in (1, 2):
        pdf = pd.DataFrame([d for d in data if d[0] == job], columns=["job_id", "n", "t_ms", "redraw", "text"])
        kept, _, held = stateful.thin_rows(pdf, None, None)
        out += [(job, *k) for k in kept + ([held] if held else [])]
    return sorted(out)


def test_batch_thinning_equals_the_row_rule(spark):
    for seed in (1, 2):
        data = log(seed)
        d = spark.createDataFrame(data, COLS)
        for block in (20_000, 10**9):
            got = sorted(tuple(r) for r in thinning.thin_log(d, block_ms=block).collect())
            assert got == reference_thin(data), (seed, block)


def test_stream_thinning(spark, tmp_path):
    data = log(5)
    d = spark.createDataFrame(data, COLS).withColumn("arrival", F.expr("n div 60"))
    out = run_available(stateful.thin_progress_log(arriving(spark, d, str(tmp_path / "in"))))
    got = sorted((r.job_id, r.n, r.t_ms, r.text) for r in out.collect())
    want = reference_thin(data)
    assert set(got) <= set(want) and len(want) - len(got) <= 2
    ended = d.withColumn("last", F.col("n") == 149)
    out = run_available(stateful.thin_progress_log(arriving(spark, ended, str(tmp_path / "ended"))))
    assert sorted((r.job_id, r.n, r.t_ms, r.text) for r in out.collect()) == want


def test_estimates(spark, tmp_path):
    seen = [(t * 1000, t * 2.0) for t in range(0, 12)]
    d = spark.createDataFrame([(1, "run", i, t, p, 100.0, i) for i, (t, p) in enumerate(seen)],
                              "job_id long, phase string, seq long, t_ms long, progress double, duration double, arrival long")
    out = run_available(stateful.progress_estimate(arriving(spark, d.withColumn("arrival", F.expr("seq div 4")), str(tmp_path / "in")), timers=False))
    got = {r.t_ms: (r.kind, r.speed, r.remaining_s) for r in out.collect()}
    assert got[4000] == (None, None, None)
    assert got[5000] == ("estimate", 2.0, 45.0) and got[11000] == ("estimate", 2.0, 39.0)


def estimated(spark, tmp_path, seen, each=10**6):
    """Kinds and speeds by time, with ``each`` observations to a micro-batch."""
    rows = [(1, phase, i, t, p, 100.0, i // each) for i, (phase, t, p) in enumerate(seen)]
    d = spark.createDataFrame(rows, "job_id long, phase string, seq long, t_ms long, progress double, duration double, arrival long")
    out = run_available(stateful.progress_estimate(arriving(spark, d, str(tmp_path / f"in{each}"), files=-(-len(seen) // each)), timers=False))
    return [(r.t_ms, r.kind, r.speed) for r in out.orderBy("t_ms").collect()]


def test_estimate_rules(spark, tmp_path):
    seen = [("a", 0, 0.0), ("a", 4_999, 2.0), ("a", 6_000, 3.0), ("a", 14_000, 3.0), ("a", 20_999, 3.0), ("a", 21_000, 4.0), ("a", 27_000, 10.0),
            ("a", 28_000, 9.0), ("a", 34_000, 15.0), ("b", 35_000, 20.0), ("b", 40_000, 25.0), (None, 41_000, 26.0), ("b", 42_000, 27.0), ("b", 47_000, -1.0), ("b", 48_000, 40.0)]
    want = [(0, None, None), (4_999, None, None), (6_000, "estimate", 0.5), (14_000, "estimate", 3 / 14), (20_999, "estimate", 3 / 20.999), (21_000, None, None), (27_000, "estimate", 1.0),
            (28_000, None, None), (34_000, "estimate", 1.0), (35_000, None, None), (40_000, "estimate", 1.0), (41_000, None, None), (42_000, None, None), (47_000, None, None), (48_000, None, None)]
    for each in (10**6, 4):
        assert estimated(spark, tmp_path, seen, each) == want, each


def test_silence_is_waiting_and_the_window_moves(spark, tmp_path):
    assert estimated(spark, tmp_path, [("a", 0, 0.0), ("a", 14_999, 0.0), ("a", 15_000, 0.0)])[1:] == [(14_999, None, None), (15_000, "waiting", None)]
    quick = [("a", t * 500, 0.25 * t if t < 80 else 20.0 + (t - 80) * 1.0) for t in range(160)]
    for each in (31,):
        got = estimated(spark, tmp_path, quick, each)
        assert got[-1][1] == "estimate" and got[-1][0] == 79_500
        # From the last sample at or before 49.5 s: that of 49.5 s itself.
        assert got[-1][2] == (99.0 - 39.0) / 30.0


def test_a_late_halo_changes_nothing(spark, tmp_path):
    """Part 1 arrives before the row it continues from; a later step back must still be found."""
    t = [i * 1000 for i in range(16)]
    t[12] = 10_500
    data = [(0, 0, i, t[i], 0 if 8 <= i < 12 else 1 if i < 8 else 2) for i in range(16)]
    d = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, t_us long, arrival long")
    out = run_available(stateful.stream_clock_check(arriving(spark, d, str(tmp_path / "in")), frame_us=1000.0, origin_us=0.0, tolerance_us=5000.0, part_rows=8))
    assert [(x.frames, x.first_bad, x.reason) for x in stateful.clock_verdict(out).collect()] == [(16, 12, "timestamps not strictly increasing")]
    t = [i * 1000 for i in range(16)]
    t[8] = 6_900
    data = [(0, 0, i, t[i], 0 if i >= 8 else 1) for i in range(16)]
    d = spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, t_us long, arrival long")
    out = run_available(stateful.stream_clock_check(arriving(spark, d, str(tmp_path / "two")), frame_us=1000.0, origin_us=0.0, tolerance_us=5000.0, part_rows=8))
    assert [(x.frames, x.first_bad) for x in stateful.clock_verdict(out).collect()] == [(16, 8)]


def test_a_hot_log_is_nobodys_chain(spark):
    """One job with most of the lines: it is thinned without Python, and no task has most of the rows."""
    hot = [(1, i, i * 70, i % 9 != 4, f"frame {i % 5}") for i in range(6000)]
    data = hot + [(2, i, i * 5000, True, "x") for i in range(300)]
    out = thinning.thin_log(spark.createDataFrame(data, COLS), block_ms=30_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert sorted(tuple(r) for r in out.collect()) == reference_thin(data)
    leads = thinning._leads(spark.createDataFrame([(j, t) for j, _, t, _, _ in data], "job_id long, t_ms long").distinct(), 10_000, 30_000)
    sizes = [len(p) for p in leads.repartition(8, "job_id", "t_ms").rdd.glom().collect()]
    assert max(sizes) < sum(sizes) / 4


def out_of_order(spark, df, path, span, spread):
    """Rows by event time over many files, some of them up to ``span`` late, and a last row that moves the watermark."""
    d = df.withColumn("arrival", F.expr(f"(t_ms + pmod(hash(t_ms), 4) * {spread}) div {span}"))
    end = d.agg((F.max("t_ms") + 10_000_000).alias("t_ms"), (F.max("arrival") + 1).alias("arrival"))
    d = d.unionByName(end, allowMissingColumns=True)
    files = d.agg(F.max("arrival")).first()[0] + 1
    assert files >= 8
    return arriving(spark, d, path, files=files)


def test_thinning_out_of_order(spark, tmp_path):
    data = log(7, 240)
    d = spark.createDataFrame(data, COLS)
    last = F.col("n") == 119
    s = out_of_order(spark, d.withColumn("last", last), str(tmp_path / "in"), 60_000, 15_000)
    out = run_available(stateful.thin_progress_log(s, delay="70 seconds"), mode="append")
    assert out.select("batch").distinct().count() > 4
    assert sorted((r.job_id, r.n, r.t_ms, r.text) for r in out.collect()) == reference_thin(data)


def test_estimates_out_of_order(spark, tmp_path):
    r = random.Random(11)
    seen, t, p = [], 0, 0.0
    for i in range(220):
        t += r.choice([200, 700, 1500, 4000, 16_000] if i % 40 == 7 else [200, 700, 1500])
        p += r.choice([0.0, 0.5, 1.5])
        seen.append((1 + i % 2, "ab"[i // 90 % 2], i, t, p, 500.0))
    schema = "job_id long, phase string, seq long, t_ms long, progress double, duration double"
    d = spark.createDataFrame(seen, schema)
    out = run_available(stateful.progress_estimate(out_of_order(spark, d, str(tmp_path / "in"), 16_000, 4_000), delay="20 seconds"), mode="append")
    got = sorted((x.job_id, x.t_ms, x.kind or "", x.speed or 0.0) for x in out.collect())
    want = []
    for job in (1, 2):
        rows_ = pd.DataFrame([s for s in seen if s[0] == job], columns=["job_id", "phase", "seq", "t_ms", "progress", "duration"])
        one, _ = stateful.estimates(rows_, pd.DataFrame({"t_ms": [], "phase": [], "progress": []}))
        want += [(job, x.t_ms, x.kind if isinstance(x.kind, str) else "", 0.0 if pd.isna(x.speed) else x.speed) for x in one.itertuples()]
    assert got == sorted(want)


def test_the_buffer_holds_what_the_delay_spans():
    class Value:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        timers: set = set()
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    buffer, r, out, most = stateful.Reorder(Handle(), {"t_ms": "bigint", "n": "bigint"}), random.Random(1), [], 0
    for i in range(100):
        times = [max(i * 3000 - r.randrange(9000), 0) for _ in range(20)]
        buffer.hold(iter([pd.DataFrame({"t_ms": times, "n": range(i * 20, i * 20 + 20)})]))
        assert len(Handle.timers) == 1
        if min(Handle.timers) <= i * 3000 - 12_000:
            Handle.timers.clear()
            buffer.due.clear()
            out.append(buffer.release(i * 3000 - 12_000, ["t_ms", "n"]))
        most = max(most, len(buffer.rows))
    assert most <= 22
    out.append(buffer.release(10**9, ["t_ms", "n"]))
    done = pd.concat(out)
    assert len(done) == 2000 and done["t_ms"].is_monotonic_increasing and not buffer.rows and not Handle.timers


def test_rate_and_late_rows(spark, tmp_path):
    r = random.Random(4)
    day = 1_000_000
    rows_ = []
    for batch in range(8):
        for i in range(200):
            late = 4 * day if r.random() < 0.05 else 0
            rows_.append((1 if r.random() < 0.8 else 2, 0, max(batch * day + r.randrange(day) - late, 0), r.randrange(100), batch))
    d = spark.createDataFrame(rows_, "file_id long, stream_index long, t_us long, size long, arrival long")
    window, delay = day // 2, day
    s = arriving(spark, d, str(tmp_path / "in"), files=8)
    out = run_available(stateful.stream_rate_and_late(s, window, f"{delay} microseconds", salts=3), mode="append")
    sums, late, mark = {}, [], -(10**18)
    for batch in range(8):
        for f, _, t, size, b in rows_:
            if b == batch:
                start = t // window * window
                if start + window <= mark:
                    late.append((f, start, t, size))
                else:
                    n, total = sums.get((f, start), (0, 0))
                    sums[f, start] = n + 1, total + size
        mark = max(mark, max(t for _, _, t, _, b in rows_ if b == batch) // 1000 * 1000 - delay)
    assert sorted((x.file_id, x.start_us, x.t_us, x.packet_bytes) for x in out.where("kind = 'late'").collect()) == sorted(late) and late
    closed = {(x.file_id, x.start_us): (x.packets, x.packet_bytes) for x in stateful.closed_windows(out).collect()}
    assert closed == {k: v for k, v in sums.items() if k[1] + window <= mark}


def test_clocks_that_begin_before_zero(spark, tmp_path):
    """Nothing is late before the watermark has moved, not even at time zero or below."""
    data = [(1, i, t, True, f"frame {i}") for i, t in enumerate([-25_000, -12_000, -500, 0, 1, 9_000, 12_000])]
    d = spark.createDataFrame(data, COLS).withColumn("last", F.col("n") == 6)
    d = d.withColumn("arrival", F.expr("n div 2")).unionByName(spark.createDataFrame([(10**7, 4)], "t_ms long, arrival long"), allowMissingColumns=True)
    out = run_available(stateful.thin_progress_log(arriving(spark, d, str(tmp_path / "in"), files=5), delay="30 seconds"), mode="append")
    assert sorted((r.job_id, r.n, r.t_ms, r.text) for r in out.collect()) == reference_thin(data)
    p = spark.createDataFrame([(1, 0, t, 5, i) for i, t in enumerate([-700_000, -300_000, 0, 900_000])], "file_id long, stream_index long, t_us long, size long, arrival long")
    out = run_available(stateful.stream_rate_and_late(arriving(spark, p, str(tmp_path / "rate"), files=4), 500_000, "0 seconds", salts=1), mode="append")
    assert out.where("kind = 'late'").count() == 0
    assert sorted((r.start_us, r.packets) for r in stateful.closed_windows(out).collect()) == [(-1_000_000, 1), (-500_000, 1), (0, 1)]


class PlainState:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class PlainHandle:
    """State and timers of one key."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return PlainState()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_jobs_of_a_bucket_are_worked_on_together():
    """Many jobs in one call give what each gives alone; one state value holds them all."""
    r = random.Random(5)
    seen = [(1 + i % 7, i, 400 * i, r.random() < 0.8, f"x{r.randrange(3)}", i >= 1393) for i in range(1400)]
    lines = pd.DataFrame(seen, columns=["job_id", "n", "t_ms", "redraw", "text", "last"])
    thin = stateful.ThinProcessor(False)
    thin.init(PlainHandle())
    got = pd.concat([thin._thinned(lines[a : a + 350].sort_values(["job_id", "n"])) for a in range(0, 1400, 350)])
    want = []
    for job, part in lines.groupby("job_id"):
        out, _, held = stateful.thin_rows(part, None, None)
        want += [(job, *line) for line in [*out, *([held] if held else [])]]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)

    rows = pd.DataFrame([(1 + i % 7, "a", i, 130 * i, i // 7 * 0.5 + (i % 5 == 0), 900.0) for i in range(1400)], columns=["job_id", "phase", "seq", "t_ms", "progress", "duration"])
    many = stateful.ProgressProcessor("arrival")
    many.init(PlainHandle())
    got = pd.concat([many._estimated(rows[a : a + 350].sort_values(["job_id", "t_ms"])) for a in range(0, 1400, 350)]).sort_values(["job_id", "t_ms"], ignore_index=True)
    none = pd.DataFrame({"job_id": [], "t_ms": [], "phase": [], "progress": []})
    want = pd.concat([stateful.estimates(part, none)[0] for _, part in rows.groupby("job_id")], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_windows_of_a_slot_share_a_call():
    handle, epoch = PlainHandle(), stateful.EPOCH_MS
    rate = stateful.RateProcessor(1_000_000)
    rate.init(handle)
    at = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: epoch + ms})()
    part = pd.DataFrame({"start": [0, 1_000_000, 1_000_000, 5_000_000], "t_us": [1, 1_000_001, 1_000_002, 5_000_000], "size": [1, 2, 3, 4]})
    assert list(rate.handleInputRows((9, 0, 0), iter([part]), at(-1))) == [] and handle.timers == {epoch + 1000}
    late = pd.concat(list(rate.handleInputRows((9, 0, 0), iter([part[:2]]), at(1000))))
    assert late[["kind", "start_us", "t_us"]].values.tolist() == [["late", 0, 1]]
    handle.timers.clear()
    done = pd.concat(list(rate.handleExpiredTimer((9, 0, 0), at(2500), None)))
    assert done[["start_us", "packets", "packet_bytes"]].values.tolist() == [[0, 1, 1], [1_000_000, 3, 7]] and handle.timers == {epoch + 6000}
