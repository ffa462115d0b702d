"""Cutting JSON documents into records, split by split, against the json module."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reeltally.sources import json_splits as js
from reeltally.sources import readers
from reeltally.sources import records as rec
from reeltally.sources.lines import read_documents

values = st.recursive(
    st.none() | st.integers(-9, 9) | st.text(alphabet='ab"\\}{][:,é\n', max_size=6),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["k", "x", 'q"', "}"]), x, max_size=3),
    max_leaves=8,
)
objects = st.dictionaries(st.sampled_from(["a", "b", "x", "}{"]), values, max_size=3)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["p", "q", "]"]), values, max_size=3), st.lists(objects, max_size=5), st.dictionaries(st.sampled_from(["r", "s"]), values, max_size=2), st.booleans(), st.data())
def test_any_cuts_give_the_records(head, records, tail, pretty, data):
    doc = {**head, "x": records, **tail}
    text = json.dumps(doc, indent=1 if pretty else None, ensure_ascii=False).encode()
    rows = text.split(b"}")[:-1]
    edges = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=4)))
    pieces = [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)]) if a < b]
    inside, depth, target, n = False, 0, False, 0
    found, held, quotes, total = {}, b"", 0, 0
    for piece in pieces:
        raw = js._bytes(piece)
        # The first scan: what this part does, for either beginning, against what the second scan does.
        _, code, even, q = js.structure(raw, b"x")
        delta, table = js.levels(code[even != inside])
        at = next((x for x in table if x["level"] == 2 - depth), None)
        number, begin, stop, after = js.cut(raw, b"x", inside, depth, target, n)
        assert after[1] == depth + delta and after[0] == ((q + inside) % 2 == 1)
        if at:
            assert after[2] == (at["event"] == 1 if at["event"] >= 0 else target)
            assert not after[2] or after[3] == (at["since"] if at["event"] >= 0 else n + at["before"])
            total += at["inside"] + (at["before"] if target else 0)
        else:
            assert after[2:] == (target, n)
        for k, a, b in zip(number.tolist(), begin.tolist(), stop.tolist()):
            if a >= 0:
                held = b""
            held += raw.tobytes()[max(a, 0) : b if b >= 0 else None]
            if b >= 0:
                assert k not in found
                found[k] = json.loads(held)
        inside, depth, target, n = after
    assert (inside, depth, target) == (False, 0, False)
    assert found == dict(enumerate(records)) and total == len(records)


def test_key_must_be_a_whole_name():
    for text, wanted in [(b'{"x":[', 1), (b'{ "x"\n: [', 1), (b'{"ax":[', 0), (b'{"\\"x":[', 0), (b'{"x",[', 0), (b'["x":[', 1), (b"[", 0), (b'"x":[', 1), (b'x":[', 0)]:
        _, code, _, _ = js.structure(np.frombuffer(text, np.uint8), b"x")
        assert (code == js.WANTED).sum() == wanted, text


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "3000")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_documents_by_many_tasks(spark, tmp_path, small_splits):
    r = random.Random(3)
    docs = {
        "a": {"note": "}{][\"\\", "frames": [{"i": i, "t": "x}\\" * r.randrange(40), "m": {"v": {"w": [i, {"z": 1}]}}} for i in range(700)], "end": [{"i": -1}]},
        "b": {"other": {"frames": [{"i": 5}]}, "frames": [{"i": i} for i in range(3)]},
        "c": {"frames": []},
        "d": {"frames": [{"i": 0, "t": "y" * 20_000}, {"i": 1}]},
        "e": {"none": 1},
        "f": {"frames": None},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2 if name in "bd" else None) + ("\n" if name == "b" else ""))
    (tmp_path / "g.json").write_text('{"frames": [{"i": 1}, {"i": 2')
    (tmp_path / "h.json").write_text('{"frames": [{"i": 1}]}{"frames": [{"i": 2}]}')
    (tmp_path / "i.json").write_text('{"frames": [{"i": 1}], "frames": [{"i": 2}]}')
    (tmp_path / "j.json").write_text('﻿{"frames": [{"i": 1}]}')
    (tmp_path / "k.json").write_text("  \n")
    records, documents = js.read_json_records(spark, str(tmp_path), "frames", glob="*.json")
    got = {}
    for row in records.collect():
        got.setdefault(row.path[-6], {})[row.n] = json.loads(row.value)
    assert got == {name: dict(enumerate(docs[name]["frames"])) for name in "abd"} | {"j": {0: {"i": 1}}}
    assert len(records.select("path", "n").distinct().collect()) == records.count()
    facts = {row.path[-6]: (row.records, row.reason) for row in documents.collect()}
    assert facts == {
        "a": (700, None), "b": (3, None), "c": (0, None), "d": (2, None), "e": (0, "no array"), "f": (0, "no array"), "g": (2, "unreadable document"),
        "h": (2, "unreadable document"), "i": (2, "repeated array"), "j": (1, None), "k": (0, "unreadable document"),
    }


GOOD = {
    "best_effort_timestamp_time": "1.5", "interlaced_frame": 0, "sample_aspect_ratio": "1:1", "width": 64, "height": "36", "pix_fmt": "yuv420p", "color_range": "tv",
    "color_space": "bt709", "color_transfer": "bt709", "color_primaries": "bt709", "chroma_location": "left",
}


def test_frame_documents_as_whole_ones(spark, tmp_path, small_splits):
    """Rows and quarantine are those of documents read as one row each."""
    frames = [GOOD | {"best_effort_timestamp_time": str(i / 25), "side": {"data": [{"type": "x}"}]}} for i in range(300)]
    frames[7] = {k: v for k, v in GOOD.items() if k != "best_effort_timestamp_time"}
    frames[200] = GOOD | {"pix_fmt": "rgb24"}
    for name, text in {"one": json.dumps({"frames": frames}), "two": json.dumps({"frames": frames[::-1], "format": {}}, indent=1), "bad": "{", "none": '{"streams": []}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, bad = readers.read_frame_documents(spark, str(tmp_path))
    want_rows, want_bad = rec.parse_frame_documents(read_documents(spark, str(tmp_path), glob="*.json"))
    plain = lambda d: sorted(str(r) for r in d.collect())
    assert plain(rows) == plain(want_rows) and rows.count() == 596
    assert plain(bad.drop("value")) == plain(want_bad.drop("value"))


def test_metric_and_scene_documents(spark, tmp_path, small_splits):
    frames = [{"frameNum": i, "metrics": {"vmaf": 90 + i / 100, "psnr": 1}} for i in range(400)]
    frames[3] = {"metrics": {"vmaf": 1}}
    frames[4] = {"frameNum": 4, "metrics": {}}
    frames[5] = {"frameNum": 5, "metrics": {"vmaf": 1001.0}}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"version": "1", "frames": frames, "pooled_metrics": {"vmaf": {"min": 1}}}))
    (tmp_path / "m" / "b.json").write_text('{"frames": [{"frameNum": 0, "metrics": {"vmaf": 1.0}}, {"frameNum": }]}')
    rows, bad = readers.read_metric_reports(spark, str(tmp_path / "m"), "vmaf")
    assert sorted(r.n for r in rows.where("score > 2").collect()) == [0, 1, 2, *range(6, 400)]
    assert sorted((r.n, r.reason) for r in bad.collect()) == [(1, "unreadable record"), (3, "no frame number"), (4, "no metric value"), (5, "score out of range")]

    (tmp_path / "s").mkdir()
    scenes = [{"SceneFrameIndex": 0, "SequenceFrameIndex": i, "NumberOfWindows": 1, "SceneId": i // 50, "LuminanceParameters": {"Values": [1, {"a": 2}]}} for i in range(200)]
    text = {"good": scenes, "short": scenes[:-1], "odd": [*scenes[:9], {**scenes[9], "NumberOfWindows": 2}, *scenes[10:]]}
    for name, one in text.items():
        (tmp_path / "s" / f"{name}.json").write_text(json.dumps({"JSONInfo": {"HDR10plusProfile": "B"}, "SceneInfo": one, "SceneInfoSummary": {"SceneFirstFrameIndex": [0]}}))
    paths = spark.read.text(str(tmp_path / "s")).select(F.col("_metadata.file_path").alias("path")).distinct()
    rows, bad = readers.read_dynamic_metadata(spark, str(tmp_path / "s"), paths.withColumn("frames", F.lit(200)))
    assert {(r.path[-8:-5], r.reason) for r in bad.collect()} == {("ort", "record count differs"), ("odd", "invalid frame index or windows")}
    assert rows.count() == 200 and [r.scene_id for r in rows.where("frame = 150").collect()] == [3]


def test_closing_brackets_in_strings_cost_no_more(spark, tmp_path):
    """Read as if it began inside a string, this document falls by a level with every record; time was the square of their number."""
    import time

    frames = [{"i": i, "t": "}],"} for i in range(200_000)]
    (tmp_path / "a.json").write_text(json.dumps({"frames": frames}))
    begun = time.perf_counter()
    records, documents = js.read_json_records(spark, str(tmp_path), "frames", glob="*.json")
    assert records.agg(F.count("n"), F.sum("n")).first() == (200_000, 200_000 * 199_999 // 2)
    assert [r.reason for r in documents.collect()] == [None]
    assert time.perf_counter() - begun < 60
