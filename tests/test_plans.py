"""Plan properties that keep hot streams out of single tasks."""

import re

import pytest

import __spark_entry__ as entry

STITCHED = [
    "timeline_summary", "monotone_check", "constant_clock_check", "reorder_check", "ordered_clock_check", "repair_timestamps", "tiling_check",
    "audio_continuity", "concat_timelines", "clock_digest", "duplicate_run_profile", "snap_to_keyframe", "grain_coverage", "cue_quality",
    "drop_probe_noise", "read_packet_records", "read_frame_hashes", "scene_slice_verdict", "validate_report", "order_folder_frames",
]


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", STITCHED)
def test_windows_are_blocked_or_over_block_summaries(spark, sf, name):
    windows = [x for x in plan(spark, sf, name).splitlines() if re.search(r"\bWindow \[", x)]
    assert windows, "expected a stitched window"
    for w in windows:
        assert "__block" in w, w


@pytest.mark.parametrize("name", ["packet_totals", "constant_clock_check", "pool_scores", "crop_consensus", "chunk_progress", "gain_proposal"])
def test_aggregates_stay_in_the_jvm(spark, sf, name):
    p = plan(spark, sf, name)
    assert "Python" not in p and "Pandas" not in p


@pytest.mark.parametrize("name, scans, exchanges", [
    ("packet_fidelity_diff", 2, 7), ("duplicate_run_profile", 2, 6), ("reorder_check", 3, 7), ("locate_subsequence", 3, 12),
])
def test_passes_over_the_input(spark, sf, name, scans, exchanges):
    """Scans and exchanges with those of the tables they stand on, which number their rows in two scans; without adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(spark, sf, name)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"FileScan", p)) <= scans and len(re.findall(r"\bExchange ", p)) <= exchanges, p


def test_flagship_reads_only_what_it_needs(spark, sf):
    p = plan(spark, sf, "windowed_rate")
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert "props" not in schema and "event_type" not in schema


def test_strict_aborts(spark, sf):
    from pyspark.errors import PySparkException

    from reeltally.operators.clocks import monotone_check
    from reeltally.plans.verdicts import strict
    from reeltally.queries import stand_ins as v

    bad = monotone_check(v.packets(spark, sf), t="pts_us")
    assert bad.where("not ok").count() > 0
    with pytest.raises(PySparkException):
        strict(bad).collect()
