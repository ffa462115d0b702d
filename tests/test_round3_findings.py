"""What the findings of round 3 were about: small files in bundles, comparisons that stay compilable."""

from pyspark.sql import functions as F

from reeltally.operators import catalog
from reeltally.queries import catalog as queries
from reeltally.queries.cues import cue_rows
from reeltally.queries.registry import QUERIES
from reeltally.sources import documents as docs


def test_detect_changed_sources_writes_bundles(spark, sf, monkeypatch):
    listings = []
    put = queries._put_files
    monkeypatch.setattr(queries, "_put_files", lambda rows: listings.append(put(rows)) or listings[-1])
    rows = QUERIES["detect_changed_sources"](spark, sf)
    assert rows.count() == 150
    for listing in listings:
        assert listing.select("bundle").distinct().count() <= spark.sparkContext.defaultParallelism


def test_fingerprints_in_bundles(spark, tmp_path):
    bodies = [b"a" * 100, b"", b"b" * 300_000, b"c" * 65_536]
    (tmp_path / "bundle").write_bytes(b"".join(bodies))
    rows, at = [], 0
    for i, body in enumerate(bodies):
        (tmp_path / f"f{i}").write_bytes(body)
        rows.append((f"f{i}", len(body), str(tmp_path / "bundle"), at))
        at += len(body)
    stamp = F.timestamp_seconds(F.lit(1))
    bundled = spark.createDataFrame(rows, "path string, size_bytes long, bundle string, offset long").withColumn("modified_at", stamp)
    plain = bundled.select(F.col("path").alias("name"), F.concat(F.lit(f"{tmp_path}/"), "path").alias("path"), "size_bytes", "modified_at")
    inside = {r.path: r.fingerprint for r in docs.fingerprints(bundled).collect()}
    assert len(set(inside.values())) == len(bodies)
    # The path is part of a fingerprint, so one more listing names the plain files' bytes by the bundle's paths.
    alone = plain.select(F.col("name").alias("path"), "size_bytes", "modified_at", F.col("path").alias("bundle"), F.lit(0).cast("long").alias("offset"))
    assert {r.path: r.fingerprint for r in docs.fingerprints(alone).collect()} == inside


def test_layout_comparison_carries_each_rule_once(spark, sf):
    plan = QUERIES["compare_stream_layout"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Each use of a field repeated its trimming before, 80 in all.
    assert plan.count("trim(") <= 10


def test_layout_differences_after_folding(spark):
    fields = ", ".join(f"cast(null as string) {f}" for f in catalog.SIGNATURE_FIELDS if f not in ("codec", "color_space", "field_order", "sample_aspect_ratio"))
    side = lambda id, space, order, ratio, tags, disp: spark.sql(
        f"select {id}L pair_id, 0L position, 'c' codec, {space} color_space, {order} field_order, {ratio} sample_aspect_ratio, {fields}, {tags} tags, {disp} disposition")
    none = "cast(map() as map<string,string>)"
    left = side(1, "' '", "'progressive'", "'0/0'", "map('a', '1', 'A', '2')", "map('default', 0)").unionByName(side(2, "'x'", "null", "'1/1'", "map('k', 'v')", "map('forced', 1)"))
    left = left.unionByName(side(3, "'x'", "null", "null", none, "map('default', 0)"))
    right = side(1, "'unknown'", "null", "null", "map('a', '2', 'B', '3')", "map('default', 0)").unionByName(side(2, "'y'", "'tt'", "'1/1'", "map('K', 'w')", "map('default', 1)"))
    rows = {(r.pair_id, r.part, r.field, r.expected, r.actual) for r in catalog.compare_stream_layout(left, right).collect()}
    assert rows == {
        (2, "signature", "color_space", "x", "y"), (2, "signature", "field_order", None, "tt"), (2, "tag", "K", "v", "w"),
        (2, "disposition", "forced", "1", None), (2, "disposition", "default", None, "1"),
        (3, "stream", "stream", "present", None), (3, "signature", "codec", "c", None), (3, "signature", "color_space", "x", None), (3, "disposition", "default", "0", None),
    }


def test_cue_documents_in_bundles(spark, sf, tmp_path):
    from reeltally.sources.lines import read_bundles, read_lines
    from reeltally.sources.sinks import write_cues

    cues = cue_rows(spark, sf)
    write_cues(cues, str(tmp_path / "files"))
    write_cues(cues, str(tmp_path / "bundles"), bundled=True)
    plain = {(r.path.rsplit("/", 2)[1], r.n, r.value) for r in read_lines(spark, str(tmp_path / "files"), skip_blank=False).collect()}
    assert {(r.path.rsplit("/", 1)[1], r.n, r.value) for r in read_bundles(spark, str(tmp_path / "bundles"), lines=True).collect()} == plain
    assert len(list((tmp_path / "bundles").glob("part-*"))) <= spark.sparkContext.defaultParallelism
