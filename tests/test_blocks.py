"""Stitched block operators against plain per-key windows, with tiny blocks and hot keys."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reeltally.plans.blocks import attach, neighbours, numbered, running, time_block
from reeltally.plans.ranges import range_join

KEYS = ["file_id", "stream_index"]


def make(spark, seed=1, rows=400):
    """Three streams, the first of them holding most rows."""
    r = random.Random(seed)
    data = []
    for f, n in ((1, rows), (2, 37), (3, 1)):
        for i in range(n):
            t = r.choice([None, r.randint(-5000, 5000), r.randint(-50, 50)])
            data.append((f, 0, i, t, r.choice("ab")))
    r.shuffle(data)
    return spark.createDataFrame(data, "file_id long, stream_index long, ordinal long, t long, h string")


def rows(df, cols):
    return sorted(map(str, (tuple(x) for x in df.select(*cols).collect())))


@pytest.mark.parametrize("block_rows", [1, 2, 7, 65536])
@pytest.mark.parametrize("dense", [True, False])
def test_neighbours(spark, block_rows, dense):
    d = make(spark)
    w = W.partitionBy(*KEYS).orderBy("ordinal")
    want = d
    for c in ("t", "h"):
        want = want.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    got = neighbours(d, order="ordinal", prev=["t", "h"], next=["t", "h"], dense=dense, block_rows=block_rows)
    cols = [*KEYS, "ordinal", "t", "h", "prev_t", "prev_h", "next_t", "next_h"]
    assert rows(got, cols) == rows(want, cols)


def test_neighbours_gapped_order(spark):
    d = make(spark).where("ordinal % 5 <> 0 and ordinal % 7 <> 3")
    w = W.partitionBy(*KEYS).orderBy("ordinal")
    want = d.withColumn("prev_h", F.lag("h").over(w)).withColumn("next_h", F.lead("h").over(w))
    got = neighbours(d, order="ordinal", prev=["h"], next=["h"], dense=False, block_rows=4)
    assert rows(got, [*KEYS, "ordinal", "prev_h", "next_h"]) == rows(want, [*KEYS, "ordinal", "prev_h", "next_h"])


def test_missing_edge_row_is_loud(spark):
    d = make(spark).where("ordinal <> 7")
    with pytest.raises(PySparkException, match="not dense"):
        neighbours(d, order="ordinal", prev=["t"], block_rows=8).collect()


@pytest.mark.parametrize("block_rows", [1, 3, 65536])
def test_running(spark, block_rows):
    d = make(spark)
    w = W.partitionBy(*KEYS).orderBy("ordinal")
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    want = d.withColumn("s", F.coalesce(F.sum("t").over(before), F.lit(0))).withColumn("m", F.max("t").over(upto)).withColumn("p", F.max("t").over(before))
    got = running(d, order=["ordinal"], sums={"s": "t"}, maxes={"m": "t"}, prior_maxes={"p": "t"}, block_rows=block_rows)
    cols = [*KEYS, "ordinal", "s", "m", "p"]
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("width", [1, 100, 10**6])
def test_numbered_by_time(spark, width):
    d = make(spark).where("t is not null")
    w = W.partitionBy(*KEYS).orderBy("t", "ordinal")
    want = d.withColumn("k", F.row_number().over(w) - 1)
    got = numbered(d, order=["t", "ordinal"], name="k", block=time_block("t", width))
    assert rows(got, [*KEYS, "ordinal", "k"]) == rows(want, [*KEYS, "ordinal", "k"])


@pytest.mark.parametrize("how", [dict(chunk_rows=9), dict(dense=False, salts=5), {}])
def test_attach_spreads_a_hot_key(spark, how):
    d = make(spark)
    one = spark.createDataFrame([(1, 0, "x"), (2, 0, "y"), (9, 0, "z")], "file_id long, stream_index long, v string")
    got = attach(d, one, KEYS, **how)
    want = d.join(one, KEYS, "left")
    assert rows(got, [*KEYS, "ordinal", "v"]) == rows(want, [*KEYS, "ordinal", "v"])


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_range_join(spark, width):
    r = random.Random(5)
    span = lambda: sorted(r.sample(range(-300, 300), 2))
    left = spark.createDataFrame([(i % 2, i, *span()) for i in range(80)], "k long, a long, ls long, le long")
    right = spark.createDataFrame([(i % 2, i, *span()) for i in range(40)], "k long, b long, rs long, re long")
    got = range_join(left, right, keys=["k"], left_span=("ls", "le"), right_span=("rs", "re"), bin_width=width)
    l, q = left.alias("l"), right.alias("q")
    want = l.join(q, F.expr("l.k = q.k and le > rs and ls < re")).select("l.k", "a", "b")
    assert rows(got, ["k", "a", "b"]) == rows(want, ["k", "a", "b"])


def test_endless_intervals_are_few_rows(spark):
    """One file with most intervals and a damaged end time: the pairs are right, and no interval is spread over its bins."""
    from reeltally.plans import ranges

    r = random.Random(9)
    cues = [(1 if i % 5 else 2, i, t := r.randrange(10**7), t + r.randrange(4000)) for i in range(2000)]
    cues += [(1, 5000, 17, 10**15), (1, 5001, -(10**15), 10**15), (2, 5002, 4, 4), (2, 5003, 9, 3), (1, 5004, None, 5), (1, 5005, 5, None)]
    edits = [(1 + i % 2, i, t := r.randrange(10**7), t + 50_000) for i in range(40)] + [(1, 100, 0, 10**15), (2, 101, 3, 5)]
    left = spark.createDataFrame(cues, "k long, a long, ls long, le long")
    right = spark.createDataFrame(edits, "k long, b long, rs long, re long")
    rows_of = left.select("a", F.size(ranges._nodes("ls", "le", 1000)).alias("n")).where("le is not null and ls is not null").collect()
    assert max(x.n for x in rows_of) < 120 and sorted(x.n for x in rows_of)[len(cues) // 2] <= 3
    spread = ranges._spread(left, right, ["k"], ("ls", "le"), ("rs", "re"), 1000, 0)
    assert spread.groupBy("a").count().agg(F.max("count")).first()[0] < 160
    got = range_join(left, right, keys=["k"], left_span=("ls", "le"), right_span=("rs", "re"), bin_width=1000)
    want = [(k, a, b) for k, a, s, e in cues for q, b, t, u in edits if k == q and s is not None and e is not None and e > t and s < u]
    assert rows(got, ["k", "a", "b"]) == sorted(map(str, want))


def test_range_join_has_no_nested_loop(spark):
    left = spark.createDataFrame([(1, 0, 10)], "k long, ls long, le long")
    right = spark.createDataFrame([(1, 5, 15)], "k long, rs long, re long")
    got = range_join(left, right, keys=["k"], left_span=("ls", "le"), right_span=("rs", "re"), bin_width=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
