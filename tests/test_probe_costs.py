"""F16: what read_probe_documents evaluates and shuffles; tag lookups by key length."""

from reeltally.functions import exprs as X
from reeltally.queries.registry import QUERIES
from reeltally.queries.sources import probe_docs


def test_probe_streams_search_each_tag_once(spark, sf):
    plan = QUERIES["read_probe_documents"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # DURATION, title, name and handler_name; the clock alone repeated its search ten times before.
    assert plan.count("map_filter(") == 4


def test_probe_documents_shuffle_numbers_only(spark, sf):
    plan = probe_docs(spark, sf)._jdf.queryExecution().optimizedPlan()
    collected = [line for line in plan.toString().splitlines() if "collect_list" in line]
    assert len(collected) == 1 and "handler_name" not in collected[0] and "side_data_type" not in collected[0]


def test_tags_by_key_in_any_case(spark):
    d = spark.sql("""select map('Kind', '1', 'kin', '2', 'Kind', '3') a, map('kiṅd', '1', 'KIND', '3', 'KINDS', '4') b, map('kind', ' ', 'KIND', '5') c,
      cast(null as map<string,string>) d""")
    assert tuple(d.select(*[X.tag(c, "kind") for c in "abcd"]).first()) == ("1", "3", "5", None)


def test_tag_clocks(spark):
    cases = {
        "1:02:03.5": 3723.5, "0:00:00": 0.0, "+1:+2:3": 3723.0, "1:02": None, "1:2:3:4": None, "": None, None: None, "a:1:2": None, "1:60:0": None,
        "1:0:60": None, "1:0:-1": None, "-1:0:0": None, "1::3": None, "1:2:x": None, "1:2:NaN": None, "99999999999999999999:0:0": None,
    }
    d = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in d.select("t", X.tag_clock("t").alias("s")).collect()} == cases
