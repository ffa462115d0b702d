"""the rows that compare_containers sorts are flat, and say the same."""

import __spark_entry__  # noqa: F401  (registers the queries)
from reeltally.operators import catalog
from reeltally.queries.registry import QUERIES


def test_chapter_rows_are_flat(spark, sf):
    plan = QUERIES["compare_containers"](spark, sf)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in _nodes(plan) if n.nodeName() == "Join"]
    assert joins
    for join in joins:
        kinds = {f.dataType().typeName() for f in join.schema().fields()}
        assert not kinds & {"struct", "array", "map"}, join.toString()
    # Both sides come from one grouping of the lines, made before.
    assert "l_quantity" not in plan.toString()


def _nodes(plan):
    yield plan
    kids = plan.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def test_tags_equal_as_sets_and_times_within_the_tolerance(spark):
    none = "cast(null as map<string,string>)"
    rows = lambda *values: spark.createDataFrame([], "pair_id long, tags map<string,string>").unionByName(
        spark.sql(" union all ".join(f"select {i}L pair_id, {t} tags" for i, t in values)))
    left = rows((1, "map('a', '1', 'b', '2')"), (2, "map('a', '1:b')"), (3, "map('a', null)"), (4, none), (5, "map('a', '-')"), (6, "map('a', '')"))
    right = rows((1, "map('B', '2', 'A', '1', 'encoder', 'x')"), (2, "map('a', '1', 'b', '')"), (3, "map('a', '-')"), (4, "map()"), (5, "map('a', '-')"), (6, "map('a', null)"))
    chapter = lambda *values: spark.sql(" union all ".join(f"select {p}L pair_id, {n}L position, cast({a} as bigint) start_us, cast({b} as bigint) end_us, {t} tags" for p, n, a, b, t in values))
    at = lambda p, n, t=none, a=0, b=9: (p, n, a, b, t)
    wide = catalog.START_TOLERANCE_US + 1
    expected = chapter(at(1, 0, "map('t', 'x')"), at(1, 1, "map('t', '')"), at(2, 0), at(3, 0, a="null"), at(3, 1, a="null"), at(4, 0), at(5, 0), at(5, 1))
    actual = chapter(at(1, 0, "map('T', 'x')"), at(1, 1, "map('t', null)"), at(2, 0, "map()"), at(3, 0, a="null"), at(3, 1), at(4, 0, b=9 + wide), at(5, 0))
    out = {r.pair_id: (r.tags_differ, r.unmatched_chapters, r.first_changed_chapter) for r in catalog.compare_containers(left, right, expected, actual).collect()}
    assert out == {
        1: (False, 0, 1), 2: (True, 0, None), 3: (True, 0, 1), 4: (False, 0, 0), 5: (False, 1, None), 6: (True, 0, None),
    }
