import pytest

from panelwright.operators import joins, reshape
from panelwright.plans.pipelines import combine_targets


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def sides(spark):
    a = spark.createDataFrame([("A", 2000, 1.0, 9), ("B", 2000, 2.0, 9), (None, 1, 3.0, 9)], "country string, year int, x double, z int")
    b = spark.createDataFrame([("A", 2000, 5.0, 8), ("C", 2000, 6.0, 8), (None, 1, 7.0, 8)], "country string, year int, y double, z int")
    return a, b


def test_merge_kinds(sides):
    a, b = sides
    assert rows(joins.merge_panels(a, b), "country") == [("A", 2000, 1.0, 9, 5.0, 8)]
    assert joins.merge_panels(a, b).columns == ["country", "year", "x", "z_x", "y", "z_y"]
    assert [joins.merge_panels(a, b, how=h).count() for h in joins.HOW] == [1, 3, 3, 5]
    assert joins.merge_panels(a, b, null_keys=True).count() == 2
    with pytest.raises(ValueError):
        joins.merge_panels(a, b, how="cross")


def test_cardinality(sides):
    a, b = sides
    twice = b.unionByName(b)
    with pytest.raises(Exception, match="keys of the right side are not unique"):
        joins.merge_panels(a, twice).collect()
    assert joins.merge_panels(a, twice, validate="one_to_many").count() == 2
    with pytest.raises(Exception, match="keys of the left side are not unique"):
        joins.merge_panels(twice, a, validate="one_to_many").collect()
    plan = joins.merge_panels(a.hint("merge"), b.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the check needs no shuffle of its own
    assert joins.merge_panels(twice, twice, validate="many_to_many").count() == 8
    with pytest.raises(ValueError):
        joins.merge_panels(a, b, validate="some")


def test_coverage(sides):
    a, b = sides
    assert tuple(joins.key_coverage(a, b).first()) == (2, 2, 1, 1, 1)
    assert {(r.country, r.side) for r in joins.keys_lost(a, b).filter("country IS NOT NULL").collect()} == {("B", "left"), ("C", "right")}
    assert [r.country for r in joins.restrict_to(a, b, ["country"]).collect()] == ["A"]


def test_nearest_metadata(spark):
    df = spark.createDataFrame([("A", y) for y in range(2000, 2005)] + [("B", 2000)], "country string, year int")
    meta = spark.createDataFrame([("A", 2001, "p"), ("A", 2003, "q")], "country string, year int, region string")
    got = joins.attach_nearest(df, meta, "country", "year", ["region"])
    assert [r.region for r in got.orderBy("country", "year").collect()] == ["p", "p", "p", "q", "q", None]


def test_nearest_metadata_takes_the_last_row_of_a_key(spark):
    df = spark.createDataFrame([("A", 2000), ("A", 2001), ("B", 2000)], "country string, year int")
    meta = spark.createDataFrame([("A", 2000, "old", 1), ("A", 2000, "new", 2), (None, 2000, "x", 3), ("A", None, "x", 3)], "country string, year int, region string, no int")
    got = joins.attach_nearest(df, meta, "country", "year", ["region"], order=["no"])
    assert [tuple(r) for r in got.orderBy("country", "year").collect()] == [("A", 2000, "new"), ("A", 2001, "new"), ("B", 2000, None)]
    assert joins.attach_nearest(df, meta, "country", "year", ["region"], restrict=True).count() == 2
    assert joins.attach(df, meta, ["country", "year"], ["region"], []).count() == 3


def test_targets(spark):
    df = spark.createDataFrame([(1, 70.0, 72.0), (2, None, 80.0), (3, None, None)], "i int, a double, b double")
    assert [r.t for r in combine_targets(df, ["a", "b"], "t").orderBy("i").collect()] == [71.0, 80.0, None]
    assert [r.t for r in combine_targets(df, ["a", "b"], "t", "first_non_null").orderBy("i").collect()] == [70.0, 80.0, None]
    with pytest.raises(ValueError):
        combine_targets(df, ["a"], "t", "max")


def test_results_side_by_side(spark):
    r = spark.createDataFrame([("m", "random", 1.0), ("m", "time", 3.0)], "model string, split string, rmse double")
    assert joins.metric_gap(r, ["model"], "split", "random", "time", ["rmse"]).first().rmse_gap == 2.0
    assert rows(reshape.metric_matrix(r, "model", "split", "rmse", ["random", "time"]), "model") == [("m", 1.0, 3.0)]
    assert joins.concat(r, r.drop("rmse")).filter("rmse IS NULL").count() == 2


def test_wide_to_panel(spark):
    wide = spark.createDataFrame([("A", "x", "1", None, "0"), ("A", "y", "2", "4", "0"), ("B", "x", None, "..", "0"), ("A", "other", "9", "9", "9")], "country string, indicator_code string, `2000` string, `2001` string, note string")
    got = reshape.wide_to_panel(wide, ["x", "y"], prefix="w_")
    assert got.columns == ["country", "year", "w_x", "w_y"]
    assert rows(got, "year") == [("A", 2000, 1.0, 2.0), ("A", 2001, None, 4.0)]
    assert reshape.wide_to_panel(wide, ["x"], start=2001).count() == 0
    with pytest.raises(ValueError):
        reshape.wide_to_long(wide.select("country", "note"), ["country"])
    long = spark.createDataFrame([("A", 1, "x", 2.0), ("A", 1, "x", 1.0), ("A", 1, "x", None)], "c string, y int, k string, v double")
    assert rows(reshape.long_to_wide(long, ["c", "y"], "k", "v", ["x"]), "c") == [("A", 1, 1.0)]


def test_years_outside_the_range_are_not_unpivoted(spark):
    wide = spark.createDataFrame([("A", "x", 1.0, 2.0)], "country string, indicator_code string, `1999` double, `2000` double")
    plan = reshape.wide_to_long(wide, ["country"], start=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "1999" not in plan.split("Expand")[0]
