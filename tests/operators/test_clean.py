import pytest
from pyspark.sql import functions as F

from panelwright.operators import clean, dedup, schema


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_outcome_cleaning(spark):
    df = spark.createDataFrame([("A", 2010, 70.0, 101.0), ("A", 2011, None, 90.0), ("A", 2012, 130.0, -1.0)], "country string, year int, life double, polio double")
    out, summary = clean.clean_outcome_panel(df, "life", bounds=(0.0, 100.0), min_targets=1)
    assert rows(out, "year") == [("A", 2010, 70.0, 100.0)]
    s = summary.first()
    assert (s.input_rows, s.duplicate_rows, s.out_of_bounds, s.missing_target, s.output_rows) == (3, 0, 1, 1, 1)


def test_bounds_are_asymmetric_and_keep_null(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (100.0,), (100.1,), (None,)], "x double")
    assert [r.x for r in clean.apply_bounds(df, "x", 0.0, 100.0).collect()] == [None, 0.1, 100.0, None, None]
    assert [r.x for r in clean.apply_bounds(df, "x", 0.0, 100.0, clip=True).collect()] == [0.0, 0.1, 100.0, 100.0, None]


def test_numeric_texts(spark):
    df = spark.createDataFrame([("A", 2000, "r", "1.5", "x"), ("B", 2001, None, " 2 ", "3")], "country string, year int, region string, gdp string, mixed string")
    out, changed = schema.numeric_text(df, ["country"])
    assert changed == ["gdp", "mixed"]
    assert [(r.gdp, r.mixed) for r in out.orderBy("country").collect()] == [(1.5, None), (2.0, 3.0)]


def test_covariate_cleaning(spark):
    df = spark.createDataFrame([("A", 2000, "10", None), ("B", 2000, "-1", None), ("C", 2000, "1000", None)], "country string, year int, gdp string, empty double")
    out, summary = clean.clean_covariate_panel(df, ["gdp", "empty", "absent"], winsorized=["gdp"], quantiles=(0.0, 0.5), logged=["gdp"], eps=1.0, max_missing=0.75)
    assert out.columns == ["country", "year", "gdp", "log_gdp"]
    got = rows(out, "country")
    assert [r[2] for r in got] == [10.0, -1.0, 10.0] and got[1][3] is None
    assert summary.first().missing_columns == ["absent"] and summary.first().dropped_columns == ["empty"]


def test_column_drops(spark):
    df = spark.createDataFrame([(1, None, 5, None), (2, None, 5, None), (3, 1.0, 5, None)], "k int, sparse double, one int, none double")
    assert clean.drop_sparse_columns(df, 0.5, ["k"])[1] == ["sparse", "none"]
    assert clean.drop_constant_columns(df, ["k"])[1] == ["sparse", "one", "none"]
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            clean.drop_sparse_columns(df, bad)
    assert clean.drop_sparse_columns(df, None)[1] == []


def test_duplicate_policies(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 4.0), (2, "z", None), (3, "c", 1.0), (3, None, 3.0)], "k int, t string, v double")
    assert tuple(dedup.shared_key_rows(df, ["k"]).first()) == (4, 2)
    assert rows(dedup.deduplicate(df, ["k"], "keep_first", ["v"]), "k") == [(1, "b", 2.0), (2, "z", None), (3, "c", 1.0)]
    assert rows(dedup.deduplicate(df, ["k"], "keep_last", ["v"]), "k") == [(1, "a", 4.0), (2, "z", None), (3, None, 3.0)]
    assert rows(dedup.deduplicate(df, ["k"], "drop_all"), "k") == [(2, "z", None)]
    assert rows(dedup.deduplicate(df, ["k"], "mean_aggregate", ["v"]), "k") == [(1, "b", 3.0), (2, "z", None), (3, "c", 2.0)]
    with pytest.raises(ValueError):
        dedup.deduplicate(df, ["k"], "any")
    assert dedup.shared_rows(df, ["k"]).count() == 4


def test_coverage_filters(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, None), ("B", 1, 1.0), ("B", 2, 2.0), (None, 1, 1.0)], "e string, t int, v double")
    assert {r.e for r in clean.entities_with_targets(df, "e", "v", 2).collect()} == {"B"}
    assert {r.e for r in clean.entities_with_times(df, "e", "t", 2).collect()} == {"A", "B"}


def test_names_and_keys(spark):
    df = spark.createDataFrame([(" Albania ", "2015", "1"), ("B", "bad", "2")], "Country string, Year string, `Health Expenditure %` string")
    out = schema.standardize_panel(df, "Country", "Year", {"health_expenditure_percent": "health"})
    assert out.columns == ["country", "year", "health"]
    assert rows(out, "country") == [("Albania", 2015, "1"), ("B", None, "2")]
    assert schema.clean_name("A/B-C") == "a_b_c" and schema.clean_name(" Life & work % ") == "life_and_work_percent"
    with pytest.raises(ValueError):
        schema.rename_clean(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    with pytest.raises(KeyError):
        schema.require_columns(df, ["absent"])


def test_strict_year_raises_lazily(spark):
    df = spark.createDataFrame([("2001",), ("x",)], "year string")
    strict = schema.strict_year(df, "year")
    assert schema.strict_year(df.filter("year = '2001'"), "year").first().year == 2001
    with pytest.raises(Exception, match="no whole number"):
        strict.collect()


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "x", 2.0, True)], "a int, b string, `2001` double, d boolean")
    assert schema.numeric_columns(df, ["a"]) == ["2001"] and schema.categorical_columns(df) == ["b", "d"]
    assert schema.time_columns(df) == ["2001"] and schema.keyword_columns(df, ["B"]) == [] and schema.keyword_columns(df, ["b"]) == ["b"]
    assert schema.collect_columns(df, ["a"], ["b", "zz", "a"]) == ["a", "b"]
    assert schema.infer_target(df, ["zz", "b"]) == "b" and schema.split_target(df, "a", ["d"])[0] == ["b", "2001"]
    assert schema.pick(df, ["b", "zz"], ["a"])[1] == ["zz"]
    with pytest.raises(KeyError):
        schema.infer_target(df, ["zz"])


def test_empty_rows_and_ranges(spark):
    df = spark.createDataFrame([("A", 1, None, None), ("B", 2, 1.0, None)], "c string, y int, u double, v double")
    assert [r.c for r in clean.drop_empty_rows(df, ["c", "y"]).collect()] == ["B"]
    assert clean.time_range(df, "y", 2).count() == 1 and clean.time_range(df, "y", None, 1).count() == 1
    assert clean.outside(df, {"u": (2.0, None)}).count() == 1


def test_winsorize_equals_pandas(spark):
    import numpy as np

    values = np.random.default_rng(1).normal(size=200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(999, None)], "i int, v double")
    got = [r.v for r in clean.winsorize(df, ["v"], 0.05, 0.9).orderBy("i").collect()]
    assert np.allclose(got[:-1], np.clip(values, *np.quantile(values, [0.05, 0.9]))) and got[-1] is None
    assert "Join" not in clean.winsorize(df, ["v"])._jdf.queryExecution().toString()  # the ends are numbers in the plan
    assert clean.winsorize(df, ["v"], exact=False).filter(F.col("v").isNotNull()).count() == 200


def test_sources_are_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("A", y, float(y)) for y in range(2000, 2010)], "country string, year int, life double").mapInArrow(counted, "country string, year int, life double")
    assert clean.clean_covariate_panel(df, ["life"], winsorized=["life"])[0].count() == 10 == runs.value
    assert clean.clean_outcome_panel(df, "life", bounds=(0.0, 1e4))[0].count() == 10 and runs.value == 20
