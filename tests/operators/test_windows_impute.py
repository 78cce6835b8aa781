import numpy as np
import pandas as pd
import pytest

from panelwright.operators import impute, windows


def panel(spark, values, entity="A"):
    return spark.createDataFrame([(entity, i, v) for i, v in enumerate(values)], "e string, t int, v double")


def values(df):
    return [r.v for r in df.orderBy("e", "t").collect()]


N = None


@pytest.mark.parametrize(("before", "after"), [([1, N, N, N, N, N, 7], [1, 2, 3, N, 5, 6, 7]), ([N, N, N, 4, 5, N, N, N], [N, 4, 4, 4, 5, 5, 5, N]), ([N, N], [N, N])])
def test_interpolation_cases(spark, before, after):
    df = panel(spark, [None if v is None else float(v) for v in before])
    assert values(windows.interpolate(df, "e", "t", ["v"], 2)) == after


def random_panel(seed):
    r = np.random.default_rng(seed)
    df = pd.DataFrame([(e, t) for e in "ABCDEF" for t in range(2000, 2015) if r.random() > 0.1], columns=["e", "t"])
    df["v"], df["w"] = r.normal(size=len(df)), r.normal(size=len(df))
    df.loc[r.random(len(df)) < 0.5, "v"] = np.nan
    return df


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_pandas(spark, seed):
    df = random_panel(seed)
    sdf = spark.createDataFrame(df.astype(object).where(df.notna(), None), "e string, t int, v double, w double")
    g = df.groupby("e").v
    filled = g.transform(lambda s: s.interpolate("linear", limit=2, limit_direction="both"))
    assert np.allclose(np.array(values(windows.interpolate(sdf, "e", "t", ["v"], 2)), float), filled, equal_nan=True)
    both = g.transform(lambda s: s.ffill().bfill())
    assert np.allclose(np.array(values(windows.fill_both_ways(sdf, "e", "t", ["v"])), float), both, equal_nan=True)
    lags = windows.lag_features(sdf, "e", "t", ["v"], [1, 2], ["w"], [3]).orderBy("e", "t").toPandas()
    assert np.allclose(lags.v_lag2.astype(float), g.shift(2), equal_nan=True)
    assert np.allclose(lags.w_rollmean3.astype(float), df.groupby("e").w.transform(lambda s: s.shift(1).rolling(3).mean()), equal_nan=True)
    medians = df.v.fillna(df.groupby("e").v.transform("median"))
    assert np.allclose(np.array(values(impute.fill_group_median(sdf, ["e"], ["v"])), float), medians, equal_nan=True)
    assert np.allclose(np.array(values(impute.fill_global_median(sdf, ["v"])), float), df.v.fillna(df.v.median()))


def test_lag_cases(spark):
    df = spark.createDataFrame([("A", 2010 + i, 70.0 + i, 100.0 + 10 * i) for i in range(4)] + [("B", 2010 + i, 80.0 + i, 1.0) for i in range(2)] + [(None, 2010, 1.0, 1.0), (None, 2011, 2.0, 2.0)], "c string, y int, life double, gdp double")
    kept = windows.lag_features(df, "c", "y", ["life", "gdp"], [1], ["life"], [3], drop_incomplete=True).collect()
    assert [(r.c, r.y, r.life_lag1, r.gdp_lag1, r.life_rollmean3) for r in kept] == [("A", 2013, 72.0, 120.0, 71.0)]
    all_ = windows.lag_features(df, "c", "y", ["life"], [1])
    assert all_.filter("c = 'B' AND y = 2011").first().life_lag1 == 80.0
    assert all_.filter("c IS NULL AND life_lag1 IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        windows.lag_features(df, "c", "y", ["life"], [0])


def test_one_sort_for_all_columns(spark):
    df = random_panel(1)
    sdf = spark.createDataFrame(df.astype(object).where(df.notna(), None), "e string, t int, v double, w double")
    plan = windows.lag_features(sdf, "e", "t", ["v", "w"], [1, 2, 3], ["v", "w"], [3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sequences(spark):
    df = spark.createDataFrame([(c, 2010 + i, 100.0 + i, 5.0 + i, 70.0 + i) for c in "AB" for i in range(5)], "country string, year int, gdp double, schooling double, life double")
    got = windows.sequences(df, "country", "year", ["gdp", "schooling", "life"], "life", 3).orderBy("country", "year").collect()
    assert [(r.country, r.year) for r in got] == [("A", 2013), ("A", 2014), ("B", 2013), ("B", 2014)]
    assert got[0].sequence == [[100.0, 5.0, 70.0], [101.0, 6.0, 71.0], [102.0, 7.0, 72.0]]
    deltas = windows.sequence_delta(windows.sequences(df, "country", "year", ["gdp", "schooling", "life"], "life", 3), "life", 2)
    assert {(r.last_target, r.delta) for r in deltas.filter("country = 'A'").collect()} == {(72.0, 1.0), (73.0, 1.0)}
    holed = df.replace(101.0, None, ["gdp"])
    assert windows.sequences(holed, "country", "year", ["gdp"], "life", 3).count() == 0


def test_tables_in_order(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 3, 2, 5])], "i int, s double")
    assert [r.best_so_far for r in windows.running_best(df, "i", "s").orderBy("i").collect()] == [1.0, 3.0, 3.0, 5.0]
    assert [r.s_ma3 for r in windows.moving_average(df, "i", "s", 3).orderBy("i").collect()] == [None, None, 2.0, pytest.approx(10 / 3)]
    assert [r["rank"] for r in windows.rank_results(df, "s").orderBy("i").collect()] == [4, 2, 3, 1]


def test_three_stages(spark):
    df = spark.createDataFrame([("A", 1, "g", 100.0, None, None, 70.0), ("A", 2, "g", None, 4.0, None, None), ("A", 3, "g", 300.0, 6.0, 5.0, 71.0), ("B", 1, None, None, None, 7.0, None)], "country string, year int, region string, gdp double, edu double, jobs double, life double")
    out, counts = impute.impute_panel(df, "country", "year", "life", ["gdp"], 2, ["region"], ["edu"], ["jobs", "life"])
    got = {(r.country, r.year): r for r in out.collect()}
    assert got["A", 2].gdp == 200.0 and got["A", 1].edu == 5.0 and got["A", 1].jobs == 6.0
    assert got["B", 1].gdp is None and got["B", 1].edu is None and got["A", 2].life is None
    assert counts.first().asDict() == {"rows": 4, "interpolated_gdp": 1, "group_median_edu": 1, "median_jobs": 2}
    assert impute.filled_counts(df, out, ["country", "year"], ["gdp", "jobs"]).first().asDict() == {"gdp": 1, "jobs": 2}
    assert out.columns == df.columns
