import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import quantiles, selection, stats


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(3)
    df = pd.DataFrame({"g": r.choice(["p", "q"], 120), "t": r.integers(2000, 2005, 120), "a": r.normal(size=120), "b": r.exponential(size=120)})
    df["c"] = 2 * df.a + r.normal(scale=0.1, size=120)
    df.loc[r.random(120) < 0.2, "b"] = np.nan
    return df


@pytest.fixture(scope="module")
def sdf(spark, frame):
    return spark.createDataFrame(frame.replace({np.nan: None}), "g string, t int, a double, b double, c double")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_missingness(spark, sdf, frame):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1.0)], "a int, b double")
    got = stats.missingness(df).collect()
    assert [(r.feature, r.missing_fraction, r.missing_count, r.non_missing_count) for r in got] == [("b", 0.6667, 2, 1), ("a", 0.0, 0, 3)]
    want = frame.b.isna().groupby(frame.t).mean().round(4)
    assert {r.t: r.missing_fraction for r in stats.missingness_by(sdf, "t", "b").collect()} == pytest.approx(want.to_dict())
    assert len(stats.missingness_by(sdf, "g", "b", top=1).collect()) == 1


def test_moments_equal_pandas(spark, sdf, frame):
    got = by(stats.shape(sdf, ["a", "b"]), "feature")
    for c in ("a", "b"):
        assert got[c].skewness == pytest.approx(frame[c].skew()) and got[c].kurtosis == pytest.approx(frame[c].kurt())
    five = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    assert stats.shape(five, ["x"]).first()[1:] == pytest.approx((1.697056, 3.152), abs=1e-4)
    assert stats.shape(five.limit(2), ["x"]).first()[1:] == (None, None)


def test_describe_equals_pandas(sdf, frame):
    got, want = by(stats.describe(sdf, ["a", "b"]), "feature"), frame[["a", "b"]].describe()
    for c in ("a", "b"):
        assert list(got[c])[1:] == pytest.approx(want[c].tolist())
    grouped = by(stats.describe(sdf, ["b"], ["g"]), "g")
    assert grouped["p"].q50 == pytest.approx(frame[frame.g == "p"].b.median())


def test_correlations_equal_pandas(sdf, frame):
    want = frame[["a", "b", "c"]].corr()
    for r in stats.correlation_matrix(sdf, ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(want.loc[r.a, r.b])
    assert [(r.a, r.b) for r in stats.high_pairs(sdf, ["a", "b", "c"], 0.9).collect()] == [("a", "c")]
    assert stats.correlation_with(sdf, ["b", "c"], "a").first().feature == "c"
    both = frame[["a", "b"]].dropna()
    assert stats.spearman(sdf, "a", "b").first().rho == pytest.approx(both.corr(method="spearman").iloc[0, 1])


def test_spearman_with_ties(spark):
    x = pd.DataFrame({"a": [1, 2, 2, 3, 3, 3, 9, 9], "b": [5, 5, 6, 1, 1, 2, 2, 2]}).astype(float)
    assert stats.spearman(spark.createDataFrame(x), "a", "b").first().rho == pytest.approx(x.corr(method="spearman").iloc[0, 1])


def test_running_counts(spark):
    df = spark.createDataFrame([(float(i * i % 997), i % 5 + 1) for i in range(300)], "v double, n int").groupBy("v").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    got, seen = stats.running_counts(df, "v", "n", parts=8).orderBy("v").collect(), 0
    for r in got:
        assert r._before == seen
        seen += r.n


def test_exact_quantiles(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = pd.DataFrame({"a": r.normal(size=5000), "b": np.where(r.random(5000) < 0.6, 0.0, r.normal(size=5000)), "c": r.integers(0, 7, 5000).astype(float), "one": 3.0})
    df = spark.createDataFrame(x).withColumn("none", F.lit(None).cast("double"))
    for keep in (10_000, 20):  # with few, brackets are narrowed first
        monkeypatch.setattr(quantiles, "KEEP", keep)
        got = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, (0.0, 0.013, 0.5, 0.99, 1.0))
        for c in x:
            assert got[c] == pytest.approx(x[c].quantile([0.0, 0.013, 0.5, 0.99, 1.0]).tolist())
        assert got["none"] == [None] * 5
    assert quantiles.exact_quantiles(df.filter("a > 1e9"), {"a": F.col("a")}, (0.5,)) == {"a": [None]}


def test_no_percentile_of_a_whole_column_in_library_plans(spark):
    """Exact percentiles hold all different values of a group, so they stand behind a grouping only."""
    import pathlib
    import re

    for path in pathlib.Path(quantiles.__file__).parents[1].rglob("*.py"):
        if path.parent.name == "llm":
            continue
        for line in path.read_text().splitlines():
            if re.search(r"F\.(percentile|median)\(", line):
                assert "groupBy" in line or "if by" in line or line.strip().startswith("q = "), line  # each of these stands behind a groupBy


def test_vif(spark, frame):
    x = frame[["a", "b", "c"]].fillna(frame[["a", "b", "c"]].median())
    got = by(stats.vif_table(spark.createDataFrame(x), ["a", "b", "c"]), "feature")
    for c in x:
        rest = x.drop(columns=c).to_numpy()
        w = np.linalg.lstsq(rest, x[c], rcond=None)[0]
        assert got[c].vif == pytest.approx((x[c] ** 2).sum() / ((x[c] - rest @ w) ** 2).sum())
    x["d"] = x.a * 3
    dup = by(stats.vif_table(spark.createDataFrame(x), ["a", "b", "d"]), "feature")
    assert dup["a"].vif is None and dup["d"].vif is None and dup["b"].vif is not None


def test_two_columns_have_one_inflation(spark):
    for a, b in (([16, 56, 48, 64], [33, 113, 98, 130]), ([32, 48, 64, 48], [66, 98, 130, 97]), ([56, 64, 8, 8], [114, 129, 17, 16])):
        assert selection.prune_vif(spark.createDataFrame(list(zip(a, b, strict=True)), "a long, b long"), ["a", "b"]) == (["b"], ["a"])  # rounding does not choose


def test_prunes(spark):
    x = np.arange(1.0, 6)
    df = spark.createDataFrame(pd.DataFrame({"year": x + 2000, "a": x, "b": 2 * x, "c": 6 - x, "flag": [0.0, 1, 0, 1, 1], "y": x * x, "one": 1.0}))
    assert selection.prune_correlated(df, ["a", "b", "c", "flag"]) == (["a", "flag"], ["b", "c"])
    # the later column of the pair is protected, so the earlier one goes; of two protected ones none does
    assert selection.prune_correlated(df, ["a", "b", "flag"], protected=["b"]) == (["b", "flag"], ["a"])
    assert selection.prune_correlated(df, ["a", "b", "flag"], protected=["a"]) == (["a", "flag"], ["b"])
    assert selection.prune_correlated(df, ["a", "b", "flag"], protected=["a", "b"])[1] == []
    kept, gone = selection.prune_vif(df, ["a", "b", "flag"], 10.0)
    assert len(gone) == 1 and "flag" in kept
    assert selection.prune_vif(df, ["a", "b"], protected=["a", "b"])[1] == []
    # two protected columns stay inflated, so all that may go goes
    assert selection.prune_vif(df, ["a", "b", "flag"], protected=["a", "b"]) == (["a", "b"], ["flag"])
    sets, table = selection.feature_sets(df, "y", ["year"], ["b", "flag", "zz"], least=2, most=2)
    assert sets == {"A": ["a", "b", "c", "flag"], "B": ["a", "flag"], "C": ["flag", "a"]}
    assert selection.priority_set(["z", "x"], ["x", "y", "z", "w"], 3) == ["z", "x", "y"]
    assert selection.priority_set(["z", "x"], ["x", "y"], 1) == ["x"] and selection.priority_set([], ["x", "y"], 0) == []
    assert ("dropped", "constant", 0, "one") in [tuple(r) for r in table.collect()]


def test_rankings_and_groups(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 10.0), ("C", None), (None, 5.0)], "e string, v double")
    got = stats.ranking(df.dropna(subset=["e"]), "e", "v", 1).collect()
    assert [(r.e, r.end) for r in got] == [("A", "lowest"), ("B", "highest")]
    assert stats.top_groups(df, "e", 1).first().e == "A"
    assert stats.in_top_groups(df, "e", 1).count() == 2
    m = spark.createDataFrame([("s", "m1", 2.0), ("s", "m2", 1.0), ("t", "m1", 1.0), ("t", "m2", 1.0)], "s string, model string, rmse double")
    assert [(r.s, r.model) for r in stats.best_per_group(m, ["s"], "rmse", ["model"]).orderBy("s").collect()] == [("s", "m2"), ("t", "m1")]


def test_errors(spark):
    df = spark.createDataFrame([("A", 2010, 70.0, 68.0), ("B", 2010, 60.0, 63.0), ("C", 2011, 50.0, 55.0)], "country string, year int, y_true double, y_pred double")
    e = stats.with_errors(df)
    assert [r.error for r in e.orderBy("country").collect()] == [2.0, -3.0, -5.0]
    assert [r.country for r in stats.worst_errors(e, 2, ["country"]).collect()] == ["C", "B"]
    t = stats.error_by(e, "year", by_order=True).collect()
    assert (t[0].n, t[0].mae, t[0].rmse) == (2, 2.5, pytest.approx(6.5**0.5))
    m = stats.regression_metrics(e).first()
    assert (m.rmse, m.mae, m.r2) == pytest.approx(((38 / 3) ** 0.5, 10 / 3, 1 - 38 / 200))
    assert stats.mae_by_entity(e, "country", 1).first().country == "C"


def test_chart_numbers(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)], "g string, v double")
    bins = stats.histogram(df, "v", 4).collect()
    assert {r.bin: r.n for r in bins} == {0: 4, 3: 1}
    b = stats.box_stats(df, "g", "v").first()
    assert (b.q25, b.median, b.q75, b.low_whisker, b.high_whisker, b.n_outside) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [(r.bin, r.n) for r in stats.histogram(same, "v", 3).collect()] == [(0, 2)]
