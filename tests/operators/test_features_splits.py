import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import features, numbers, splits


def test_log_and_flags(spark):
    df = spark.createDataFrame([("Developed", 0.0, None), ("Developing", 9.0, 2.0), ("developed economy", -5.0, 3.0), (None, None, 1.0)], "status string, gdp double, pop double")
    out = features.add_interactions(features.add_missing_flags(features.add_status_flag(features.add_log1p(df, ["gdp", "zz"])), ["gdp"]), [("gdp", "pop")]).collect()
    assert [r.gdp_log1p for r in out] == [0.0, pytest.approx(math.log1p(9)), 0.0, None]
    assert [r.status_flag for r in out] == [1, 0, 1, 0] and [r.gdp_missing for r in out] == [0, 0, 0, 1]
    assert [r.gdp__x__pop for r in out] == [None, 18.0, -15.0, None]
    kept = features.add_status_flag(df.withColumn("status_flag", F.lit(7)))
    assert {r.status_flag for r in kept.collect()} == {7}
    assert "gdp__x__pop" in features.add_interactions(df, cols=["gdp", "pop"]).columns


def test_model_frame(spark):
    df = spark.createDataFrame([("A", "AAA", "2000", "Developed", 70.0, 71.0, 70.5, 1.0), ("B", "BBB", "2001", "x", 60.0, 61.0, None, 2.0)], "country string, country_code string, year string, status string, life_a double, life_b double, life double, gdp double")
    out = features.model_frame(df, "life", ["country", "country_code"], ["life_a", "life_b"], ["gdp"], missing=["gdp"])
    assert out.columns == ["life", "gdp", "gdp_log1p", "status_flag", "gdp_missing"] and out.count() == 1


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([(c, y, 1.0) for c in "AB" for y in range(2010, 2015)], "country string, year int, x double")


def labels(df):
    return {r.year: r.split for r in df.select("year", "split").distinct().collect()}


def test_time_split(panel):
    out, info = splits.time_split(panel, "year", 1)
    assert info["cutoff"] == 2014 and labels(out)[2013] == "train" and labels(out)[2014] == "test"
    for bad in (0, 10):
        with pytest.raises(ValueError):
            splits.time_split(panel, "year", bad)


def test_train_val_test(panel):
    out, info = splits.train_val_test(panel, "year", 1, 1)
    assert labels(out) == {2010: "train", 2011: "train", 2012: "train", 2013: "val", 2014: "test"}
    assert tuple(info.first()) == (6, 2, 2)
    with pytest.raises(ValueError):
        splits.train_val_test(panel, "year", 3, 2)


def test_overlap_split(spark, panel):
    other = spark.createDataFrame([(2011,), (2013,), (2020,)], "year int")
    assert labels(splits.overlap_split(panel, other, "year")[0]) == {2010: "train", 2011: "val", 2013: "test"}


def test_times_are_of_the_calendar(spark):
    """Test is the last years up to the maximum, present or not; only val counts the years there are."""
    gaps = spark.createDataFrame([("A", y, 1.0) for y in (2000, 2001, 2002, 2005, 2010)], "country string, year int, x double")
    assert labels(splits.train_val_test(gaps, "year", 2, 2)[0]) == {2000: "train", 2001: "train", 2002: "val", 2005: "val", 2010: "test"}
    days = gaps.selectExpr("date_add(date'2020-01-01', year - 2000) AS year")
    assert sorted(r.split for r in splits.label_last_times(days, "year", 1, 6).collect()) == ["test", "test", "train", "train", "val"]
    facts = splits.split_facts(splits.time_split(gaps, "year", 6)[0], "year").first()
    assert (facts.n_train, facts.n_test, facts.train_max, facts.test_times) == (3, 2, 2002, [2005, 2010])


def test_rows_without_a_target_go_first(spark):
    df = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (2002, 3.0), (2003, None)], "year int, y double")
    assert splits.time_split(df, "year", 1, "y")[1]["cutoff"] == 2002 and splits.time_split(df, "year", 1)[1]["cutoff"] == 2003
    assert labels(splits.train_val_test(df, "year", 1, 1, "y")[0]) == {2000: "train", 2001: "val", 2002: "test"}


def test_overlap_split_raises_and_tells(spark, panel):
    facts = splits.overlap_split(panel, panel, "year", 2, 1)[1].first()
    assert (facts.n_train, facts.n_val, facts.n_test, facts.train_min, facts.train_max, facts.val_times, facts.test_times) == (4, 4, 2, 2010, 2011, [2012, 2013], [2014])
    for other in ([(2011,)], [(1999,), (2040,)], [(2010,), (2011,)]):  # too few common years; none; no year before them
        with pytest.raises(ValueError):
            splits.overlap_split(panel, spark.createDataFrame(other, "year int"), "year")


def test_random_split_is_exact_and_repeats(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a, b = (splits.random_split(df.repartition(n), ["k"], 0.2).filter("split = 'test'").orderBy("k").collect() for n in (3, 5))
    assert a == b and len(a) == math.ceil(0.2 * 1003)
    assert splits.random_split(df, ["k"], 0.2, seed=1).filter("split = 'test'").orderBy("k").collect() != a
    plan = splits.random_split(df, ["k"], 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan  # ranks come from small tables only
    with pytest.raises(ValueError):
        splits.random_split(df, ["k"], 1.0)


def test_folds(spark, panel):
    df = spark.range(11).withColumnRenamed("id", "k")
    assert [r.fold for r in splits.contiguous_folds(df, "k", 3).orderBy("k").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    sizes = df.withColumn("fold", splits.hash_fold(["k"], 3)).groupBy("fold").count().collect()
    assert sum(r["count"] for r in sizes) == 11
    own = splits.time_folds(panel, "year", 2)
    got = {(r.fold, r.year): r.split for r in own.collect()}
    assert got[0, 2013] == "val" and got[1, 2014] == "val" and got[1, 2013] == "train" and (0, 2014) not in got
    assert splits.split_summary(splits.time_split(panel, "year", 1)[0], "year").count() == 2


@pytest.mark.parametrize("k", [2, 3, 7])
def test_equal_folds(spark, k):
    """Sizes differ by one at most, whatever is repeated; a run again gives the same folds for keys that are there once."""
    for keys in (list(range(100)), [1] * 50 + list(range(2, 30)), [None] * 31 + [5] * 2, [7], []):
        df = spark.createDataFrame([(x,) for x in keys], "x long").repartition(3)
        got = splits.equal_folds(df, ["x"], k)
        sizes = {r.fold: r["count"] for r in got.groupBy("fold").count().collect()}
        assert sum(sizes.values()) == len(keys) and set(sizes) <= set(range(k))
        assert max([0, *sizes.values()]) - min([*(sizes.get(i, 0) for i in range(k))]) <= 1
        if len(set(keys)) == len(keys):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, splits.equal_folds(df.repartition(5), ["x"], k).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 16, 17, 1000, 12345])
def test_permutations_of_all_rows(spark, n):
    rows, counted = numbers.numbered_rows(spark.range(n).withColumn("id", F.col("id") * 7).repartition(5), ["id"])
    assert counted == n
    got = rows.select("id", "_no", *(numbers.shuffled(F.col("_no"), n, F.lit(s)).alias(f"p{s}") for s in (1, 2))).collect()
    assert all(r.id == 7 * r._no for r in got)
    for s in ("p1", "p2"):
        assert sorted(r[s] for r in got) == list(range(n))
    if n > 100:
        assert sum(r.p1 == r._no for r in got) < 10 and sum(r.p1 == r.p2 for r in got) < 10
        assert abs(np.corrcoef([r._no for r in got], [r.p1 for r in got])[0, 1]) < 0.1


def test_overlap_split_computes_its_rows_once(spark, panel):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    seen = panel.mapInArrow(counted, panel.schema)
    other = spark.createDataFrame([(int(r.year),) for r in panel.select("year").distinct().collect()], "year int")
    out, facts = splits.overlap_split(seen, other, "year")
    assert out.count() and facts.first()["n_test"] and runs.value == panel.count()
