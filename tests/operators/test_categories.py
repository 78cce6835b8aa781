import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import categories, mlprep


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    df = pd.DataFrame({"no": np.arange(400), "x": r.normal(size=400), "z": r.normal(size=400) + 3})
    df["c"] = [f"k{v}" for v in np.where(r.random(400) < 0.35, 7, r.integers(0, 30, 400))]  # one holds a third
    df["e"] = [f"m{v}" for v in r.integers(0, 9, 400)]
    df["y"] = 2 * df.x - 0.5 * df.z + df.c.str[1:].astype(int) * 0.3 + r.normal(scale=0.2, size=400)
    df.loc[[3, 50], "c"] = None
    return df


def dense_ridge(x, y, alpha):
    m = x.mean(0)
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
    return w, y.mean() - m @ w


def test_dictionary_numbers_as_dense_columns_stand(spark, rows):
    df = spark.createDataFrame(rows)
    d = categories.category_dictionary(df, ["e", "c"])
    got = [(r.col, r.value) for r in d.table.orderBy("at").collect()]
    assert got == [(0, v) for v in sorted(rows.e.unique())] + [(1, v) for v in sorted(rows.c.dropna().unique())]
    assert d.size == len(got) and [r.at for r in d.table.orderBy("at").collect()] == list(range(d.size)) and d.modes["c"] == "k7"
    test = spark.createDataFrame([(1, "m2", "k7"), (2, None, "new"), (3, "m0", None)], "no int, e string, c string")
    codes = {r.no: r.codes for r in d.look_up(test).collect()}
    at = {v: i for i, (_, v) in enumerate(got)}
    assert codes == {1: [at["m2"], at["k7"]], 2: [at[d.modes["e"]]], 3: [at["m0"], at["k7"]]}


def test_vectors_equal_dense_ones(spark, rows):
    df = spark.createDataFrame(rows)
    whole = mlprep.prepare(df, ["x", "z"], ["e", "c"])
    sparse = categories.sparse_features(df, mlprep.prepare(df, ["x", "z"]), categories.category_dictionary(df, ["e", "c"]), ["no"])
    want = {r.no: r.features.toArray() for r in whole.assembled(df, ["no"]).collect()}
    found = sparse.collect()
    assert len(found) == 400 and all(np.allclose(want[r.no], r.features.toArray(), atol=1e-12) for r in found)
    assert {len(r.features.indices) for r in found} == {4}


@pytest.mark.parametrize("alpha", [0.5, 20.0])
def test_absorbed_and_sparse_models_equal_dense_ridge(spark, rows, alpha):
    df = spark.createDataFrame(rows)
    own = rows.assign(c=rows.c.fillna("k7"))
    x = np.c_[rows[["x", "z"]], pd.get_dummies(own.c).to_numpy(float)]
    w, b = dense_ridge(x, rows.y.to_numpy(), alpha)
    m = categories.fit_absorbed(df, ["x", "z"], "c", "y", [alpha])[alpha]
    assert np.allclose([m.intercept, *m.coef.values()], [b, *w[:2]], atol=1e-9)
    effects = {r.value: r.effect for r in m.effects.collect()}
    assert np.allclose([effects[v] for v in sorted(effects)], w[2:], atol=1e-9)
    assert np.allclose([r.y_pred for r in m.predict(df).orderBy("no").collect()], x @ w + b, atol=1e-9)
    plain = mlprep.prepare(df, ["x", "z"], scale="none")
    vectors = categories.sparse_features(df, plain, categories.category_dictionary(df, ["c"]), ["y"])
    fitted = categories.fit_sparse(vectors, "y", alpha)
    assert np.allclose(fitted.coefficients.toArray(), w, atol=1e-4) and abs(fitted.intercept - b) < 1e-4


def test_two_wide_columns(spark, rows):
    df = spark.createDataFrame(rows)
    x = np.c_[rows[["x"]], pd.get_dummies(rows.e).to_numpy(float), pd.get_dummies(rows.c.fillna("k7")).to_numpy(float)]
    w, b = dense_ridge(x, rows.y.to_numpy(), 2.0)
    vectors = categories.sparse_features(df, mlprep.prepare(df, ["x"], scale="none"), categories.category_dictionary(df, ["e", "c"]), ["y"])
    got = categories.fit_sparse(vectors, "y", 2.0).transform(vectors)
    want = np.sort(x @ w + b)
    assert np.allclose(np.sort([r.prediction for r in got.collect()]), want, atol=1e-4)


def test_fixed_effects_and_centred_effects(spark, rows):
    df = spark.createDataFrame(rows)
    own = rows.assign(c=rows.c.fillna("k7"))
    inner = own[["x", "z", "y"]] - own.groupby("c")[["x", "z", "y"]].transform("mean")
    want = np.linalg.lstsq(inner[["x", "z"]], inner.y, rcond=None)[0]
    m = categories.fit_absorbed(df, ["x", "z"], "c", "y", [0.0])[0.0]
    assert m.intercept == 0 and np.allclose(list(m.coef.values()), want)
    centred = categories.center_effects(m)
    assert np.allclose([r.y_pred for r in m.predict(df).orderBy("no").collect()], [r.y_pred for r in centred.predict(df).orderBy("no").collect()])
    new = df.limit(1).withColumn("c", F.lit("new"))
    line = new.select(sum((F.col(c) * w for c, w in m.coef.items()), F.lit(0.0))).first()[0]
    mean = np.mean(own.y - own[["x", "z"]] @ want)
    assert np.isclose(centred.predict(new).first().y_pred, line + mean)


def test_a_hundred_thousand_categories(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).cast("string").alias("c"), F.xxhash64("id").cast("double").alias("x")).withColumn("x", F.col("x") / 2.0**63)
    df = df.withColumn("y", 3 * F.col("x") + F.col("c").cast("double") / 1000)
    m = categories.fit_absorbed(df, ["x"], "c", "y", [0.0])[0.0]
    assert abs(m.coef["x"] - 3) < 1e-9 and m.effects.count() == 100_000
    assert m.effects.filter(F.abs(F.col("effect") - F.col("value").cast("double") / 1000) > 1e-9).isEmpty()
    d = categories.category_dictionary(df, ["c"])
    v = categories.sparse_features(df, mlprep.prepare(df, ["x"]), d, ["c"])
    r = v.filter("c = '99999'").first()
    assert d.size == 100_000 and r.features.size == 100_001 and r.features.indices.tolist() == [0, 100_000]
    assert len(v._jdf.queryExecution().toString()) < 20_000


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "c string, x double, y double")
    m = categories.fit_absorbed(none, ["x"], "c", "y", [1.0])[1.0]
    assert m.effects.count() == 0 and m.predict(none).count() == 0
    assert categories.category_dictionary(none, ["c"]).size == 0
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 3.0), ("a", None, 1.0), ("b", 2.0, None)], "c string, x double, y double")
    m = categories.fit_absorbed(df, [], "c", "y", [0.0])[0.0]
    assert [(r.value, r.n, r.effect) for r in m.effects.collect()] == [("a", 3, 2.0)]
    with pytest.raises(ValueError):
        categories.fit_absorbed(df, ["x"], "c", "y", [-1.0])
    assert categories.category_dictionary(df, ["c"], least=2).size == 1


def test_dense_columns_are_bounded(spark):
    df = spark.range(mlprep.DENSE + 1).select(F.col("id").cast("string").alias("c")).unionByName(spark.createDataFrame([("7",), ("5",), ("5",)], "c string"))
    with pytest.raises(ValueError, match="more than"):
        mlprep.prepare(df, [], ["c"])
    prep = mlprep.prepare(df, [], ["c"], max_categories=2)
    assert prep.categories == {"c": ["5", "7"]} and prep.modes == {"c": "5"}
