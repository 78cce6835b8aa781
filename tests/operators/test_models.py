import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import explain, linear, mlprep, models, search, splits, stats
from panelwright.plans import pipelines


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    df = pd.DataFrame(r.normal(size=(240, 4)), columns=["f0", "f1", "f2", "f3"])
    df["y"] = 2.5 * df.f0 - 1.25 * df.f1 + r.normal(scale=0.3, size=240)
    df["k"], df["year"] = np.arange(240), 2000 + np.arange(240) % 8
    return df


@pytest.fixture(scope="module")
def labelled(spark, data):
    return splits.train_val_test(spark.createDataFrame(data), "year", 1, 1)[0].cache()


COLS = ["f0", "f1", "f2", "f3"]


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a", "train"), (None, "b", "train"), (3.0, "b", "train"), (3.0, None, "train"), (100.0, "z", "test")], "x double, c string, split string")
    prep = mlprep.prepare(df.filter("split = 'train'"), ["x"], ["c"], "standard", indicators=True)
    assert prep.medians["x"] == 3.0 and prep.modes["c"] == "b" and prep.names == ["x", "x_missing", "c=a", "c=b"]
    x = np.array([1.0, 3, 3, 3])
    got = np.array([tuple(r) for r in prep.apply(df).collect()])
    assert np.allclose(got[:4, 0], (x - x.mean()) / x.std()) and got[:, 1].tolist() == [0, 1, 0, 0, 0]
    assert got[:, 2:].tolist() == [[1, 0], [0, 1], [0, 1], [0, 1], [0, 0]]
    assert len(prep.assembled(df, ["split"]).first().features) == 4
    robust = mlprep.prepare(df.filter("split = 'train'"), ["x"], scale="robust")
    assert robust.widths["x"] == 0.5 and robust.centres["x"] == 3.0
    with pytest.raises(ValueError):
        mlprep.prepare(df, ["x"], scale="log")


def test_sequence_scaling(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 5.0]], "train"), ([[9.0, 9.0], [2.0, 5.0]], "test")], "sequence array<array<double>>, split string")
    got = {r.split: r.sequence for r in mlprep.scale_sequences(df, 2).collect()}
    assert got["train"] == [[-1.0, 0.0], [1.0, 0.0]] and got["test"] == [[7.0, 4.0], [0.0, 0.0]]


def test_linear_models(spark, data):
    df = spark.createDataFrame(data)
    x, y = data[COLS].to_numpy(), data.y.to_numpy()
    ols = linear.fit_ols(df, COLS, "y")
    want = np.linalg.lstsq(np.c_[np.ones(240), x], y, rcond=None)[0]
    assert np.allclose([ols.intercept, *ols.coef.values()], want)
    c = x - x.mean(0)
    ridge = linear.fit_ridge(df, COLS, "y", F.col("k") % 5, [10.0])
    assert np.allclose(list(ridge.coef.values()), np.linalg.solve(c.T @ c + 10 * np.eye(4), c.T @ (y - y.mean())))
    g = sum(linear.fold_gramians(df, COLS, "y").values())
    w, _ = linear.solve_elastic(g, 0.2, 1.0)
    grad = c.T @ (y - y.mean() - c @ w) / 240
    assert np.allclose(grad[w != 0], 0.2 * np.sign(w[w != 0])) and (np.abs(grad[w == 0]) <= 0.2 + 1e-9).all() and (w == 0).any()
    two = spark.createDataFrame([(float(i), 3.0 * i - 1.0) for i in (1, 4, 6, 7, 11)], "x double, y double")
    m = linear.fit_ols(two, ["x"], "y")
    assert [r.y_pred for r in m.predict(spark.createDataFrame([(0.0,), (-3.0,)], "x double")).collect()] == pytest.approx([-1.0, -10.0])


def test_ridge_choice_equals_refits(spark, data):
    df = spark.createDataFrame(data)
    parts = linear.fold_gramians(df, COLS, "y", F.col("k") % 4)
    scores = linear.ridge_scores(parts, [5.0])[5.0]
    for f in range(4):
        train, test = data[data.k % 4 != f], data[data.k % 4 == f]
        c = train[COLS] - train[COLS].mean()
        w = np.linalg.solve(c.T @ c + 5 * np.eye(4), c.T @ (train.y - train.y.mean()))
        e = test.y - (train.y.mean() + (test[COLS] - train[COLS].mean()) @ w)
        assert scores[f] == pytest.approx(1 - (e**2).sum() / ((test.y - test.y.mean()) ** 2).sum())


def test_compare_and_registry(labelled):
    got = {r.model: r for r in models.compare(labelled, ["mean", "ols", "ridge", "lasso"], {"all": COLS}, "y", ["k"]).collect()}
    assert got["ols"].rmse < 0.5 < got["mean"].rmse and got["lasso"].r2 > 0.95 and got["mean"].n == 30
    with pytest.raises(KeyError):
        models.pick_models(["nothing"])
    assert list(models.pick_models(["ols"])) == ["ols"]


def test_trees(labelled):
    base = models.compare(labelled, ["mean"], {"all": COLS}, "y", ["k"]).first().rmse
    for name, kw in (("forest", {"trees": 10, "depth": 5}), ("gbt", {"iterations": 15, "depth": 3})):
        a, b = (models.train(labelled, name, COLS, "y", ["k"], **kw) for _ in range(2))
        p, q = (f.predict(labelled.filter("split = 'test'"), "y", ["k"]).orderBy("k").collect() for f in (a, b))
        assert p == q and stats.regression_metrics(a.predict(labelled.filter("split = 'test'"), "y", ["k"])).first().rmse < base
        assert max(a.model.importances(), key=a.model.importances().get) == "f0"
    assert 1 <= a.model.info["best_iteration"] <= 15


def test_search_and_tuning(labelled):
    assert search.grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert search.draw("ridge", 3, 1) == search.draw("ridge", 3, 1)
    for name in search.RANGES:
        for c in search.draw(name, 20):
            assert all(v in own if isinstance(own, list) else own[1] <= v <= own[2] for v, own in zip(c.values(), search.RANGES[name].values(), strict=True))
    assert len(search.GBT_SWEEP) == 5 and len(search.GBT_TRIALS) == 9
    fold = splits.hash_fold(["k"], 3)
    table = search.search(labelled, "ridge", [{"alphas": a} for a in (0.1, 1000.0)], COLS, "y", ["k"], fold, 3).collect()
    assert [(r.candidate, r["rank"]) for r in table] == [(0, 1), (1, 2)]
    for name in ("lasso", "elastic_net"):
        table = search.search(labelled, name, [{"alpha": 50.0}, *search.draw(name, 2), {"alpha": 1e-4}], COLS, "y", ["k"], fold, 3).collect()
        assert table[0].candidate != 0 and table[-1].mean_score < table[0].mean_score
    few = models.train(labelled, "gbt", COLS, "y", ["k"], **{**search.GBT_TRIALS[0], "iterations": 2})
    assert few.model.info["best_iteration"] <= 2
    slow = search.search(labelled, "gbt", [{"iterations": 2, "depth": 2}], COLS, "y", ["k"], fold, 2).first()
    assert slow["rank"] == 1 and slow.mean_score < 0
    _, _, variants = search.tune(labelled, "ridge", [{"alphas": 0.5}], COLS, "y", ["k"], fold, 3)
    assert {r.variant for r in variants.collect()} == {"default", "tuned"}


def test_importances(labelled):
    fitted = models.train(labelled, "ridge", COLS, "y", ["k"])
    test = fitted.prep.apply(labelled, ["k", "y"])
    got = explain.permutation_importance(fitted.model, test, COLS, "y", ["k"], 3).collect()
    assert [r.feature for r in got][:2] == ["f0", "f1"] and got[0].importance_mean > 0.5 and got[0].importance_std >= 0
    drop = explain.permutation_importance(fitted.model, test, COLS, "y", ["k"], 3, score="r2").collect()
    assert [r.feature for r in drop][:2] == ["f0", "f1"] and 0.5 < drop[0].importance_mean < 3
    with pytest.raises(ValueError):
        explain.permutation_importance(fitted.model, test, COLS, "y", ["k"], score="auc")
    exact = {r.feature: r.mean_abs_shap for r in explain.linear_shap(fitted.model, test, COLS).collect()}
    sampled = {r.feature: r.mean_abs_shap for r in explain.sampled_shap(fitted.model, test, COLS, ["k"], 200, 16).collect()}
    assert sampled["f0"] == pytest.approx(exact["f0"], rel=0.25) and max(sampled, key=sampled.get) == "f0"
    pd_ = explain.partial_dependence(fitted.model, test, "f0", COLS, 5).collect()
    steps = np.diff([r.mean_pred for r in pd_]) / np.diff([r.value for r in pd_])
    assert np.allclose(steps, fitted.model.coef["f0"])
    assert {r.feature for r in explain.importance_table(labelled, {"ridge": fitted.model}).collect()} == set(COLS)


def test_experiment_and_explanation(spark, data):
    frame = spark.createDataFrame(data)
    labelled, table, results = pipelines.time_experiment(frame, "y", ["k", "year"], "year", ["mean", "ridge"], 1, 1)
    assert results.filter("model = 'ridge' AND split = 'test'").count() == 3
    assert table.filter("kind = 'set' AND name = 'A'").count() == 4
    out = pipelines.tune_and_explain(labelled, "ridge", [{"alphas": 1.0}, {"alphas": 10.0}], COLS, "y", ["k"])
    assert out["shap"].first().feature == "f0" and out["effects"].count() == 40
    stable = pipelines.seed_stability(labelled, "forest", COLS, "y", ["k"], [1, 2], trees=5, depth=3)
    assert stable.count() == 5


def test_best_prefix():
    assert models.best_prefix([5.0, 3.0, 4.0, 4.5, 2.0, 2.5], 50) == 5  # rises and falls again
    assert models.best_prefix([5.0, 3.0, 4.0, 4.5, 2.0, 2.5], 2) == 2
    assert models.best_prefix([3.0, 3.0, 3.0], 50) == 1 and models.best_prefix([1.0], 1) == 1


def test_boosting_keeps_the_best_prefix(labelled, spark):
    """Few noisy rows: errors on val rows rise in the end, and the ensemble is cut where they are least."""
    rows = labelled.withColumn("y", F.col("y") + 3 * F.randn(5))
    fitted = models.train(rows, "gbt", COLS, "y", ["k"], iterations=60, depth=4, patience=60, rate=0.3)
    errors, best = fitted.model.info["errors"], fitted.model.info["best_iteration"]
    assert len(errors) == 60 and best == int(np.argmin(errors)) + 1 < 60
    assert fitted.model.model.getNumTrees == best and len(fitted.model.importances()) == 4
    val = rows.filter("split = 'val'")
    if not val.isEmpty():
        assert stats.regression_metrics(fitted.predict(val, "y", ["k"])).first().rmse ** 2 == pytest.approx(errors[best - 1])
    short = models.train(rows, "gbt", COLS, "y", ["k"], iterations=60, depth=4, patience=5, rate=0.3)
    assert short.model.info["best_iteration"] == models.best_prefix(errors, 5)


@pytest.mark.parametrize("model", ["ridge", "elastic_net"])
def test_search_scores_equal_fits_in_each_fold(spark, data, model):
    """With gaps, a fold of another spread, and rows without an outcome, to nine digits."""
    r = np.random.default_rng(8)
    frame = data.copy()
    frame["f4"] = frame.f0 * np.where(frame.k % 3 == 0, 10.0, 1.0)
    frame.loc[r.random(len(frame)) < 0.2, "f1"] = np.nan
    frame.loc[(frame.k % 3 == 1) & (r.random(len(frame)) < 0.5), "f4"] = np.nan
    frame.loc[r.random(len(frame)) < 0.1, "y"] = np.nan
    frame = frame.astype(object).where(frame.notna(), None)
    rows = spark.createDataFrame(frame, ", ".join(f"`{c}` {'long' if c in ('k', 'year') else 'double'}" for c in frame.columns)).withColumn("split", F.lit("train"))
    cols, fold = [*COLS, "f4"], F.col("k") % 3
    candidates = [{"alphas": (50.0,)}, {"alphas": (0.1,)}] if model == "ridge" else [{"alpha": 0.1, "l1_ratio": 0.5}, {"alpha": 0.01, "l1_ratio": 0.9}]
    table = {r.candidate: r for r in search.search(rows, model, candidates, cols, "y", ["k"], fold, 3).collect()}
    for i, c in enumerate(candidates):
        slow = [search._fold_score(rows.withColumn("_fold", fold), model, c, cols, "y", ["k"], f) for f in range(3)]
        assert table[i].mean_score == pytest.approx(np.mean(slow), rel=1e-9) and table[i].std_score == pytest.approx(np.std(slow), rel=1e-7)


def test_shared_scans_equal_single_fits(labelled, spark):
    """Every linear model on every set, from one Gramian and one aggregate, as each trained and scored on its own."""
    gaps = labelled.withColumn("f1", F.when(F.col("k") % 5 != 0, F.col("f1")))
    sets = {"all": COLS, "two": COLS[1:3], "one": COLS[:1]}
    names, options = ["mean", "ols", "ridge", "lasso", "elastic_net"], {"lasso": {"alpha": 0.1}, "elastic_net": {"alpha": 0.2, "l1_ratio": 0.5}}
    got = {(r.model, r.feature_set, r.split): r for r in models.compare(gaps, names, sets, "y", ["k"], options, ("val", "test")).collect()}
    for name in names:
        for own, cols in sets.items():
            fitted = models.train(gaps, name, cols, "y", ["k"], **options.get(name, {}))
            for r in models.evaluate(fitted.predict(gaps.filter("split != 'train'"), "y", ["k"]), {}).collect():
                row = got[name, own, r.split]
                assert row.n == r.n and row.n_features == len(cols)
                assert (row.rmse, row.mae, row.r2) == pytest.approx((r.rmse, r.mae, r.r2), rel=1e-9, abs=1e-9)


def test_any_number_of_linear_models_takes_as_many_jobs(labelled, spark):
    def jobs(name, sets):
        spark.sparkContext.setJobGroup(name, name)
        models.compare(labelled, ["ols", "ridge"], sets, "y", ["k"]).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs("many sets", {str(i): COLS[: 1 + i % 4] for i in range(12)}) == jobs("one set", {"all": COLS})
