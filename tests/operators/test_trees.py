from itertools import combinations
from math import factorial

import numpy as np
import pytest

from panelwright.operators import models, trees

COLS = list("abcd")


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    x = np.round(r.random((300, 4)), 2)
    y = 3 * x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0.5, x[:, 0], -x[:, 3]) + r.normal(0, 0.1, 300)
    rows = [(i, *map(float, x[i]), float(y[i]), ["train", "val"][i % 5 == 0]) for i in range(300)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double, split string")


def slow(own, row):
    """Every subset of the features, tree by tree weights from the leaves."""
    k = len(row)

    def worth(known):
        total = 0.0
        for leaf in range(len(own.value)):
            p = own.value[leaf]
            for f, low, high, share in zip(own.feature[leaf], own.above[leaf], own.upto[leaf], own.share[leaf], strict=True):
                p *= float(low < row[f] <= high) if f in known else share
            total += p
        return total

    out = np.zeros(k)
    for j in range(k):
        rest = [f for f in range(k) if f != j]
        for n in range(k):
            for s in combinations(rest, n):
                out[j] += factorial(n) * factorial(k - n - 1) / factorial(k) * (worth({*s, j}) - worth({*s}))
    return out


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_exact_and_adds_up(data, kind, monkeypatch):
    model = models.fit_gbt(data, COLS, "y", iterations=6, depth=4, patience=3) if kind == "gbt" else models.fit_forest(data, COLS, "y", trees=4, depth=5)
    own = trees.leaves(model, data)
    monkeypatch.setattr(trees, "BLOCK", 1 << 9)  # many blocks of rows and leaves
    got = {r.k: r for r in trees.contributions(model, data, ["k"]).collect()}
    for r in model.predict(data).collect():
        assert got[r.k].base + sum(got[r.k].contributions) == pytest.approx(r.y_pred, abs=1e-9)
    for r in data.limit(5).collect():
        want = slow(own, [r.a, r.b, r.c, r.d])
        assert got[r.k].contributions == pytest.approx(want, abs=1e-9)
        assert trees.shapley(own, np.array([[r.a, r.b, r.c, r.d]]))[0] == pytest.approx(want, abs=1e-9)


def test_table_and_awkward_rows(spark, data):
    model = models.fit_gbt(data, COLS, "y", iterations=4, depth=3, patience=2)
    got = trees.tree_shap(model, data).collect()
    assert {r.feature for r in got} == set(COLS) and [r.mean_abs_shap for r in got] == sorted((r.mean_abs_shap for r in got), reverse=True)
    odd = spark.createDataFrame([(1, None, 0.5, 0.5, 0.5), (2, float("inf"), float("-inf"), 1e300, 0.0)], "k long, a double, b double, c double, d double")
    own = trees.contributions(model, odd, ["k"]).collect()
    assert [r.k for r in own] == [2] and np.isfinite(own[0].contributions).all()
    assert own[0].base + sum(own[0].contributions) == pytest.approx(model.predict(odd.filter("k = 2")).first().y_pred)
    assert trees.tree_shap(model, odd.filter("k = 0")).count() == 0


def test_a_tree_of_one_leaf(data):
    flat = data.selectExpr("k", *COLS, "1.5D AS y", "split")
    model = models.fit_forest(flat, COLS, "y", trees=2, depth=3)
    row = trees.contributions(model, flat, ["k"]).first()
    assert row.base == 1.5 and row.contributions == [0.0] * 4
