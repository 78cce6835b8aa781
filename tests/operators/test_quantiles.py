import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import quantiles

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def compare(spark, frame, by, cols):
    df = spark.createDataFrame(frame).repartition(5)
    got = {tuple(r[c] for c in by): [r[f"{c}_{j}"] for c in cols for j in range(len(SHARES))] for r in quantiles.grouped_quantiles(df, by, {c: F.col(c) for c in cols}, SHARES).collect()}
    want = {}
    for key, own in frame.groupby(by, dropna=False):
        key = tuple(None if k is None or k != k else k for k in key)
        want[key] = [None if not own[c].notna().any() else float(own[c].astype(float).quantile(q)) for c in cols for q in SHARES]
    assert set(got) == set(want)
    for key in want:
        for a, b in zip(got[key], want[key], strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=1e-12), key


def test_small_groups(spark):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"g": [f"g{i % 7}" for i in range(300)], "h": [i % 3 for i in range(300)], "x": r.normal(size=300), "y": r.integers(0, 4, 300).astype(float)})
    frame.loc[frame.g == "g2", "x"] = None
    frame.loc[frame.g == "g3", "g"] = None
    frame = frame.astype(object).where(frame.notna(), None)
    compare(spark, frame, ["g", "h"], ["x", "y"])


@pytest.mark.parametrize("spread", [0.001, 0.2])
def test_one_group_with_nearly_all_rows(spark, monkeypatch, spread):
    """Large groups by brackets; with the wide spread brackets have to be narrowed, with ties they end in one value."""
    monkeypatch.setattr(quantiles, "KEEP", 1500)
    monkeypatch.setattr(quantiles, "SPREAD", spread)
    r = np.random.default_rng(2)
    n = 30000
    frame = pd.DataFrame({"g": np.where(r.random(n) < 0.9, "hot", r.choice(["a", "b", "c"], n)), "x": r.lognormal(0, 3, n), "y": r.choice([1.0, 2.0, 3.0], n, p=[0.05, 0.9, 0.05]), "z": r.normal(size=n)})
    frame.loc[r.random(n) < 0.97, "z"] = None  # few values in a large group
    frame = frame.astype(object).where(frame.notna(), None)
    compare(spark, frame, ["g"], ["x", "y", "z"])


def test_nothing_large_is_gathered(spark, monkeypatch):
    """What a step of a large group gathers stays below ``KEEP``."""
    monkeypatch.setattr(quantiles, "KEEP", 1500)
    seen = []
    kept = quantiles.kept

    def look(df, name):
        out = kept(df, name)
        if name == "quantile-step":
            seen.extend(r.inner for r in out.filter("few").collect())
        return out

    monkeypatch.setattr(quantiles, "kept", look)
    df = spark.range(0, 200000, 1, 8).select(F.lit(1).alias("g"), F.rand(3).alias("x"))
    row = quantiles.grouped_quantiles(df, ["g"], {"x": F.col("x")}, (0.5,)).first()
    assert seen and max(seen) <= 1500
    assert row.x_0 == pytest.approx(df.agg(F.percentile("x", 0.5)).first()[0], rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles.grouped_quantiles(df, ["g"], {"x": F.col("x")}, (0.5,)).collect() == []
    assert quantiles.exact_quantiles(df, {"x": F.col("x")}, (0.5,)) == {"x": [None]}
