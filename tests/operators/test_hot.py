from bisect import bisect_left

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import joins, windows
from panelwright.operators.hot import CHUNK, STEP, Hot, hot_entities


@pytest.fixture(scope="module")
def panel(spark):
    """One entity has nearly all rows; gaps of unknown values are longer than a range, and one entity is NULL."""
    r = np.random.default_rng(3)
    rows = [("hot", t, float(r.normal()), float(t)) for t in range(2000) if r.random() < 0.5] + [(e, t, float(r.normal()), 1.0) for e in ("a", "b", None) for t in range(40)]
    frame = pd.DataFrame(rows, columns=["e", "t", "v", "w"])
    frame.loc[r.random(len(frame)) < 0.6, "v"] = np.nan
    frame.loc[(frame.t > 700) & (frame.t < 1100), "v"] = np.nan
    frame = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(frame, "e string, t int, v double, w double").repartition(6).cache()


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple((v is None, v) for v in r)
    a, b = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or p == pytest.approx(q, rel=1e-12) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("rows", [10, 100, 900])
def test_results_equal_the_plain_window(panel, rows):
    hot = hot_entities(panel, "e", "t", rows)
    same(windows.lag_features(panel, "e", "t", ["v", "w"], [1, 3, 30], ["w"], [2, 25], hot=hot), windows.lag_features(panel, "e", "t", ["v", "w"], [1, 3, 30], ["w"], [2, 25]))
    same(windows.lag_features(panel, "e", "t", ["w"], [2], drop_incomplete=True, hot=hot), windows.lag_features(panel, "e", "t", ["w"], [2], drop_incomplete=True))
    same(windows.interpolate(panel, "e", "t", ["v", "w"], 3, hot=hot), windows.interpolate(panel, "e", "t", ["v", "w"], 3))
    same(windows.fill_both_ways(panel, "e", "t", ["v"], hot=hot), windows.fill_both_ways(panel, "e", "t", ["v"]))
    same(windows.sequences(panel, "e", "t", ["w"], "v", 15, ["w"], hot=hot), windows.sequences(panel, "e", "t", ["w"], "v", 15, ["w"]))


def test_metadata_over_ranges(panel):
    hot = hot_entities(panel, "e", "t", 50)
    meta = panel.filter("v IS NOT NULL AND t % 7 = 0").select("e", "t", F.col("v").alias("m"))
    same(joins.attach_nearest(panel, meta, "e", "t", ["m"], hot=hot), joins.attach_nearest(panel, meta, "e", "t", ["m"]))


def test_a_hot_entity_is_split(panel):
    hot = hot_entities(panel, "e", "t", 100)
    sizes = {(r.e, r[CHUNK]): r["count"] for r in hot.split(panel).groupBy("e", CHUNK).count().collect()}
    assert max(sizes.values()) <= 100 and sum(e == "hot" for e, _ in sizes) > 10
    assert {c for e, c in sizes if e != "hot"} == {0}
    assert hot_entities(panel, "e", "t", 10_000) is None
    assert hot_entities(panel.limit(0), "e", "t", 1) is None


def test_a_row_does_not_read_all_cuts(spark):
    cuts = list(range(0, 4000, 2))
    hot = Hot("e", "t", spark.createDataFrame([("h", cuts)], "entity string, cuts array<int>"))
    rows = spark.createDataFrame([("h", t) for t in range(-1, 4002)] + [("h", None), ("a", 7), (None, 7)], "e string, t int")
    at = {(r.e, r.t): r[CHUNK] for r in hot.split(rows).collect()}
    assert at == {("h", t): bisect_left(cuts, t) for t in range(-1, 4002)} | {("h", None): 0, ("a", 7): 0, (None, 7): 0}
    assert len(cuts) > STEP * 10


@pytest.mark.parametrize("rows", [100, 10_000])
def test_no_frame_runs_to_the_end(panel, rows):
    hot = hot_entities(panel, "e", "t", rows)
    for out in (windows.interpolate(panel, "e", "t", ["v"], hot=hot), windows.fill_both_ways(panel, "e", "t", ["v"], hot=hot)):
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString()
