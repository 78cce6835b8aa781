"""The driver's contract, on the smallest of the given tables."""

import os

import pytest

import __spark_entry__ as entry
from panelwright.plans.oracle import ORACLE_SQL
from panelwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["panel_region_year", "interpolate", "impute_panel", "panel_merge_outer", "winsorize", "dedup_first", "wide_to_panel", "vif_table", "time_folds", "ridge_path", "sparse_categories", "category_effects"])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    rounded = lambda v: round(float(v), 3) if isinstance(v, float) else v
    a, b = (sorted((tuple(map(rounded, r)) for r in rows), key=str) for rows in (map(tuple, got.select(*cols).collect()), want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or v == pytest.approx(w, abs=2e-3)


def test_no_python_in_the_panel_queries(spark):
    for name in ("preprocess_panel", "interpolate", "sequences", "spearman", "random_split"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["inspect_outliers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan.replace("\n", " ") or "Or(LessThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    panel = QUERIES["panel_region_year"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in panel and "c_acctbal" not in panel
