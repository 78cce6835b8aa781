"""The queries of ``plans.queries`` in DuckDB's SQL."""

from __future__ import annotations

CY = """cy AS (SELECT o_custkey AS custkey, year(o_orderdate) AS year, avg(o_totalprice) AS price, count(*) AS n_orders FROM orders GROUP BY ALL)"""
CUST = """cust AS (SELECT c_custkey AS custkey, c_mktsegment AS segment, n_name AS nation, r_name AS region, c_acctbal AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FULL = f"""{CY}, {CUST}, full_cy AS (SELECT cy.*, segment, nation, region, acctbal FROM cy LEFT JOIN cust USING (custkey))"""
SHIP = """line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_quantity, l_extendedprice, l_discount) AS rn FROM lineitem) WHERE rn = 1),
ship AS (SELECT o_custkey AS custkey, year(l_shipdate) AS year, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS quantity
  FROM line JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
UD = """daily AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value, count(*) AS n_events FROM events GROUP BY ALL),
grid AS (SELECT user_id, CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM daily)),
ud AS (SELECT user_id, day, value, n_events FROM grid LEFT JOIN daily USING (user_id, day))"""
WIDE = """long AS (SELECT user_id, event_type, 2000 + day(ts) AS year, avg(value) AS value FROM events GROUP BY ALL)"""
def _tvt(rows: str, val: int, test: int) -> str:
    """``tvt``: rows of a table labelled by calendar; val are the last years there are before the test years."""
    return f"""times AS (SELECT year, year >= (SELECT max(year) FROM {rows}) - {test - 1} AS late FROM (SELECT DISTINCT year FROM {rows})),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY late ORDER BY year DESC) AS r FROM times),
tvt AS (SELECT {rows}.*, CASE WHEN late THEN 'test' WHEN r <= {val} THEN 'val' ELSE 'train' END AS split FROM {rows} JOIN placed USING (year))"""


LABELLED_TVT = f"{CY}, {_tvt('cy', 2, 2)}"
#: The customer-year panel with last year's price; moments of the training rows, and predictions of one-column models.
LAG = f"""{FULL}, lagged AS (SELECT * FROM (SELECT full_cy.*, lag(price) OVER (PARTITION BY custkey ORDER BY year) AS lag1 FROM full_cy) WHERE lag1 IS NOT NULL AND price IS NOT NULL)"""
MOMENTS = "st AS (SELECT avg(lag1) AS mx, stddev_pop(lag1) AS sx, avg(price) AS my, covar_pop(lag1, price) / stddev_pop(lag1) AS b FROM tvt WHERE split = 'train')"


def _results(weights: str, head: str, splits: str) -> str:
    return f"""w AS ({weights}), pred AS (SELECT model, split, price AS y, my + w * (lag1 - mx) / sx AS p FROM tvt, st, w WHERE split IN ({splits}))
SELECT {head}, split, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM pred GROUP BY model, split"""


PRED = f"""{FULL}, cut AS (SELECT max(year) - 1 AS c FROM cy),
pred AS (SELECT full_cy.*, price AS y_true, (SELECT avg(price) FROM full_cy, cut WHERE year < c) AS y_pred FROM full_cy, cut WHERE year >= c),
err AS (SELECT *, y_true - y_pred AS error, abs(y_true - y_pred) AS abs_error FROM pred)"""
#: Few entities with many rows, under the names of ``ud``.
KINDS = """ud AS (SELECT event_type AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS day, CASE WHEN max(event_id) % 3 <> 0 THEN avg(value) END AS value, max(event_id) AS n_events FROM events GROUP BY ALL)"""
INTERP = """num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS no FROM ud),
near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN no END IGNORE NULLS) OVER b AS pn, last_value(value IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN no END IGNORE NULLS) OVER a AS nn, first_value(value IGNORE NULLS) OVER a AS nv
  FROM num WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (SELECT user_id, day, n_events, CASE WHEN value IS NOT NULL THEN value
    WHEN coalesce(no - pn <= {limit}, false) OR coalesce(nn - no <= {limit}, false) THEN coalesce(pv + (nv - pv) * (no - pn) / (nn - pn), pv, nv) END AS value FROM near)"""
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _line(extra: str = "") -> str:
    return f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice{extra}"


def _merge(how: str) -> str:
    return f"""WITH {FULL}, {SHIP} SELECT coalesce(a.custkey, b.custkey) AS custkey, CAST(coalesce(a.year, b.year) AS BIGINT) AS year, round(price, 6) AS price, region, round(revenue, 6) AS revenue, round(quantity, 6) AS quantity
FROM full_cy a {how} JOIN ship b ON a.custkey = b.custkey AND a.year = b.year"""


#: Moments of two columns and what they predict.
_TWO = """WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS qq, var_pop(l_tax) * count(*) AS tt, covar_pop(l_quantity, l_tax) * count(*) AS qt, covar_pop(l_quantity, l_extendedprice) * count(*) AS qy, covar_pop(l_tax, l_extendedprice) * count(*) AS ty FROM lineitem)"""


def _describe(c: str) -> str:
    return f"""count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max"""


def _missing(c: str) -> str:
    n = f"count(*) FILTER (WHERE {c} IS NULL)"
    return f"SELECT '{c}' AS feature, round_even({n} / count(*), 4) AS missing_fraction, {n} AS missing_count, count({c}) AS non_missing_count FROM ud"


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _PAIRS)
_GROSS = "l_extendedprice * (1 + l_tax)"
_HIGH = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {'gross' if b == 'gross' else b}) AS r FROM (SELECT *, {_GROSS} AS gross FROM lineitem)" for a, b in [*_PAIRS, *((c, "gross") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))])

ORACLE_SQL: dict[str, str] = {
    "panel_region_year": f"WITH {FULL} SELECT region, year, round(avg(price), 4) AS mean_price, count(*) AS n_rows FROM full_cy GROUP BY ALL",
    "missingness_table": f"WITH {UD} " + " UNION ALL ".join(map(_missing, ("user_id", "day", "value", "n_events"))),
    "missingness_by_time": f"WITH {UD} SELECT day, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS missing_count, round_even(count(*) FILTER (WHERE value IS NULL) / count(*), 4) AS missing_fraction FROM ud GROUP BY day",
    "missingness_by_entity": f"WITH {UD} SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS missing_count, round_even(count(*) FILTER (WHERE value IS NULL) / count(*), 4) AS missing_fraction FROM ud GROUP BY user_id ORDER BY missing_fraction DESC, user_id LIMIT 20",
    "drop_sparse_columns": f"WITH {UD} SELECT user_id, day, round(value, 4) AS value, n_events FROM ud",
    "drop_constant_columns": f"WITH {UD} SELECT user_id, day, round(value, 4) AS value, n_events FROM ud",
    "bounds_to_null": "SELECT c_custkey AS custkey, CASE WHEN c_acctbal <= 0 OR c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS acctbal FROM customer",
    "bounds_clip": "SELECT c_custkey AS custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) END AS acctbal FROM customer",
    "negative_to_null": "SELECT s_suppkey AS suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS acctbal FROM supplier",
    "keyword_clip": """SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sum(least(greatest(l_quantity, 5), 40)), 2) AS shares, round(CAST(min(least(greatest(l_quantity, 5), 40)) AS DOUBLE), 2) AS low,
round(CAST(max(least(greatest(l_quantity, 5), 40)) AS DOUBLE), 2) AS high, round(sum(l_extendedprice / 100), 2) AS prices FROM lineitem GROUP BY l_linenumber""",
    "inspect_outliers": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 2000 OR o_totalprice > 400000",
    "coverage_filter": f"WITH {CY} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders FROM cy WHERE custkey IN (SELECT custkey FROM cy GROUP BY custkey HAVING count(price) >= 6)",
    "min_times_filter": f"WITH {CY} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders FROM cy WHERE custkey IN (SELECT custkey FROM cy GROUP BY custkey HAVING count(DISTINCT year) >= 5)",
    "drop_missing_target": f"WITH {UD} SELECT user_id, day, round(value, 4) AS value, n_events FROM ud WHERE value IS NOT NULL",
    "winsorize": "SELECT o_orderkey, round(least(greatest(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)), (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)), 4) AS o_totalprice FROM orders",
    "log_eps": "SELECT c_custkey AS custkey, round(c_acctbal, 8) AS acctbal, CASE WHEN c_acctbal >= 0 THEN round(ln(c_acctbal + 1e-6::DOUBLE), 8) END AS log_acctbal FROM customer",
    "log1p_features": "SELECT c_custkey AS custkey, round(c_acctbal, 8) AS acctbal, round(ln(1 + greatest(c_acctbal, 0)), 8) AS acctbal_log1p FROM customer",
    "numeric_text": "SELECT c_custkey, TRY_CAST(substr(c_name, -3, 3) AS DOUBLE) AS tail, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal, 4) END AS mixed FROM customer",
    "clean_outcome": f"""WITH {CY}, ok AS (SELECT custkey, year, CASE WHEN price < 250000 AND price > 20000 AND price <= 220000 THEN price END AS price, n_orders FROM cy), known AS (SELECT * FROM ok WHERE price IS NOT NULL)
SELECT CAST(custkey AS VARCHAR) AS custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders FROM known WHERE custkey IN (SELECT custkey FROM known GROUP BY custkey HAVING count(*) >= 4)""",
    "clean_covariates": """WITH own AS (SELECT l_suppkey AS suppkey, year(l_shipdate) AS year, avg(l_extendedprice) AS price, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
w AS (SELECT suppkey, year, least(greatest(price, (SELECT quantile_cont(price, 0.05) FROM own)), (SELECT quantile_cont(price, 0.95) FROM own)) AS price, flag FROM own)
SELECT CAST(suppkey AS VARCHAR) AS suppkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, flag, round(ln(price + 1e-6::DOUBLE), 4) AS log_price FROM w""",
    "dup_count": "SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "dup_rows": f"{_line()} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "dedup_first": f"{_line()} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
    "dedup_last": f"{_line()} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1",
    "dedup_drop_all": f"{_line()} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "dedup_mean": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
arg_min(CAST(l_partkey AS VARCHAR), (l_quantity, l_extendedprice, CAST(l_partkey AS VARCHAR))) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "panel_merge_inner": _merge("INNER"),
    "panel_merge_left": _merge("LEFT"),
    "panel_merge_right": _merge("RIGHT"),
    "panel_merge_outer": _merge("FULL"),
    "key_coverage": f"""WITH {CY}, {SHIP}, k AS (SELECT cy.custkey AS l, ship.custkey AS r FROM cy FULL JOIN ship ON cy.custkey = ship.custkey AND cy.year = ship.year)
SELECT count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common_keys, count(*) FILTER (WHERE r IS NULL) AS left_lost, count(*) FILTER (WHERE l IS NULL) AS right_lost FROM k""",
    "keys_lost": f"""WITH {CY}, {SHIP} SELECT custkey, CAST(year AS BIGINT) AS year, 'left' AS side FROM cy ANTI JOIN ship USING (custkey, year)
UNION ALL SELECT custkey, CAST(year AS BIGINT) AS year, 'right' AS side FROM ship ANTI JOIN cy USING (custkey, year)""",
    "semi_restrict": f"WITH {CUST}, {SHIP} SELECT custkey, segment, nation, region, round(acctbal, 4) AS acctbal FROM cust WHERE custkey IN (SELECT custkey FROM ship WHERE revenue > 300000)",
    "metadata_join": f"WITH {CY}, {SHIP} SELECT custkey, CAST(year AS BIGINT) AS year, round(revenue, 6) AS revenue, round(quantity, 6) AS quantity, n_orders FROM ship LEFT JOIN cy USING (custkey, year)",
    "metadata_carry": f"""WITH {CY}, {SHIP}, m AS (SELECT ship.*, n_orders FROM ship LEFT JOIN (SELECT * FROM cy WHERE n_orders >= 2) c USING (custkey, year))
SELECT custkey, CAST(year AS BIGINT) AS year, round(revenue, 6) AS revenue, round(quantity, 6) AS quantity, coalesce(last_value(n_orders IGNORE NULLS) OVER b, first_value(n_orders IGNORE NULLS) OVER a) AS n_orders FROM m
WINDOW b AS (PARTITION BY custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY custkey ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "metadata_coverage": f"""WITH {CY}, {SHIP}, m AS (SELECT ship.*, n_orders FROM ship LEFT JOIN (SELECT * FROM cy WHERE n_orders >= 2) c USING (custkey, year)),
f AS (SELECT revenue, max(n_orders) OVER (PARTITION BY custkey) AS any_known FROM m) SELECT round(count(any_known) / count(*), 8) AS n_orders, round(count(revenue) / count(*), 8) AS revenue FROM f""",
    "time_overlap": f"WITH {CY}, {SHIP} SELECT CAST(year AS BIGINT) AS year FROM cy INTERSECT SELECT CAST(year AS BIGINT) AS year FROM ship",
    "union_results": f"""WITH {CY}, {SHIP} SELECT CAST(year AS BIGINT) AS year, count(*) AS n_rows, round(avg(price), 6) AS price, CAST(NULL AS DOUBLE) AS revenue FROM cy GROUP BY year
UNION ALL SELECT CAST(year AS BIGINT), NULL, NULL, round(avg(revenue), 6) FROM ship GROUP BY year""",
    "merge_results": f"WITH {FULL} SELECT region, round(price, 4) AS price, round(acctbal, 4) AS acctbal FROM (SELECT region, avg(price) AS price FROM full_cy GROUP BY region) FULL JOIN (SELECT region, avg(acctbal) AS acctbal FROM cust GROUP BY region) USING (region)",
    "unpivot_wide": f"WITH {WIDE} SELECT user_id, event_type, CAST(year AS BIGINT) AS year, round(value, 4) AS value FROM long WHERE year BETWEEN 2003 AND 2020 AND value IS NOT NULL",
    "pivot_long": """SELECT user_id, CAST(day(ts) AS BIGINT) AS day, """
    + ", ".join(f"round(arg_min(value, event_id) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY ALL",
    "wide_to_panel": f"""WITH {WIDE} SELECT user_id, CAST(year AS BIGINT) AS year, round(max(value) FILTER (WHERE event_type = 'click'), 4) AS ev_click, round(max(value) FILTER (WHERE event_type = 'purchase'), 4) AS ev_purchase
FROM long WHERE event_type IN ('click', 'purchase') AND year BETWEEN 2002 AND 2025 GROUP BY user_id, year""",
    "metric_matrix": f"WITH {FULL} SELECT region, " + ", ".join(f'round(avg(price) FILTER (WHERE segment = \'{s}\'), 4) AS "{s}"' for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM full_cy GROUP BY region",
    "target_mean": f"""WITH {CY}, {SHIP} SELECT coalesce(cy.custkey, ship.custkey) AS custkey, CAST(coalesce(cy.year, ship.year) AS BIGINT) AS year, round(price, 6) AS price, round(revenue, 6) AS revenue,
round((coalesce(price, 0) + coalesce(revenue, 0)) / ((price IS NOT NULL)::INT + (revenue IS NOT NULL)::INT), 6) AS target FROM cy FULL JOIN ship ON cy.custkey = ship.custkey AND cy.year = ship.year""",
    "target_first": f"""WITH {CY}, {SHIP} SELECT coalesce(cy.custkey, ship.custkey) AS custkey, CAST(coalesce(cy.year, ship.year) AS BIGINT) AS year, round(price, 6) AS price, round(revenue, 6) AS revenue,
round(coalesce(price, revenue), 6) AS target FROM cy FULL JOIN ship ON cy.custkey = ship.custkey AND cy.year = ship.year""",
    "describe": f"SELECT 'o_totalprice' AS feature, {_describe('o_totalprice')} FROM orders UNION ALL SELECT 'o_custkey', {_describe('o_custkey')} FROM orders",
    "describe_by_group": f"WITH {FULL} SELECT region, 'price' AS feature, {_describe('price')} FROM full_cy GROUP BY region",
    "skew_kurt": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_discount")),
    "yearly_stats": f"WITH {CY} SELECT CAST(year AS BIGINT) AS year, count(*) AS n_rows, round(avg(price), 2) AS mean, round(median(price), 2) AS median, round(var_samp(price), 2) AS variance FROM cy GROUP BY year",
    "iqr_band": f"WITH {FULL} SELECT region, CAST(year AS BIGINT) AS year, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS q75, count(*) AS size FROM full_cy GROUP BY ALL",
    "box_stats": f"""WITH {FULL}, q AS (SELECT segment, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q75 FROM full_cy GROUP BY segment),
b AS (SELECT q.*, price, price BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM full_cy JOIN q USING (segment))
SELECT segment, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(min(price) FILTER (WHERE inside), 6) AS low_whisker, round(max(price) FILTER (WHERE inside), 6) AS high_whisker, count(*) FILTER (WHERE NOT inside) AS n_outside FROM b GROUP BY ALL""",
    "histogram": """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 25 AS w FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 24) AS BIGINT) AS bin, lo, w FROM lineitem, e) SELECT bin, round(lo + bin * w, 2) AS low, round(lo + (bin + 1) * w, 2) AS high, count(*) AS n FROM b GROUP BY bin, lo, w""",
    "top_groups": f"WITH {FULL} SELECT nation, count(*) AS n_rows FROM full_cy GROUP BY nation ORDER BY n_rows DESC, nation LIMIT 6",
    "in_top_groups": f"""WITH {FULL} SELECT nation, custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, segment, region, round(acctbal, 4) AS acctbal FROM full_cy
WHERE nation IN (SELECT nation FROM full_cy GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 3)""",
    "entity_ranking": f"""WITH {FULL}, m AS (SELECT nation, avg(price) AS mean FROM full_cy GROUP BY nation)
SELECT nation, round(mean, 4) AS mean, 'lowest' AS "end" FROM (SELECT * FROM m ORDER BY mean, nation LIMIT 5) UNION ALL SELECT nation, round(mean, 4), 'highest' FROM (SELECT * FROM m ORDER BY mean DESC, nation LIMIT 5)""",
    "argmin_per_group": f"WITH {FULL} SELECT region, custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY price, custkey, year) AS rn FROM full_cy) WHERE rn = 1",
    "mean_and_std": f"WITH {FULL} SELECT segment, round(avg(price), 4) AS mean, round(stddev(price), 4) AS std, count(*) AS n FROM full_cy GROUP BY segment",
    "distinct_counts": f"WITH {FULL} SELECT count(DISTINCT custkey) AS entities, count(DISTINCT (custkey, year)) AS keys, count(DISTINCT nation) AS nations FROM full_cy",
    "corr_matrix": f"WITH c AS ({_CORR}) SELECT * FROM c UNION ALL SELECT b, a, r FROM c UNION ALL SELECT x, x, 1.0 FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(x)",
    "high_corr_pairs": f"SELECT a, b, round(r, 8) AS r, round(abs(r), 8) AS abs_r FROM ({_HIGH}) WHERE abs(r) > 0.5",
    "corr_with_target": "SELECT feature, r, abs(r) AS abs_r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 8) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")",
    "spearman": """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round(corr(a, b), 8) AS rho FROM r""",
    "vif_table": """WITH s AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_extendedprice * l_extendedprice) AS bb, sum(l_quantity * l_extendedprice) AS ab FROM lineitem)
SELECT feature, round(1 / (1 - ab * ab / (aa * bb)), 6) AS vif FROM s, (VALUES ('l_quantity'), ('l_extendedprice')) v(feature)""",
    "model_frame": f"WITH {FULL} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, round(price * 2, 4) AS double_price, 1.0::DOUBLE AS one, round(ln(1 + price), 4) AS price_log1p, 0::DOUBLE AS status_flag, 0::DOUBLE AS price_missing FROM full_cy",
    "corr_prune": "SELECT feature, feature <> 'twice' AND NOT (feature = 'l_extendedprice' AND (SELECT abs(corr(l_quantity, l_extendedprice)) >= 0.9 FROM lineitem)) AS kept FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('twice')) v(feature)",
    "lag_features": f"WITH {UD} SELECT user_id, day, round(value, 6) AS value, n_events, round(lag(value, 1) OVER w, 6) AS value_lag1, round(lag(value, 2) OVER w, 6) AS value_lag2, lag(n_events, 1) OVER w AS n_events_lag1, lag(n_events, 2) OVER w AS n_events_lag2 FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day)",
    "rolling_mean": f"""WITH {CY}, r AS (SELECT *, lag(price) OVER (PARTITION BY custkey ORDER BY year) AS price_lag1, CASE WHEN count(price) OVER w = 3 THEN avg(price) OVER w END AS price_rollmean3 FROM cy WINDOW w AS (PARTITION BY custkey ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, round(price_lag1, 4) AS price_lag1, round(price_rollmean3, 4) AS price_rollmean3 FROM r WHERE price_lag1 IS NOT NULL AND price_rollmean3 IS NOT NULL""",
    "interpolate": f"WITH {UD}, {INTERP.format(limit=2)} SELECT user_id, day, round(value, 8) AS value, n_events FROM interp",
    "hot_lags": f"""WITH {KINDS} SELECT user_id AS event_type, day AS second, round(value, 6) AS value, n_events AS event_id, round(lag(value, 1) OVER w, 6) AS value_lag1, round(lag(value, 4) OVER w, 6) AS value_lag4,
round(CASE WHEN count(value) OVER r = 3 THEN avg(value) OVER r END, 6) AS value_rollmean3 FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day), r AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "hot_interpolate": f"WITH {KINDS}, {INTERP.format(limit=2)} SELECT user_id AS event_type, day AS second, round(value, 6) AS value, n_events AS event_id FROM interp",
    "hot_fill": f"""WITH {KINDS} SELECT user_id AS event_type, day AS second, round(coalesce(last_value(value IGNORE NULLS) OVER b, first_value(value IGNORE NULLS) OVER a), 6) AS value, n_events AS event_id FROM ud
WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "hot_sequences": f"""WITH {KINDS}, s AS (SELECT user_id AS event_type, day AS second, round(value, 6) AS target, round(lag(value, 2) OVER w, 6) AS value_0, round(lag(value, 1) OVER w, 6) AS value_1 FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT * FROM s WHERE target IS NOT NULL AND value_0 IS NOT NULL AND value_1 IS NOT NULL""",
    "fill_both": f"""WITH {UD} SELECT user_id, day, round(coalesce(last_value(value IGNORE NULLS) OVER b, first_value(value IGNORE NULLS) OVER a), 6) AS value, n_events FROM ud
WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "moving_average": f"""WITH {UD}, m AS (SELECT day, avg(value) AS mean FROM ud GROUP BY day) SELECT day, round(mean, 6) AS mean, CASE WHEN count(mean) OVER w = 5 THEN round(avg(mean) OVER w, 6) END AS mean_ma5 FROM m
WINDOW w AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "running_best": f"WITH {UD}, m AS (SELECT day, avg(value) AS mean FROM ud GROUP BY day) SELECT day, round(mean, 6) AS mean, round(max(mean) OVER (ORDER BY day), 6) AS best_so_far FROM m",
    "rank_table": f"WITH {CUST}, m AS (SELECT nation, round(avg(acctbal), -2) AS score, count(*) AS n_rows FROM cust GROUP BY nation) SELECT nation, score, n_rows, rank() OVER (ORDER BY score DESC) AS rank FROM m",
    "sequences": f"""WITH {UD}, s AS (SELECT user_id, day, value AS target, lag(value, 3) OVER w AS value_0, lag(n_events, 3) OVER w AS n_0, lag(value, 2) OVER w AS value_1, lag(n_events, 2) OVER w AS n_1, lag(value, 1) OVER w AS value_2, lag(n_events, 1) OVER w AS n_2
FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(target, 6) AS target, round(value_0, 6) AS value_0, round(n_0::DOUBLE, 6) AS n_0, round(value_1, 6) AS value_1, round(n_1::DOUBLE, 6) AS n_1, round(value_2, 6) AS value_2, round(n_2::DOUBLE, 6) AS n_2
FROM s WHERE target IS NOT NULL AND value_0 IS NOT NULL AND value_1 IS NOT NULL AND value_2 IS NOT NULL""",
    "sequence_delta": f"""WITH {UD}, s AS (SELECT user_id, day, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(value, 6) AS value, round(l1, 6) AS last_target, round(value - l1, 6) AS delta FROM s WHERE value IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL""",
    "group_median_fill": f"WITH {UD} SELECT ud.user_id, day, round(coalesce(value, m), 6) AS value, n_events FROM ud JOIN (SELECT user_id, median(value) AS m FROM ud GROUP BY user_id) USING (user_id)",
    "global_median_fill": f"WITH {UD} SELECT user_id, day, round(coalesce(value, (SELECT median(value) FROM ud)), 6) AS value, round(CAST(coalesce(n_events, (SELECT median(n_events) FROM ud)) AS DOUBLE), 6) AS n_events FROM ud",
    "impute_panel": f"""WITH {UD}, {INTERP.format(limit=1)}, g AS (SELECT user_id, median(value) AS m FROM interp GROUP BY user_id)
SELECT user_id, day, round(coalesce(value, m), 8) AS value, round(CAST(coalesce(n_events, (SELECT median(n_events) FROM ud)) AS DOUBLE), 8) AS n_events FROM interp JOIN g USING (user_id)""",
    "impute_counts": f"""WITH {UD}, {INTERP.format(limit=1)}, g AS (SELECT user_id, median(value) AS m FROM interp GROUP BY user_id)
SELECT count(*) AS rows, (SELECT count(*) FROM ud WHERE value IS NULL) - count(*) FILTER (WHERE value IS NULL) AS interpolated_value, count(*) FILTER (WHERE value IS NULL AND m IS NOT NULL) AS group_median_value, count(*) FILTER (WHERE n_events IS NULL) AS median_n_events FROM interp JOIN g USING (user_id)""",
    "flags_interactions": f"WITH {UD} SELECT user_id, day, CAST(value IS NULL AS BIGINT) AS value_missing, round(value * n_events, 6) AS value__x__n_events FROM ud",
    "status_flag": f"WITH {CUST} SELECT custkey, CAST(coalesce(contains(lower(segment), 'build'), false) AS BIGINT) AS status_flag FROM cust",
    "time_split": f"WITH {CY} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, CASE WHEN year >= (SELECT max(year) - 1 FROM cy) THEN 'test' ELSE 'train' END AS split FROM cy",
    "time_train_val_test": f"WITH {LABELLED_TVT} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, split FROM tvt",
    "overlap_split": f"""WITH {CY}, {SHIP}, c AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT year FROM cy INTERSECT SELECT year FROM ship)), l AS (SELECT year, CASE r WHEN 1 THEN 'test' ELSE 'val' END AS label FROM c WHERE r <= 2)
SELECT custkey, CAST(ship.year AS BIGINT) AS year, round(revenue, 6) AS revenue, round(quantity, 6) AS quantity, coalesce(label, 'train') AS split FROM ship LEFT JOIN l USING (year) WHERE label IS NOT NULL OR ship.year < (SELECT min(year) FROM l)""",
    "time_folds": f"""WITH {CY}, t AS (SELECT year, dense_rank() OVER (ORDER BY year DESC) - 1 AS back FROM (SELECT DISTINCT year FROM cy)), f AS (SELECT * FROM t, (VALUES (0), (1), (2)) v(fold) WHERE back >= 2 - fold)
SELECT custkey, CAST(cy.year AS BIGINT) AS year, round(price, 4) AS price, n_orders, CAST(fold AS BIGINT) AS fold, CASE WHEN back = 2 - fold THEN 'val' ELSE 'train' END AS split FROM cy JOIN f USING (year)""",
    "shuffled_folds": """WITH u AS (SELECT o_orderkey, (CAST(('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY u) - 1 AS r, count(*) OVER () AS n FROM u)
SELECT o_orderkey, CAST((SELECT count(*) FROM range(1, 7) i(i) WHERE r >= n * i // 7) AS BIGINT) AS fold FROM r""",
    "permuted_line": f"""WITH RECURSIVE {LAG}, rows AS (SELECT row_number() OVER (ORDER BY custkey, year) - 1 AS no, price, lag1, n_orders, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM lagged),
walk AS (
  SELECT no, rep, n, a, no AS x, 0 AS step FROM rows, range(3) t(rep)
  UNION ALL
  SELECT no, rep, n, a, l * a + r, 1 FROM (
    {"SELECT no, rep, n, a, r AS l, (l + CAST(('0x' || substr(md5('7:' || rep || ':4:' || r), 1, 13)) AS BIGINT)) % a AS r FROM ("}
    {"SELECT no, rep, n, a, r AS l, (l + CAST(('0x' || substr(md5('7:' || rep || ':3:' || r), 1, 13)) AS BIGINT)) % a AS r FROM ("}
    {"SELECT no, rep, n, a, r AS l, (l + CAST(('0x' || substr(md5('7:' || rep || ':2:' || r), 1, 13)) AS BIGINT)) % a AS r FROM ("}
    {"SELECT no, rep, n, a, r AS l, (l + CAST(('0x' || substr(md5('7:' || rep || ':1:' || r), 1, 13)) AS BIGINT)) % a AS r FROM ("}
    SELECT no, rep, n, a, x // a AS l, x % a AS r FROM walk WHERE step = 0 OR x >= n)))))),
turns AS (SELECT no, rep, x AS donor FROM walk WHERE step = 1 AND x < n),
e AS (SELECT t.rep, r.price - (1000.0 + 0.8 * r.lag1 + 5000.0 * r.n_orders) AS e0, r.price - (1000.0 + 0.8 * d.lag1 + 5000.0 * r.n_orders) AS e1, r.price - (1000.0 + 0.8 * r.lag1 + 5000.0 * d.n_orders) AS e2
  FROM turns t JOIN rows r ON t.no = r.no JOIN rows d ON t.donor = d.no),
s AS (SELECT rep, sqrt(avg(e1 * e1)) - sqrt(avg(e0 * e0)) AS d1, sqrt(avg(e2 * e2)) - sqrt(avg(e0 * e0)) AS d2 FROM e GROUP BY rep)
SELECT 'price_lag1' AS feature, round(avg(d1), 4) AS importance_mean, round(stddev_pop(d1), 4) AS importance_std FROM s UNION ALL SELECT 'n_orders', round(avg(d2), 4), round(stddev_pop(d2), 4) FROM s""",
    "contiguous_folds": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, ntile(5) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders",
    "split_summary": f"WITH {LABELLED_TVT} SELECT split, count(*) AS n_rows, CAST(min(year) AS BIGINT) AS min_time, CAST(max(year) AS BIGINT) AS max_time FROM tvt GROUP BY split",
    "random_split": """WITH u AS (SELECT o_orderkey, (CAST(('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY u) AS r, count(*) OVER () AS n FROM u) SELECT o_orderkey, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""",
    "standard_scale": f"""WITH {UD}, t AS (SELECT * FROM ud WHERE dayofyear(day) < (SELECT max(dayofyear(day)) - 4 FROM ud)), m AS (SELECT median(value) AS mv, median(n_events) AS mn FROM t),
s AS (SELECT avg(coalesce(value, mv)) AS av, stddev_pop(coalesce(value, mv)) AS sv, avg(coalesce(n_events, mn)) AS an, stddev_pop(coalesce(n_events, mn)) AS sn FROM t, m)
SELECT user_id, day, round((coalesce(value, mv) - av) / sv, 6) AS value, round((coalesce(n_events, mn) - an) / sn, 6) AS n_events, (value IS NULL)::INT::DOUBLE AS value_missing, (n_events IS NULL)::INT::DOUBLE AS n_events_missing FROM ud, m, s""",
    "robust_scale": f"""WITH {UD}, t AS (SELECT * FROM ud WHERE dayofyear(day) < (SELECT max(dayofyear(day)) - 4 FROM ud)), m AS (SELECT median(value) AS mv FROM t),
s AS (SELECT median(coalesce(value, mv)) AS c, quantile_cont(coalesce(value, mv), 0.75) - quantile_cont(coalesce(value, mv), 0.25) AS w FROM t, m) SELECT user_id, day, round((coalesce(value, mv) - c) / w, 6) AS value FROM ud, m, s""",
    "mode_onehot": f"""WITH {CUST}, p AS (SELECT custkey, CASE WHEN custkey % 5 <> 0 THEN region END AS place FROM cust), m AS (SELECT place FROM p WHERE custkey % 3 <> 0 AND place IS NOT NULL GROUP BY place ORDER BY count(*) DESC, place LIMIT 1)
SELECT custkey, """
    + ", ".join(f"(coalesce(p.place, m.place) = '{r}')::INT::DOUBLE AS \"place={r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    + " FROM p, m",
    "sparse_categories": """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_returnflag AS VARCHAR) AS flag, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS part FROM lineitem),
v AS (SELECT 0 AS col, flag AS value FROM p WHERE l_suppkey % 4 <> 0 UNION ALL SELECT 1, part FROM p WHERE l_suppkey % 4 <> 0), c AS (SELECT col, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (ORDER BY col, value) - 1 AS at FROM c), m AS (SELECT (SELECT value FROM c WHERE col = 0 ORDER BY n DESC, value LIMIT 1) AS flag, (SELECT value FROM c WHERE col = 1 ORDER BY n DESC, value LIMIT 1) AS part)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, concat_ws(',', a.at, b.at) AS codes, (SELECT count(*) FROM c) AS size FROM p, m LEFT JOIN t a ON a.col = 0 AND a.value = coalesce(p.flag, m.flag) LEFT JOIN t b ON b.col = 1 AND b.value = coalesce(p.part, m.part)""",
    # from plain sums, with two unknowns left after the effects are eliminated
    "category_effects": """WITH a AS (SELECT unnest([0.0, 2.0])::DOUBLE AS alpha), mid AS (SELECT avg(l_quantity) AS qm FROM lineitem), p AS (SELECT CAST(l_partkey AS VARCHAR) AS part, l_quantity - qm AS x, l_extendedprice AS y FROM lineitem, mid WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
c AS (SELECT part, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM p GROUP BY part),
r AS (SELECT alpha, sum(n - n * n / (n + alpha)) AS oo, sum(sx - n * sx / (n + alpha)) AS ox, sum(sy - n * sy / (n + alpha)) AS oy, sum(xx - sx * sx / (n + alpha)) + alpha AS qq, sum(xy - sx * sy / (n + alpha)) AS qy FROM c, a GROUP BY alpha),
w AS (SELECT alpha, CASE WHEN alpha = 0 THEN qy / qq ELSE (oo * qy - ox * oy) / (oo * qq - ox * ox) END AS slope, CASE WHEN alpha <> 0 THEN (qq * oy - ox * qy) / (oo * qq - ox * ox) END AS at_mid FROM r),
k AS (SELECT alpha, slope, CASE WHEN alpha = 0 THEN 0 ELSE at_mid - slope * qm END AS b, qm FROM w, mid)
SELECT alpha, part AS term, n, round((sy - slope * (sx + n * qm) - n * b) / (n + alpha), 3) AS weight FROM c, k
UNION ALL SELECT alpha, 'intercept', 0, round(b, 3) FROM k UNION ALL SELECT alpha, 'slope', 0, round(slope, 3) FROM k""",
    "ols_simple": f"""{_TWO}, w AS (SELECT *, (tt * qy - qt * ty) / (qq * tt - qt * qt) AS wq, (qq * ty - qt * qy) / (qq * tt - qt * qt) AS wt FROM m)
SELECT CAST(n AS BIGINT) AS n_columns, term, round(weight, 2) AS weight FROM (SELECT 1 AS n, 'intercept' AS term, my - qy / qq * mq AS weight FROM w UNION ALL SELECT 1, 'l_quantity', qy / qq FROM w
  UNION ALL SELECT 2, 'intercept', my - wq * mq - wt * mt FROM w UNION ALL SELECT 2, 'l_quantity', wq FROM w UNION ALL SELECT 2, 'l_tax', wt FROM w)""",
    "ridge_path": f"""{_TWO}, f AS (SELECT l_linenumber % 3 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), alphas AS (SELECT unnest([0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS alpha), folds AS (SELECT DISTINCT fold FROM f),
tr AS (SELECT g.fold, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM folds g JOIN f ON f.fold <> g.fold GROUP BY g.fold),
sc AS (SELECT alpha, f.fold, 1 - sum((y - (my + sxy / (sxx + alpha) * (x - mx))) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN tr USING (fold), alphas GROUP BY alpha, f.fold),
al AS (SELECT covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM f)
SELECT alpha, round(any_value(sxy / (sxx + alpha)), 6) AS slope, round(avg(r2), 6) AS mean_r2,
       round(any_value(((tt + alpha) * qy - qt * ty) / ((qq + alpha) * (tt + alpha) - qt * qt)), 3) AS two_quantity, round(any_value(((qq + alpha) * ty - qt * qy) / ((qq + alpha) * (tt + alpha) - qt * qt)), 3) AS two_tax
FROM sc, al, m GROUP BY alpha""",
    "regression_metrics": f"WITH {PRED} SELECT count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs_error), 6) AS mae, round(1 - sum(error * error) / (var_pop(y_true) * count(*)), 6) AS r2 FROM err",
    "error_by_group": f"WITH {PRED} SELECT region, count(*) AS n, round(avg(abs_error), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse FROM err GROUP BY region",
    "error_by_time": f"WITH {PRED} SELECT CAST(year AS BIGINT) AS year, count(*) AS n, round(avg(abs_error), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse FROM err GROUP BY year",
    "error_by_entity": f"WITH {PRED} SELECT nation, round(avg(abs_error), 4) AS mae, count(*) AS n FROM err GROUP BY nation ORDER BY avg(abs_error) DESC, nation LIMIT 10",
    "worst_errors": f"WITH {PRED} SELECT custkey, CAST(year AS BIGINT) AS year, round(y_true, 4) AS y_true, round(y_pred, 4) AS y_pred, round(error, 4) AS error, round(abs_error, 4) AS abs_error FROM err ORDER BY err.abs_error DESC, custkey, year LIMIT 20",
    "linear_shap": f"""{_TWO}, w AS (SELECT *, (tt * qy - qt * ty) / (qq * tt - qt * qt) AS wq, (qq * ty - qt * qy) / (qq * tt - qt * qt) AS wt FROM m)
SELECT 'l_quantity' AS feature, round(avg(abs(wq * (l_quantity - mq))), 2) AS mean_abs_shap FROM lineitem, w UNION ALL SELECT 'l_tax', round(avg(abs(wt * (l_tax - mt))), 2) FROM lineitem, w""",
    "scaled_sequences": f"""WITH {UD}, s AS (SELECT user_id, day, value, lag(value, 2) OVER w AS v0, lag(n_events, 2) OVER w AS n0, lag(value, 1) OVER w AS v1, lag(n_events, 1) OVER w AS n1 FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day)),
q AS (SELECT * FROM s WHERE value IS NOT NULL AND v0 IS NOT NULL AND v1 IS NOT NULL), t AS (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS r FROM (SELECT DISTINCT day FROM q)),
l AS (SELECT q.*, CASE WHEN r <= 3 THEN 'test' WHEN r <= 6 THEN 'val' ELSE 'train' END AS split FROM q JOIN t USING (day)), st AS (SELECT unnest([v0, v1]) AS v, unnest([n0, n1]) AS n FROM l WHERE split = 'train'),
m AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(n) AS mn, stddev_pop(n) AS sn FROM st)
SELECT user_id, day, split, round((v0 - mv) / sv, 6) AS value_0, round((n0 - mn) / sn, 6) AS n_0, round((v1 - mv) / sv, 6) AS value_1, round((n1 - mn) / sn, 6) AS n_1 FROM l, m""",
    "metric_gap": f"""WITH {FULL}, cut AS (SELECT max(year) - 1 AS c FROM cy),
a AS (SELECT region, sqrt(avg((price - m) ** 2)) AS rmse, avg(abs(price - m)) AS mae FROM full_cy, (SELECT avg(price) AS m FROM full_cy WHERE custkey % 5 <> 0) WHERE custkey % 5 = 0 GROUP BY region),
b AS (SELECT region, sqrt(avg((price - m) ** 2)) AS rmse, avg(abs(price - m)) AS mae FROM full_cy, cut, (SELECT avg(price) AS m FROM full_cy, cut WHERE year < c) WHERE year >= c GROUP BY region)
SELECT region, round(a.rmse, 4) AS rmse_odd, round(a.mae, 4) AS mae_odd, round(b.rmse, 4) AS rmse_time, round(b.mae, 4) AS mae_time, round(b.rmse - a.rmse, 4) AS rmse_gap, round(b.mae - a.mae, 4) AS mae_gap FROM a JOIN b USING (region)""",
    "standardize_source": "SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS year, CAST(o_totalprice AS VARCHAR) AS price, o_orderkey AS a_b_c FROM orders",
    "preprocess_panel": f"""WITH {CY}, {SHIP}, p AS (SELECT custkey, year, CASE WHEN n_orders > 1 AND price > 0 AND price <= 1e7 THEN price END AS price FROM cy), k AS (SELECT * FROM p WHERE price IS NOT NULL),
l AS (SELECT CAST(custkey AS VARCHAR) AS custkey, year, price FROM k WHERE custkey IN (SELECT custkey FROM k GROUP BY custkey HAVING count(*) >= 2)),
r AS (SELECT CAST(custkey AS VARCHAR) AS custkey, year, least(greatest(revenue, (SELECT quantile_cont(revenue, 0.01) FROM ship)), (SELECT quantile_cont(revenue, 0.99) FROM ship)) AS revenue, quantity FROM ship)
SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 6) AS price, round(revenue, 6) AS revenue, round(quantity, 6) AS quantity, round(ln(revenue + 1e-6::DOUBLE), 6) AS log_revenue, round((price + revenue) / 2, 6) AS outcome FROM l JOIN r USING (custkey, year)""",
    "load_parquet_source": "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer",
    "csv_source": "SELECT c_custkey AS custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, round(c_acctbal, 4) AS acctbal, '\"' || substr(c_mktsegment, 1, 4) || '\", first' || chr(10) || c_name || chr(10) || chr(10) || ', last' AS note FROM customer",
    "preamble_source": f"WITH {FULL} SELECT nation AS country, upper(substr(nation, 1, 3)) AS country_code, 'N.ORD' AS indicator_code, CAST(year AS BIGINT) AS year, CAST(sum(n_orders) AS DOUBLE) AS value FROM full_cy GROUP BY nation, year",
    "table_sinks": f"WITH {CY} SELECT CAST(year AS BIGINT) AS year, count(*) AS n_rows, CAST(sum(n_orders) AS BIGINT) AS n_orders, fmt FROM cy, (VALUES ('parquet'), ('csv')) f(fmt) GROUP BY year, fmt",
    "json_summary": f"WITH {CY} SELECT count(*) AS output_rows, CAST(min(year) AS BIGINT) AS min_time, CAST(max(year) AS BIGINT) AS max_time, CAST(4 AS BIGINT) AS output_cols FROM cy",
    "run_log": f"""WITH {FULL}, a AS (SELECT region, round(avg(price), 4) AS mean_price, count(*) AS n_rows FROM full_cy GROUP BY region)
SELECT *, CAST(NULL AS VARCHAR) AS run FROM a UNION ALL SELECT *, 'second' FROM a UNION ALL SELECT region, round(avg(price), 4), count(*), NULL FROM full_cy WHERE year >= 1998 GROUP BY region""",
    "load_or_build": f"WITH {CY} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders FROM cy WHERE n_orders > 1",
    "standardized_sources": f"WITH {CY}, {SHIP} SELECT 'orders' AS source, count(*) AS rows, CAST(4 AS BIGINT) AS cols FROM cy UNION ALL SELECT 'shipped', count(*), 4 FROM ship",
    "time_range": f"""WITH {CY}, kinds AS (SELECT * FROM (VALUES ('both', 1997, 1999), ('from', 2000, 9999), ('to', 0, 1996)) k(kind, a, b))
SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, kind FROM cy JOIN kinds ON year BETWEEN a AND b""",
    "output_summary": f"WITH {CY}, {SHIP} SELECT count(*) AS output_rows, CAST(min(year) AS BIGINT) AS min_time, CAST(max(year) AS BIGINT) AS max_time, CAST(4 AS BIGINT) AS output_cols FROM ship",
    "cardinality": f"WITH {CUST} SELECT o_orderkey, custkey, round(o_totalprice, 4) AS o_totalprice, nation FROM orders JOIN cust ON o_custkey = custkey",
    "metadata_repeated": f"""WITH {SHIP}, m AS (SELECT * FROM (SELECT o_custkey AS custkey, year(o_orderdate) AS year, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderpriority DESC) AS rn FROM orders WHERE o_totalprice > 100000) WHERE rn = 1),
j AS (SELECT ship.custkey, ship.year, quantity, priority FROM ship LEFT JOIN m USING (custkey, year) WHERE custkey IN (SELECT custkey FROM m))
SELECT custkey, CAST(year AS BIGINT) AS year, round(quantity, 4) AS quantity, coalesce(last_value(priority IGNORE NULLS) OVER (PARTITION BY custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(priority IGNORE NULLS) OVER (PARTITION BY custkey ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS priority FROM j""",
    "vif_prune": """WITH x AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b FROM lineitem), v AS (SELECT 1 / (1 - sum(a * b) * sum(a * b) / (sum(a * a) * sum(b * b))) > 10 AS high FROM x)
SELECT protected, feature, NOT (high AND feature = 'l_quantity' AND protected <> 'both') AS kept FROM v, (VALUES ('none'), ('one'), ('both')) p(protected), (VALUES ('l_quantity'), ('twice')) f(feature)""",
    "corr_prune_protected": "SELECT feature, feature <> 'l_tax' AND NOT (feature = 'l_extendedprice' AND (SELECT abs(corr(l_quantity, l_extendedprice)) >= 0.9 FROM lineitem)) AS kept FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('twice')) v(feature)",
    "feature_sets_abc": f"""WITH {FULL}, r AS (SELECT corr(price, ln(1 + price)) >= 0.9 AS high, 1 / (1 - sum(price * ln(1 + price)) * sum(price * ln(1 + price)) / (sum(price * price) * sum(ln(1 + price) * ln(1 + price)))) > 10 AS blown FROM full_cy)
SELECT kind, name, CAST(place AS BIGINT) AS place, feature FROM r, (VALUES ('set', 'A', 0, 'price'), ('set', 'A', 1, 'double_price'), ('set', 'A', 2, 'price_log1p'), ('set', 'B', 0, 'price'), ('set', 'B', 1, 'price_log1p'), ('set', 'C', 0, 'price_log1p'), ('set', 'C', 0, 'price'),
  ('dropped', 'constant', 0, 'one'), ('dropped', 'constant', 1, 'status_flag'), ('dropped', 'constant', 2, 'price_missing'), ('dropped', 'correlated', 0, 'double_price'), ('dropped', 'correlated', 1, 'price_log1p'), ('dropped', 'inflated', 0, 'price')) v(kind, name, place, feature)
WHERE CASE WHEN feature = 'price_log1p' AND name IN ('B', 'C') THEN NOT high WHEN name = 'correlated' AND feature = 'price_log1p' OR name = 'C' AND feature = 'price' THEN high WHEN name = 'inflated' THEN blown AND NOT high ELSE true END""",
    "time_split_gaps": f"WITH {CY}, gaps AS (SELECT * FROM cy WHERE year NOT IN (1996, 1999, 2000)), {_tvt('gaps', 2, 3)} SELECT custkey, CAST(year AS BIGINT) AS year, round(price, 4) AS price, n_orders, split FROM tvt",
    "time_split_targets": f"""WITH {CY}, own AS (SELECT year FROM cy WHERE year < 2000 AND custkey % 7 <> 0 AND price IS NOT NULL), l AS (SELECT year, year >= (SELECT max(year) FROM own) - 1 AS late FROM own)
SELECT count(*) FILTER (WHERE NOT late) AS n_train, count(*) FILTER (WHERE late) AS n_test, CAST(min(year) FILTER (WHERE NOT late) AS BIGINT) AS train_min, CAST(max(year) FILTER (WHERE NOT late) AS BIGINT) AS train_max,
       (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM l WHERE late)) AS test_times FROM l""",
    "overlap_facts": f"""WITH {CY}, {SHIP}, c AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r FROM (SELECT year FROM cy INTERSECT SELECT year FROM ship)),
l AS (SELECT ship.year, CASE WHEN r = 1 THEN 'test' WHEN r <= 3 THEN 'val' WHEN ship.year < (SELECT min(year) FROM c WHERE r <= 3) THEN 'train' END AS split FROM ship LEFT JOIN c ON ship.year = c.year)
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, CAST(min(year) FILTER (WHERE split = 'train') AS BIGINT) AS train_min, CAST(max(year) FILTER (WHERE split = 'train') AS BIGINT) AS train_max,
       (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM c WHERE r IN (2, 3)) AS val_times, (SELECT CAST(year AS VARCHAR) FROM c WHERE r = 1) AS test_times FROM l""",
    "simple_models": f"WITH {LAG}, {_tvt('lagged', 1, 1)}, {MOMENTS}, " + _results("SELECT 'mean' AS model, 0.0::DOUBLE AS w UNION ALL SELECT 'ols', b FROM st UNION ALL SELECT 'lasso', sign(b) * greatest(abs(b) - 50, 0) FROM st UNION ALL SELECT 'elastic_net', sign(b) * greatest(abs(b) - 0.375, 0) / 2.125 FROM st", "model, 'lag' AS feature_set, CAST(1 AS BIGINT) AS n_features", "'val', 'test'"),
    "two_lines": f"""WITH {FULL}, lagged AS (SELECT * FROM (SELECT full_cy.*, lag(price) OVER w AS x, lag(n_orders) OVER w AS z FROM full_cy WINDOW w AS (PARTITION BY custkey ORDER BY year)) WHERE x IS NOT NULL AND z IS NOT NULL AND price IS NOT NULL), {_tvt('lagged', 1, 1)},
m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(price) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, price) AS xy, covar_pop(z, price) AS zy FROM tvt WHERE split = 'train'),
w AS (SELECT 'mean' AS model, 'one' AS feature_set, 1 AS k, 0.0 AS a, 0.0 AS b FROM m UNION ALL SELECT 'mean', 'two', 2, 0.0, 0.0 FROM m UNION ALL SELECT 'ols', 'one', 1, xy / xx, 0.0 FROM m
  UNION ALL SELECT 'ols', 'two', 2, (xy * zz - zy * xz) / (xx * zz - xz * xz), (zy * xx - xy * xz) / (xx * zz - xz * xz) FROM m),
e AS (SELECT model, feature_set, k, split, price AS y, price - (my + a * (x - mx) + b * (z - mz)) AS e FROM tvt, m, w WHERE split IN ('val', 'test'))
SELECT model, feature_set, CAST(any_value(k) AS BIGINT) AS n_features, split, count(*) AS n, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY model, feature_set, split""",
    "simple_experiment": f"WITH {LAG}, {_tvt('lagged', 1, 2)}, {MOMENTS}, " + _results("SELECT 'mean' AS model, 0.0::DOUBLE AS w UNION ALL SELECT 'ols', b FROM st", "model, 'lag' AS feature_set, CAST(1 AS BIGINT) AS n_features", "'val', 'test'"),
    "simple_tuning": f"WITH {LAG}, {_tvt('lagged', 1, 1)}, {MOMENTS}, " + _results("SELECT variant AS model, b AS w FROM st, (VALUES ('default'), ('tuned')) v(variant)", "'ols' AS model, model AS variant", "'test'"),
    "simple_search": f"""WITH {LAG}, {_tvt('lagged', 1, 1)}, {MOMENTS}, x AS (SELECT custkey % 3 AS fold, lag1 AS x, price AS y FROM tvt WHERE split = 'train'),
alphas AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 10.0), (2, 1000.0)) a(candidate, alpha)), others AS (
  SELECT f.fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS c, count(*) AS n FROM x, (SELECT DISTINCT fold FROM x) f WHERE x.fold <> f.fold GROUP BY f.fold),
fits AS (SELECT others.*, candidate, c * n / (n + alpha) AS w FROM others, alphas),
scores AS (SELECT candidate, x.fold, -sqrt(avg((y - my - w * (x - mx) / sx) ** 2)) AS score FROM x JOIN fits USING (fold) GROUP BY candidate, x.fold), m AS (SELECT candidate, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM scores GROUP BY candidate)
SELECT CAST(candidate AS BIGINT) AS candidate, round(mean_score, 3) AS mean_score, round(std_score, 3) AS std_score, rank() OVER (ORDER BY mean_score DESC) AS rank FROM m""",
    "simple_effects": f"""WITH {LAG}, {_tvt('lagged', 1, 1)}, {MOMENTS}, e AS (SELECT quantile_cont((lag1 - mx) / sx, 0.05) AS low, quantile_cont((lag1 - mx) / sx, 0.95) AS high FROM tvt, st WHERE split = 'test'), g AS (SELECT low + (high - low) * unnest([0, 1, 2, 3, 4]) / 4 AS v FROM e)
SELECT 'price_lag1' AS feature, round(v, 6) AS value, round(my + b * v, 2) AS mean_pred FROM g, st UNION ALL SELECT 'price_lag1 weight', NULL, round(b, 2) FROM st""",
    "prepared_frame": f"""WITH {UD}, t AS (SELECT user_id, day, value, CASE WHEN n_events > 1 THEN 'busy' WHEN user_id % 3 > 0 THEN 'calm' END AS kind, dayofyear(day) < (SELECT max(dayofyear(day)) FROM ud) - 4 AS train FROM ud),
m AS (SELECT median(value) AS med FROM t WHERE train), f AS (SELECT avg(coalesce(value, med)) AS a, stddev_pop(coalesce(value, med)) AS s FROM t, m WHERE train), k AS (SELECT arg_min(kind, (-n, kind)) AS mode FROM (SELECT kind, count(*) AS n FROM t WHERE train AND kind IS NOT NULL GROUP BY kind))
SELECT user_id, CAST(day AS VARCHAR) AS day, round((coalesce(value, med) - a) / s, 6) AS value, CAST(value IS NULL AS INTEGER)::DOUBLE AS value_missing, CAST(coalesce(kind, mode) = 'busy' AS INTEGER)::DOUBLE AS "kind=busy", CAST(coalesce(kind, mode) = 'calm' AS INTEGER)::DOUBLE AS "kind=calm" FROM t, m, f, k""",
    # what the rules choose on these tables: no pair correlates, no column is inflated, the first one left is set C (fixed values)
    "feature_table": "SELECT kind, name, CAST(place AS BIGINT) AS place, feature FROM (VALUES ('set', 'A', 0, 'n_orders'), ('set', 'A', 1, 'acctbal'), ('set', 'A', 2, 'price_lag1'), ('set', 'B', 0, 'n_orders'), ('set', 'B', 1, 'acctbal'), ('set', 'B', 2, 'price_lag1'), ('set', 'C', 0, 'n_orders')) v(kind, name, place, feature)",
    "sorted_results": f"WITH {PRED} SELECT nation, round(sqrt(avg(error * error)), 3) AS rmse, round(avg(abs_error), 3) AS mae, round(1 - sum(error * error) / (var_pop(y_true) * count(*)), 6) AS r2 FROM err GROUP BY nation ORDER BY sqrt(avg(error * error)), avg(abs_error) LIMIT 4",
}

for _name in (
    "missingness_by_time drop_sparse_columns drop_constant_columns drop_missing_target lag_features interpolate fill_both moving_average running_best sequences sequence_delta"
    " group_median_fill global_median_fill impute_panel flags_interactions scaled_sequences standard_scale robust_scale"
).split():
    ORACLE_SQL[_name] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({ORACLE_SQL[_name]})"
