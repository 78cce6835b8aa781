"""A query for each operator, over the given tables or panels derived from them.

Doubles are rounded at the end, so that another engine's order of addition
does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import categories, clean, dedup, explain, features, hot, impute, joins, linear, mlprep, models, reshape, search, selection, splits, stats, trees, windows
from ..operators.schema import standardize_wide
from ..sources import sinks
from ..sources.readers import SourceSpec, load_source, load_standardized, read_csv, read_preamble_csv
from . import pipelines
from .inputs import customer_years, customers, orders_by_year, shipped_years, table, user_days, wide_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles to so many digits, columns named in ``own`` to others; whole numbers of any kind as long, dates as text."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        kind = "long" if t in ("int", "bigint", "smallint") else "string" if t == "date" else None
        out.append(F.round(x, own.get(c, digits)).alias(c) if t in ("double", "float") else x.cast(kind).alias(c) if kind else x)
    return df.select(*out)


# the panel -------------------------------------------------------------------


@query
def panel_region_year(spark, d):
    return rounded(stats.group_mean(customer_years(spark, d), ["region", "year"], "price", "mean_price"))


@query
def missingness_table(spark, d):
    return rounded(stats.missingness(user_days(spark, d), ["user_id", "day", "value", "n_events"]))


@query
def missingness_by_time(spark, d):
    return rounded(stats.missingness_by(user_days(spark, d), "day", "value"))


@query
def missingness_by_entity(spark, d):
    return rounded(stats.missingness_by(user_days(spark, d), "user_id", "value", top=20))


# cleaning --------------------------------------------------------------------


@query
def drop_sparse_columns(spark, d):
    ud = user_days(spark, d).withColumn("rare", F.when(F.col("value") > 1e12, F.col("value")))
    return rounded(clean.drop_sparse_columns(ud, 0.5, ["user_id", "day"])[0])


@query
def drop_constant_columns(spark, d):
    ud = user_days(spark, d).withColumns({"one": F.lit(1), "none": F.lit(None).cast("double")})
    return rounded(clean.drop_constant_columns(ud, ["user_id", "day"])[0])


@query
def bounds_to_null(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clean.apply_bounds(own, "c_acctbal", 0.0, 5000.0).select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))


@query
def bounds_clip(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clean.apply_bounds(own, "c_acctbal", 0.0, 5000.0, clip=True).select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))


@query
def negative_to_null(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("acctbal"))
    return clean.negative_to_null(own, ["acctbal"])


@query
def keyword_clip(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("polio_share"), (F.col("l_extendedprice") / 100).alias("price"))
    return rounded(clean.clip_shares(own, ["polio"], 5.0, 40.0).groupBy("l_linenumber").agg(F.sum("polio_share").alias("shares"), F.min("polio_share").alias("low"), F.max("polio_share").alias("high"), F.sum("price").alias("prices")), 2)


@query
def inspect_outliers(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return clean.outside(own, {"o_totalprice": (2000.0, 400000.0)})


@query
def coverage_filter(spark, d):
    return rounded(clean.entities_with_targets(orders_by_year(spark, d), "custkey", "price", 6))


@query
def min_times_filter(spark, d):
    return rounded(clean.entities_with_times(orders_by_year(spark, d), "custkey", "year", 5))


@query
def drop_missing_target(spark, d):
    return rounded(clean.drop_missing_target(user_days(spark, d), "value"))


@query
def winsorize(spark, d):
    return rounded(clean.winsorize(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 0.01, 0.99))


@query
def log_eps(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    return rounded(clean.log_columns(own, ["acctbal"], 1e-6), 8)


@query
def log1p_features(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"))
    return rounded(features.add_log1p(own, ["acctbal"]), 8)


@query
def numeric_text(spark, d):
    from ..operators.schema import numeric_text as as_numbers

    own = table(spark, d, "customer").select("c_custkey", F.substring("c_name", -3, 3).alias("tail"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(F.lit("n.a.")).alias("mixed"))
    return rounded(as_numbers(own)[0])


@query
def clean_outcome(spark, d):
    cy = orders_by_year(spark, d)
    out, _ = clean.clean_outcome_panel(cy.withColumn("price", F.when(F.col("price") < 250000, F.col("price"))), "price", "custkey", "year", bounds=(20000.0, 220000.0), min_targets=4, max_missing=0.5)
    return rounded(out)


@query
def clean_covariates(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("price"), F.max("l_returnflag").alias("flag"))
    out, _ = clean.clean_covariate_panel(own, ["price", "flag", "absent"], entity="suppkey", time="year", winsorized=["price"], quantiles=(0.05, 0.95), logged=["price"])
    return rounded(out)


@query
def time_range(spark, d):
    """Both ends, and each end open."""
    own = orders_by_year(spark, d)
    parts = [clean.time_range(own, "year", *ends).withColumn("kind", F.lit(kind)) for kind, ends in (("both", (1997, 1999)), ("from", (2000, None)), ("to", (None, 1996)))]
    return rounded(joins.concat(*parts))


@query
def output_summary(spark, d):
    return rounded(stats.output_summary(shipped_years(spark, d), "year"))


# duplicates ------------------------------------------------------------------

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_KEY = ["l_orderkey", "l_linenumber"]


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*_LINE)


@query
def dup_count(spark, d):
    return dedup.shared_key_rows(_lines(spark, d), _KEY)


@query
def dup_rows(spark, d):
    return rounded(dedup.shared_rows(_lines(spark, d), _KEY))


@query
def dedup_first(spark, d):
    return rounded(dedup.deduplicate(_lines(spark, d), _KEY, "keep_first"))


@query
def dedup_last(spark, d):
    return rounded(dedup.deduplicate(_lines(spark, d), _KEY, "keep_last"))


@query
def dedup_drop_all(spark, d):
    return rounded(dedup.deduplicate(_lines(spark, d), _KEY, "drop_all"))


@query
def dedup_mean(spark, d):
    own = _lines(spark, d).withColumn("part", F.col("l_partkey").cast("string")).drop("l_partkey", "l_suppkey")
    return rounded(dedup.deduplicate(own, _KEY, "mean_aggregate", ["l_quantity", "l_extendedprice"]), 6)


# joins -----------------------------------------------------------------------


def _merge(how: str) -> Query:
    def run(spark, d):
        out = joins.merge_panels(customer_years(spark, d).select("custkey", "year", "price", "region"), shipped_years(spark, d), ["custkey", "year"], how)
        return rounded(out, 6)

    run.__name__ = f"panel_merge_{how}"
    return query(run)


panel_merge_inner, panel_merge_left, panel_merge_right, panel_merge_outer = map(_merge, joins.HOW)


@query
def cardinality(spark, d):
    """Orders with their customer: many to one, which is checked in the merge."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice")
    return rounded(joins.merge_panels(o, customers(spark, d).select("custkey", "nation"), ["custkey"], "inner", "many_to_one"))


@query
def metadata_repeated(spark, d):
    """Of a year's orders of a customer the last one by date is its metadata; customers that have none go."""
    o = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("priority"))
    out = joins.attach_nearest(shipped_years(spark, d), o, "custkey", "year", ["priority"], order=["o_orderdate", "o_orderkey"], restrict=True)
    return rounded(out.select("custkey", "year", "quantity", "priority"))


@query
def key_coverage(spark, d):
    return joins.key_coverage(orders_by_year(spark, d), shipped_years(spark, d), ["custkey", "year"])


@query
def keys_lost(spark, d):
    return rounded(joins.keys_lost(orders_by_year(spark, d), shipped_years(spark, d), ["custkey", "year"]))


@query
def semi_restrict(spark, d):
    return rounded(joins.restrict_to(customers(spark, d), shipped_years(spark, d).filter("revenue > 300000"), ["custkey"]))


@query
def metadata_join(spark, d):
    return rounded(joins.attach(shipped_years(spark, d), orders_by_year(spark, d), ["custkey", "year"], ["n_orders"]), 6)


@query
def metadata_carry(spark, d):
    meta = orders_by_year(spark, d).filter("n_orders >= 2")
    return rounded(joins.attach_nearest(shipped_years(spark, d), meta, "custkey", "year", ["n_orders"]), 6)


@query
def metadata_coverage(spark, d):
    carried = joins.attach_nearest(shipped_years(spark, d), orders_by_year(spark, d).filter("n_orders >= 2"), "custkey", "year", ["n_orders"])
    return rounded(joins.coverage(carried, ["n_orders", "revenue"]), 8)


@query
def time_overlap(spark, d):
    return rounded(joins.common_times(orders_by_year(spark, d), shipped_years(spark, d), "year"))


@query
def union_results(spark, d):
    a = stats.by_time(orders_by_year(spark, d), "year", "price").select("year", "n_rows", F.col("mean").alias("price"))
    b = stats.by_time(shipped_years(spark, d), "year", "revenue").select("year", F.col("mean").alias("revenue"))
    return rounded(joins.concat(a, b), 6)


@query
def merge_results(spark, d):
    a = stats.group_mean(customer_years(spark, d), ["region"], "price", "price").drop("n_rows")
    b = stats.group_mean(customers(spark, d), ["region"], "acctbal", "acctbal").drop("n_rows")
    return rounded(joins.merge_results([a, b], ["region"]))


# shapes ----------------------------------------------------------------------


@query
def unpivot_wide(spark, d):
    return rounded(reshape.wide_to_long(wide_events(spark, d), ["user_id", "event_type"], start=2003, end=2020).filter("value IS NOT NULL"))


@query
def pivot_long(spark, d):
    long = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_type", "value", "event_id")
    types = [r[0] for r in long.select("event_type").distinct().orderBy("event_type").collect()]  # names of the new columns
    return rounded(reshape.long_to_wide(long, ["user_id", "day"], "event_type", "value", types, ["event_id"]), 6)


@query
def wide_to_panel(spark, d):
    return rounded(reshape.wide_to_panel(wide_events(spark, d), ["click", "purchase"], "user_id", "event_type", 2002, 2025, "ev_"))


@query
def metric_matrix(spark, d):
    cy = customer_years(spark, d)
    own = stats.group_mean(cy, ["region", "segment"], "price", "price")
    names = [r[0] for r in customers(spark, d).select("segment").distinct().orderBy("segment").collect()]  # names of the new columns
    return rounded(reshape.metric_matrix(own, "region", "segment", "price", names))


def _both(spark, d):
    return joins.merge_panels(orders_by_year(spark, d), shipped_years(spark, d), ["custkey", "year"], "outer")


@query
def target_mean(spark, d):
    return rounded(pipelines.combine_targets(_both(spark, d).select("custkey", "year", "price", "revenue"), ["price", "revenue"], "target"), 6)


@query
def target_first(spark, d):
    return rounded(pipelines.combine_targets(_both(spark, d).select("custkey", "year", "price", "revenue"), ["price", "revenue"], "target", "first_non_null"), 6)


# statistics ------------------------------------------------------------------


@query
def describe(spark, d):
    return rounded(stats.describe(table(spark, d, "orders"), ["o_totalprice", "o_custkey"]))


@query
def describe_by_group(spark, d):
    return rounded(stats.describe(customer_years(spark, d), ["price"], ["region"]))


@query
def skew_kurt(spark, d):
    return rounded(stats.shape(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"]), 6)


@query
def yearly_stats(spark, d):
    return rounded(stats.by_time(orders_by_year(spark, d), "year", "price"), 2)


@query
def iqr_band(spark, d):
    return rounded(stats.quartile_band(customer_years(spark, d), ["region", "year"], "price"))


@query
def box_stats(spark, d):
    return rounded(stats.box_stats(customer_years(spark, d), "segment", "price"), 6)


@query
def histogram(spark, d):
    return rounded(stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 25), 2)


@query
def top_groups(spark, d):
    return rounded(stats.top_groups(customer_years(spark, d), "nation", 6))


@query
def in_top_groups(spark, d):
    return rounded(stats.in_top_groups(customer_years(spark, d), "nation", 3))


@query
def entity_ranking(spark, d):
    return rounded(stats.ranking(customer_years(spark, d), "nation", "price", 5))


@query
def argmin_per_group(spark, d):
    return rounded(stats.best_per_group(customer_years(spark, d).select("region", "custkey", "year", "price"), ["region"], "price", ["custkey", "year"]))


@query
def mean_and_std(spark, d):
    return rounded(stats.mean_and_std(customer_years(spark, d), ["segment"], "price"))


@query
def distinct_counts(spark, d):
    return stats.distinct_counts(customer_years(spark, d), {"entities": ["custkey"], "keys": ["custkey", "year"], "nations": ["nation"]})


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def corr_matrix(spark, d):
    return rounded(stats.correlation_matrix(table(spark, d, "lineitem"), _NUMBERS), 8)


@query
def high_corr_pairs(spark, d):
    return rounded(stats.high_pairs(table(spark, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax"))), [*_NUMBERS, "gross"], 0.5), 8)


@query
def corr_with_target(spark, d):
    return rounded(stats.correlation_with(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 8)


@query
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 8)


@query
def vif_table(spark, d):
    return rounded(stats.vif_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


# selection -------------------------------------------------------------------


def _features(spark, d):
    cy = customer_years(spark, d).withColumns({"double_price": F.col("price") * 2, "one": F.lit(1.0), "status": F.col("segment")})
    return features.model_frame(cy, "n_orders", leakage=["acctbal"], log1p=["price"], missing=["price"], keep=["custkey", "year"])


@query
def model_frame(spark, d):
    return rounded(_features(spark, d))


@query
def feature_sets_abc(spark, d):
    return rounded(selection.feature_sets(_features(spark, d), "n_orders", ["custkey", "year"], ["price_log1p"], least=1, most=3)[1])


@query
def vif_prune(spark, d):
    own = table(spark, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    cols = ["l_quantity", "twice"]
    parts = []
    for kind, protected in (("none", []), ("one", ["twice"]), ("both", cols)):
        kept, _ = selection.prune_vif(own, cols, 10.0, protected)
        parts += [(kind, c, c in kept) for c in cols]
    return spark.createDataFrame(parts, "protected string, feature string, kept boolean")


@query
def corr_prune_protected(spark, d):
    cols = [*_NUMBERS, "twice"]
    kept, gone = selection.prune_correlated(table(spark, d, "lineitem").withColumn("twice", F.col("l_tax") * 2), cols, 0.9, ["twice"])
    return spark.createDataFrame([(c, c in kept) for c in cols], "feature string, kept boolean")


@query
def corr_prune(spark, d):
    cols = [*_NUMBERS, "twice"]
    kept, gone = selection.prune_correlated(table(spark, d, "lineitem").withColumn("twice", F.col("l_tax") * 2), cols, 0.9)
    return spark.createDataFrame([(c, c in kept) for c in cols], "feature string, kept boolean")


# order -----------------------------------------------------------------------


@query
def lag_features(spark, d):
    return rounded(windows.lag_features(user_days(spark, d), "user_id", "day", ["value", "n_events"], [1, 2]), 6)


@query
def rolling_mean(spark, d):
    out = windows.lag_features(orders_by_year(spark, d), "custkey", "year", ["price"], [1], ["price"], [3], drop_incomplete=True)
    return rounded(out)


@query
def interpolate(spark, d):
    return rounded(windows.interpolate(user_days(spark, d), "user_id", "day", ["value"], 2), 8)


def _kinds(spark, d):
    """Few entities with many rows: mean value by kind of event and time, a third of them unknown; and where they are cut."""
    e = table(spark, d, "events").groupBy("event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("second")).agg(F.avg("value").alias("value"), F.max("event_id").alias("event_id"))
    own = sinks.kept(e.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))), "kinds")
    return own, hot.hot_entities(own, "event_type", "second", rows=500)


@query
def hot_lags(spark, d):
    """Lags and rolling means of entities that are cut into ranges of time."""
    own, cut = _kinds(spark, d)
    return rounded(windows.lag_features(own, "event_type", "second", ["value"], [1, 4], ["value"], [3], hot=cut), 6)


@query
def hot_interpolate(spark, d):
    own, cut = _kinds(spark, d)
    return rounded(windows.interpolate(own, "event_type", "second", ["value"], 2, hot=cut), 6)


@query
def hot_fill(spark, d):
    own, cut = _kinds(spark, d)
    return rounded(windows.fill_both_ways(own, "event_type", "second", ["value"], hot=cut), 6)


@query
def hot_sequences(spark, d):
    own, cut = _kinds(spark, d)
    out = windows.sequences(own, "event_type", "second", ["value"], "value", 2, hot=cut)
    return rounded(out.select("event_type", "second", F.col("value").alias("target"), *(F.col("sequence")[i][0].alias(f"value_{i}") for i in range(2))), 6)


@query
def fill_both(spark, d):
    return rounded(windows.fill_both_ways(user_days(spark, d), "user_id", "day", ["value"]), 6)


@query
def moving_average(spark, d):
    yearly = stats.by_time(user_days(spark, d), "day", "value").select("day", "mean")
    return rounded(windows.moving_average(yearly, "day", "mean", 5), 6)


@query
def running_best(spark, d):
    daily = stats.by_time(user_days(spark, d), "day", "value").select("day", "mean")
    return rounded(windows.running_best(daily, "day", "mean"), 6)


@query
def rank_table(spark, d):
    own = stats.group_mean(customers(spark, d), ["nation"], "acctbal", "score").withColumn("score", F.round("score", -2))
    return rounded(windows.rank_results(own, "score"))


@query
def sequences(spark, d):
    out = windows.sequences(user_days(spark, d), "user_id", "day", ["value", "n_events"], "value", 3)
    steps = [F.element_at(F.element_at("sequence", i + 1), j + 1).alias(f"{n}_{i}") for i in range(3) for j, n in enumerate(("value", "n"))]
    return rounded(out.select("user_id", "day", F.col("value").alias("target"), *steps), 6)


@query
def sequence_delta(spark, d):
    out = windows.sequence_delta(windows.sequences(user_days(spark, d), "user_id", "day", ["value"], "value", 2), "value", 0)
    return rounded(out.select("user_id", "day", "value", "last_target", "delta"), 6)


@query
def group_median_fill(spark, d):
    return rounded(impute.fill_group_median(user_days(spark, d), ["user_id"], ["value"]), 6)


@query
def global_median_fill(spark, d):
    return rounded(impute.fill_global_median(user_days(spark, d), ["value", "n_events"]), 6)


def _imputed(spark, d):
    return impute.impute_panel(user_days(spark, d), "user_id", "day", interpolated=["value"], limit=1, group_by=["user_id"], group_cols=["value"], median_cols=["n_events"])


@query
def impute_panel(spark, d):
    return rounded(_imputed(spark, d)[0], 8)


@query
def impute_counts(spark, d):
    return _imputed(spark, d)[1]


@query
def flags_interactions(spark, d):
    ud = user_days(spark, d)
    out = features.add_interactions(features.add_missing_flags(ud, ["value"]), [("value", "n_events")])
    return rounded(out.select("user_id", "day", "value_missing", "value__x__n_events"), 6)


@query
def status_flag(spark, d):
    own = customers(spark, d).select("custkey", "segment")
    return rounded(features.add_status_flag(own, "segment", "build").drop("segment"))


# splits ----------------------------------------------------------------------


@query
def time_split(spark, d):
    return rounded(splits.time_split(orders_by_year(spark, d), "year", 2)[0])


@query
def time_train_val_test(spark, d):
    return rounded(splits.train_val_test(orders_by_year(spark, d), "year", 2, 2)[0])


def _gaps(spark, d):
    """The panel without some years, so that times are not next to each other."""
    return orders_by_year(spark, d).filter("year NOT IN (1996, 1999, 2000)")


@query
def time_split_gaps(spark, d):
    return rounded(splits.train_val_test(_gaps(spark, d), "year", 2, 3)[0])


@query
def time_split_targets(spark, d):
    """Rows without a target go before the split; and the split's facts."""
    own = orders_by_year(spark, d).withColumn("price", F.when((F.col("year") < 2000) & (F.col("custkey") % 7 != 0), F.col("price")))
    out = splits.split_facts(splits.time_split(own, "year", 2, "price")[0], "year")
    return rounded(out.select("n_train", "n_test", "train_min", "train_max", F.concat_ws(",", F.transform("test_times", lambda t: t.cast("string"))).alias("test_times")))


@query
def overlap_facts(spark, d):
    facts = splits.overlap_split(shipped_years(spark, d), orders_by_year(spark, d), "year", 2, 1)[1]
    return rounded(facts.withColumns({c: F.concat_ws(",", F.transform(c, lambda t: t.cast("string"))) for c in ("val_times", "test_times")}))


@query
def overlap_split(spark, d):
    return rounded(splits.overlap_split(shipped_years(spark, d), orders_by_year(spark, d), "year")[0], 6)


@query
def time_folds(spark, d):
    return rounded(splits.time_folds(orders_by_year(spark, d), "year", 3))


@query
def contiguous_folds(spark, d):
    return rounded(splits.contiguous_folds(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5))


@query
def split_summary(spark, d):
    return rounded(splits.split_summary(splits.train_val_test(orders_by_year(spark, d), "year", 2, 2)[0], "year"))


@query
def random_split(spark, d):
    return splits.random_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


# models ----------------------------------------------------------------------


def _labelled(spark, d):
    """Lags of the customer-year panel, labelled by time."""
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price", "n_orders"], [1], drop_incomplete=True)
    return splits.train_val_test(own, "year", 1, 1)[0]


_INPUTS = ["price_lag1", "n_orders_lag1", "acctbal"]


def _one_lag(spark, d):
    """The customer-year panel with last year's price, labelled by time."""
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price"], [1], drop_incomplete=True)
    return splits.train_val_test(own, "year", 1, 1)[0]


@query
def simple_models(spark, d):
    """The mean, least squares, and lasso and elastic net with a given penalty, of one column: all have closed forms."""
    options = {"lasso": {"alpha": 50.0}, "elastic_net": {"alpha": 1.5, "l1_ratio": 0.25}}
    return rounded(models.compare(_one_lag(spark, d), ["mean", "ols", "lasso", "elastic_net"], {"lag": ["price_lag1"]}, "price", ["custkey", "year"], options, ["val", "test"]), 3, r2=6)


@query
def two_lines(spark, d):
    """The mean and least squares on one and on two columns, from one Gramian and one aggregate."""
    sets = {"one": _INPUTS[:1], "two": _INPUTS[:2]}
    return rounded(models.compare(_labelled(spark, d), ["mean", "ols"], sets, "price", ["custkey", "year"], on=["val", "test"]), 3, r2=6)


@query
def simple_experiment(spark, d):
    """The lifecycle over time with given sets and models of closed form."""
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price"], [1], drop_incomplete=True)
    return rounded(pipelines.time_experiment(own, "price", ["custkey", "year"], "year", ["mean", "ols"], 2, 1, {"lag": ["price_lag1"]})[2], 3, r2=6)


@query
def simple_search(spark, d):
    """Penalties of a ridge of one column over folds by customer, each score in closed form."""
    own = _one_lag(spark, d)
    table_ = search.search(own, "ridge", [{"alphas": a} for a in (0.1, 10.0, 1000.0)], ["price_lag1"], "price", ["custkey", "year"], F.pmod("custkey", F.lit(3)), 3)
    return rounded(table_.select("candidate", "mean_score", "std_score", "rank"), 3)


@query
def simple_tuning(spark, d):
    """Test errors of the default and the chosen least squares."""
    own = _one_lag(spark, d)
    variants = search.tune(own, "ols", [{}], ["price_lag1"], "price", ["custkey", "year"], F.pmod("custkey", F.lit(3)), 3)[2]
    return rounded(variants, 3, r2=6)


@query
def shuffled_folds(spark, d):
    """Shuffled folds of equal sizes."""
    return rounded(splits.equal_folds(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7))


@query
def permuted_line(spark, d):
    """How much a given line's error grows when a column is dealt anew over all rows."""
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price"], [1], drop_incomplete=True)
    line = linear.Linear(1000.0, {"price_lag1": 0.8, "n_orders": 5000.0})
    return rounded(explain.permutation_importance(line, own, ["price_lag1", "n_orders"], "price", ["custkey", "year"], repeats=3, seed=7))


@query
def simple_effects(spark, d):
    """Partial dependence and standardised coefficient of a least squares line."""
    own = _one_lag(spark, d)
    fitted = models.train(own, "ols", ["price_lag1"], "price", ["custkey", "year"])
    test = fitted.prep.apply(own.filter("split = 'test'"), ["custkey", "year", "price"])
    effect = explain.partial_dependence(fitted.model, test, "price_lag1", ["price_lag1"], 5).select("feature", "value", "mean_pred")
    weight = explain.importance_table(own, {"ols": fitted.model}).select(F.concat("feature", F.lit(" weight")).alias("feature"), F.lit(None).cast("double").alias("value"), F.col("ols").alias("mean_pred"))
    return rounded(effect.unionByName(weight), 2, value=6)


@query
def prepared_frame(spark, d):
    """Numbers and categories of one table together: medians, flags, scales, modes and one column a category."""
    ud = user_days(spark, d).withColumns({"no": F.dayofyear("day"), "kind": F.when(F.col("n_events") > 1, "busy").when(F.col("user_id") % 3 > 0, "calm")})
    labelled = splits.time_split(ud, "no", 5)[0]
    prep = mlprep.prepare(labelled.filter("split = 'train'"), ["value"], ["kind"], indicators=True)
    return rounded(prep.apply(labelled, ["user_id", "day"]), 6)


@query
def sorted_results(spark, d):
    """The best four of a table of results."""
    own = stats.regression_metrics(_predicted(spark, d), by=["nation"])
    return rounded(stats.sort_results(own.select("nation", "rmse", "mae", "r2")).limit(4), 3, r2=6)


@query
def standard_scale(spark, d):
    ud = splits.time_split(user_days(spark, d).withColumn("no", F.dayofyear("day")), "no", 5)[0]
    prep = mlprep.prepare(ud.filter("split = 'train'"), ["value", "n_events"], indicators=True)
    return rounded(prep.apply(ud, ["user_id", "day"]), 6)


@query
def robust_scale(spark, d):
    ud = splits.time_split(user_days(spark, d).withColumn("no", F.dayofyear("day")), "no", 5)[0]
    prep = mlprep.prepare(ud.filter("split = 'train'"), ["value"], scale="robust")
    return rounded(prep.apply(ud, ["user_id", "day"]), 6)


@query
def mode_onehot(spark, d):
    own = customers(spark, d).withColumn("place", F.when(F.col("custkey") % 5 != 0, F.col("region")))
    prep = mlprep.prepare(own.filter("custkey % 3 <> 0"), [], ["place"])
    return rounded(prep.apply(own, ["custkey"]))


@query
def sparse_categories(spark, d):
    """Categories of two columns, one of them as wide as there are parts, as places in a sparse vector; lines of some suppliers are new."""
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("part"), "l_returnflag")
    found = categories.category_dictionary(own.filter("l_suppkey % 4 <> 0"), ["l_returnflag", "part"])
    return rounded(found.look_up(own).select("l_orderkey", "l_linenumber", F.col("l_suppkey"), F.array_join("codes", ",").alias("codes"), F.lit(found.size).alias("size")))


@query
def category_effects(spark, d):
    """Price by quantity with an effect of each part: fixed effects, and all weights penalised."""
    models_ = categories.fit_absorbed(table(spark, d, "lineitem"), ["l_quantity"], "l_partkey", "l_extendedprice", [0.0, 2.0])
    out = None
    for alpha, m in models_.items():
        line = spark.createDataFrame([("intercept", 0, m.intercept), ("slope", 0, m.coef["l_quantity"])], "value string, n long, effect double")
        own = m.effects.unionByName(line).select(F.lit(alpha).alias("alpha"), F.col("value").alias("term"), "n", F.col("effect").alias("weight"))
        out = own if out is None else out.unionByName(own)
    return rounded(out, 3)


@query
def ols_simple(spark, d):
    """With one column, and with two."""
    own, rows = table(spark, d, "lineitem"), []
    for cols in (["l_quantity"], ["l_quantity", "l_tax"]):
        m = linear.fit_ols(own, cols, "l_extendedprice")
        rows += [(len(cols), "intercept", m.intercept), *((len(cols), c, m.coef[c]) for c in cols)]
    return rounded(spark.createDataFrame(rows, "n_columns int, term string, weight double"), 2)


@query
def ridge_path(spark, d):
    """With one column the slope and mean score by penalty, and the weights of two columns."""
    own = table(spark, d, "lineitem")
    parts = linear.fold_gramians(own, ["l_quantity"], "l_extendedprice", F.col("l_linenumber") % 3)
    two = linear.fold_gramians(own, ["l_quantity", "l_tax"], "l_extendedprice")[0]
    total, rows = sum(parts.values()), []
    for a, s in linear.ridge_scores(parts).items():
        both = linear.solve_ridge(two, a)[0]
        rows.append((a, float(linear.solve_ridge(total, a)[0][0]), float(sum(s) / len(s)), float(both[0]), float(both[1])))
    return rounded(spark.createDataFrame(rows, "alpha double, slope double, mean_r2 double, two_quantity double, two_tax double"), 6, two_quantity=3, two_tax=3)


def _predicted(spark, d):
    """The mean of the training years as prediction for the last ones."""
    own = splits.time_split(customer_years(spark, d), "year", 2)[0]
    m = linear.fit_mean(own.filter("split = 'train'"), "price")
    return stats.with_errors(m.predict(own.filter("split = 'test'")).withColumnRenamed("price", "y_true"))


@query
def regression_metrics(spark, d):
    return rounded(stats.regression_metrics(_predicted(spark, d)), 6)


@query
def error_by_group(spark, d):
    return rounded(stats.error_by(_predicted(spark, d), "region"))


@query
def error_by_time(spark, d):
    return rounded(stats.error_by(_predicted(spark, d), "year", by_order=True))


@query
def error_by_entity(spark, d):
    return rounded(stats.mae_by_entity(_predicted(spark, d), "nation", 10))


@query
def worst_errors(spark, d):
    return rounded(stats.worst_errors(_predicted(spark, d), 20, ["custkey", "year"]))


@query
def lasso_elasticnet(spark, d):
    return rounded(models.compare(_labelled(spark, d), ["lasso", "elastic_net"], {"lags": _INPUTS}, "price", ["custkey", "year"], on=["val", "test"]))


@query
def model_compare(spark, d):
    sets = {"lags": _INPUTS[:2], "all": _INPUTS}
    return rounded(models.compare(_labelled(spark, d), ["mean", "ols", "ridge"], sets, "price", ["custkey", "year"], on=["val", "test"]))


@query
def forest(spark, d):
    fitted = models.train(_labelled(spark, d), "forest", _INPUTS, "price", ["custkey", "year"], trees=20, depth=6)
    return rounded(models.evaluate(fitted.predict(_labelled(spark, d), "price", ["custkey", "year"]), {"model": "forest"}))


@query
def gbt_early_stop(spark, d):
    fitted = models.train(_labelled(spark, d), "gbt", _INPUTS, "price", ["custkey", "year"], iterations=10, depth=3)
    return rounded(models.evaluate(fitted.predict(_labelled(spark, d), "price", ["custkey", "year"]), {"model": "gbt", "best_iteration": fitted.model.info["best_iteration"]}))


@query
def search_table(spark, d):
    own = _labelled(spark, d)
    return rounded(search.search(own, "ridge", [{"alphas": a} for a in linear.RIDGE_ALPHAS], _INPUTS, "price", ["custkey", "year"], splits.hash_fold(["custkey", "year"], 3), 3))


def _ridge(spark, d):
    own = _labelled(spark, d)
    fitted = models.train(own, "ridge", _INPUTS, "price", ["custkey", "year"])
    return fitted, fitted.prep.apply(own.filter("split = 'test'"), ["custkey", "year", "price"])


@query
def permutation_importance(spark, d):
    fitted, test = _ridge(spark, d)
    return rounded(explain.permutation_importance(fitted.model, test, _INPUTS, "price", ["custkey", "year"], 3), 6)


@query
def linear_shap(spark, d):
    own, cols = table(spark, d, "lineitem"), ["l_quantity", "l_tax"]
    return rounded(explain.linear_shap(linear.fit_ols(own, cols, "l_extendedprice"), own, cols), 2)


@query
def sampled_shap(spark, d):
    fitted, test = _ridge(spark, d)
    return rounded(explain.sampled_shap(fitted.model, test, _INPUTS, ["custkey", "year"], rows=100, permutations=4), 6)


@query
def tree_shap(spark, d):
    labelled = _labelled(spark, d)
    fitted = models.train(labelled, "gbt", _INPUTS, "price", ["custkey", "year"], iterations=10, depth=3)
    return rounded(trees.tree_shap(fitted.model, fitted.prep.apply(labelled.filter("split = 'test'"), ["custkey", "year"])), 6)


@query
def partial_dependence(spark, d):
    fitted, test = _ridge(spark, d)
    return rounded(explain.partial_dependence(fitted.model, test, "price_lag1", _INPUTS, 10), 6)


@query
def importance_table(spark, d):
    own = _labelled(spark, d)
    fitted = {n: models.train(own, n, _INPUTS, "price", ["custkey", "year"]).model for n in ("ols", "ridge", "lasso")}
    return rounded(explain.importance_table(own, fitted))


@query
def seed_stability(spark, d):
    return rounded(pipelines.seed_stability(_labelled(spark, d), "forest", _INPUTS, "price", ["custkey", "year"], [1, 2], trees=5, depth=4))


@query
def tuned_variants(spark, d):
    own = _labelled(spark, d)
    return rounded(search.tune(own, "ridge", search.draw("ridge", 5), _INPUTS, "price", ["custkey", "year"], splits.hash_fold(["custkey", "year"], 3), 3)[2])


@query
def scaled_sequences(spark, d):
    own = windows.sequences(user_days(spark, d), "user_id", "day", ["value", "n_events"], "value", 2)
    labelled = splits.label_last_times(own, "day", 3, 3)
    out = mlprep.scale_sequences(labelled, 2)
    steps = [F.element_at(F.element_at("sequence", i + 1), j + 1).alias(f"{n}_{i}") for i in range(2) for j, n in enumerate(("value", "n"))]
    return rounded(out.select("user_id", "day", "split", *steps), 6)


@query
def metric_gap(spark, d):
    """Errors of the mean under a random split and under a split by time, side by side by region."""
    cy = customer_years(spark, d)
    labels = {"odd": cy.withColumn("split", F.when(F.col("custkey") % 5 == 0, "test").otherwise("train")), "time": splits.time_split(cy, "year", 2)[0]}
    parts = []
    for name, own in labels.items():
        m = linear.fit_mean(own.filter("split = 'train'"), "price")
        test = m.predict(own.filter("split = 'test'")).withColumnRenamed("price", "y_true")
        parts.append(stats.regression_metrics(test, by=["region"]).withColumn("kind", F.lit(name)))
    return rounded(joins.metric_gap(joins.concat(*parts), ["region"], "kind", "odd", "time", ["rmse", "mae"]))


@query
def standardize_source(spark, d):
    """Raw names and texts of a source brought to the panel's: trimmed keys, numbers, years."""
    from ..operators.schema import standardize_panel

    raw = table(spark, d, "orders").select(
        F.concat(F.lit("  "), "o_orderstatus", F.lit("\t")).alias("Order Status"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.year("o_orderdate").cast("string")).alias("Year"), F.col("o_totalprice").cast("string").alias("Total Price %"), F.col("o_orderkey").alias("A/B-C")
    )
    return rounded(standardize_panel(raw, "Order Status", "Year", {"total_price_percent": "price"}, entity="status"))


# whole lifecycles ------------------------------------------------------------


@query
def time_experiment(spark, d):
    """Feature sets on training rows, a split by time, models on every set."""
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price", "n_orders"], [1], drop_incomplete=True).withColumn("twice", F.col("price_lag1") * 2)
    return rounded(pipelines.time_experiment(own, "price", ["custkey", "year"], "year", ["mean", "ridge"], 1, priority=["acctbal"])[2])


@query
def feature_table(spark, d):
    own = windows.lag_features(customer_years(spark, d), "custkey", "year", ["price"], [1], drop_incomplete=True)
    return rounded(pipelines.time_experiment(own, "price", ["custkey", "year"], "year", ["mean"], 1)[1])


@query
def preprocess_panel(spark, d):
    """Both sources cleaned, merged, given one outcome and imputed."""
    outcome = orders_by_year(spark, d).select("custkey", "year", F.when(F.col("n_orders") > 1, F.col("price")).alias("price"))
    options = pipelines.PanelOptions(
        "custkey", "year", ("price", "revenue"), "outcome", outcome={"bounds": (0.0, 1e7), "min_targets": 2}, covariates={"winsorized": ["revenue"], "logged": ["revenue"]}, impute={"interpolated": ["quantity"], "median_cols": ["log_revenue"]}
    )
    return rounded(pipelines.build_panel(outcome, shipped_years(spark, d), options)[0], 6)


@query
def indicator_experiment(spark, d):
    """Wide events pivoted, lagged, split on common days and modelled against the panel of user days."""
    panel = user_days(spark, d).select("user_id", (F.dayofmonth("day") + 2000).cast("long").alias("year"), "value").filter("value IS NOT NULL").dropDuplicates(["user_id", "year"])
    results = pipelines.indicator_experiment(panel, wide_events(spark, d).withColumnRenamed("event_type", "indicator_code"), ["click", "purchase"], "value", ["mean", "ridge"], entity="user_id")[1]
    return rounded(results)


# sources and sinks -----------------------------------------------------------


@query
def load_parquet_source(spark, d):
    own = load_source(spark, SourceSpec(f"{d}/customer.parquet", "parquet"))
    return rounded(own.select("c_custkey", F.upper(fx.trimmed("c_mktsegment")).alias("segment"), "c_nationkey"))


@query
def csv_source(spark, d):
    """A table written as CSV and read back: all columns are texts, words for missing values are NULL, cells hold line breaks, commas and quotes."""
    path = sinks.scratch_path(spark, "csv")
    note = F.concat(F.lit('"'), F.substring("c_mktsegment", 1, 4), F.lit('", first\n'), "c_name", F.lit("\n\n, last"))
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("N/A")).otherwise(F.col("c_mktsegment")).alias("segment"), "c_acctbal", note.alias("note"))
    sinks.write_table(own, path, "csv")
    back = read_csv(spark, path)
    return rounded(back.select(fx.number("c_custkey").cast("long").alias("custkey"), "segment", fx.number("c_acctbal").alias("acctbal"), "note"))


@query
def preamble_source(spark, d):
    """Yearly orders by nation as a file wide by year, behind four lines of preamble, brought to one row a nation and year."""
    cy = customer_years(spark, d)
    years = list(range(1990, 2003))
    wide = cy.groupBy("nation").pivot("year", years).agg(F.sum("n_orders"))
    header = ["Country Name", "Country Code", "Indicator Name", "Indicator Code", *map(str, years), ""]
    first = ["Data Source,Orders", "", "Last Updated,2020", "", ",".join(f'"{h}"' for h in header)]
    row = F.concat_ws(",", F.concat(F.lit('" '), "nation", F.lit('"')), F.upper(F.substring("nation", 1, 3)), F.lit('"Orders,\n""all"""'), F.lit("N.ORD"), *(F.coalesce(F.col(str(y)).cast("string"), F.lit("..")) for y in years), F.lit(""))
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(first)], "no int, value string").unionByName(wide.select(F.lit(len(first)).alias("no"), row.alias("value")))
    path = sinks.scratch_path(spark, "preamble")
    lines.orderBy("no", "value").coalesce(1).select("value").write.text(path)  # a row a nation
    own = standardize_wide(read_preamble_csv(spark, path))
    return rounded(reshape.wide_to_long(own, ["country", "country_code", "indicator_code"]).filter("value IS NOT NULL"))


@query
def table_sinks(spark, d):
    """One panel as Parquet by year and as CSV, both read back."""
    own, parts = orders_by_year(spark, d), []
    for fmt in ("parquet", "csv"):
        path = sinks.scratch_path(spark, "sink")
        sinks.write_table(own, path, fmt, ("year",) if fmt == "parquet" else ())
        back = spark.read.parquet(path) if fmt == "parquet" else read_csv(spark, path)
        parts.append(back.groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_orders").cast("long")).alias("n_orders")).withColumn("fmt", F.lit(fmt)))
    return rounded(joins.concat(*parts))


@query
def json_summary(spark, d):
    path = sinks.scratch_path(spark, "json")
    sinks.write_summary(spark, stats.output_summary(orders_by_year(spark, d), "year"), path)
    return rounded(spark.read.json(path))


@query
def run_log(spark, d):
    """Result rows of three runs; the second brings a column, which the others lack."""
    path, cy = sinks.scratch_path(spark, "runs"), customer_years(spark, d)
    runs = [stats.group_mean(cy, ["region"], "price", "mean_price"), stats.group_mean(cy, ["region"], "price", "mean_price").withColumn("run", F.lit("second")), stats.group_mean(cy.filter("year >= 1998"), ["region"], "price", "mean_price")]
    for r in runs:
        sinks.append_run(r, path)
    return rounded(sinks.read_runs(spark, path).select("region", "mean_price", "n_rows", "run"))


@query
def load_or_build(spark, d):
    """What the first call builds is what the second one reads."""
    path, own = sinks.scratch_path(spark, "panel"), orders_by_year(spark, d)
    sinks.load_or_build(spark, path, lambda: own.filter("n_orders > 1"))
    return rounded(sinks.load_or_build(spark, path, lambda: own))


@query
def standardized_sources(spark, d):
    """Two sources read and brought to the panel's names, with their numbers of rows and columns."""
    specs = {}
    for name, own, keys in (("orders", orders_by_year(spark, d), ("custkey", "year")), ("shipped", shipped_years(spark, d), ("custkey", "year"))):
        path = sinks.scratch_path(spark, name)
        sinks.write_table(own, path, "csv")
        specs[name] = SourceSpec(path, "csv", *keys)
    return rounded(load_standardized(spark, specs)[1])
