"""Tables of statistics. Each is one or two aggregates over all columns, never a job for each number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, half_even
from .impute import fill_global_median
from .quantiles import exact_quantiles, grouped_quantiles, same_keys
from .schema import quoted


def _stacked(row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "feature") -> DataFrame:
    """A row for each name from one row with columns ``name no. x field no.``."""
    structs = F.array(*(F.struct(F.lit(n).alias(key), *(F.col(f"{i}_{f}").alias(f) for f in fields)) for i, n in enumerate(names)))
    return row.select(F.inline(structs))


def missing_fractions(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Share of NULLs by column; 0 without rows. One pass."""
    if not cols:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols))).first()
    return {c: (row["n"] - row[f"c{i}"]) / row["n"] if row["n"] else 0.0 for i, c in enumerate(cols)}


def missingness(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """``feature, missing_fraction, missing_count, non_missing_count``, most missing first."""
    cols = list(cols or df.columns)
    row = df.agg(*(x for i, c in enumerate(cols) for x in (F.count(F.lit(1)).alias(f"{i}_n"), F.count(quoted(c)).alias(f"{i}_non_missing_count"))))
    long = _stacked(row, cols, ["n", "non_missing_count"])
    missing = F.col("n") - F.col("non_missing_count")
    return long.select("feature", half_even(F.try_divide(missing, "n"), digits).alias("missing_fraction"), missing.alias("missing_count"), "non_missing_count").orderBy(F.desc("missing_fraction"), "feature")


def missingness_by(df: DataFrame, key: str, col: str, top: int | None = None, digits: int = 4) -> DataFrame:
    """Rows, missing count and share by a key: by time in its order, or the ``top`` worst entities."""
    out = df.filter(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(quoted(col).isNull()).alias("missing_count"), half_even(F.avg(quoted(col).isNull().cast("double")), digits).alias("missing_fraction"))
    return out.orderBy(quoted(key)) if top is None else out.orderBy(F.desc("missing_fraction"), quoted(key)).limit(top)


def output_summary(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("output_rows"), F.min(quoted(time)).alias("min_time"), F.max(quoted(time)).alias("max_time")).withColumn("output_cols", F.lit(len(df.columns)))


_DESCRIBED = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def _described(c: Column, q: Sequence[Column]) -> list[Column]:
    return [F.count(c), F.avg(c), F.stddev(c), F.min(c), *q, F.max(c)]


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum; a row a column, and a group.

    Quartiles are exact, of whole columns and of groups (see ``quantiles``).
    """
    shares = (0.25, 0.5, 0.75)
    known = {c: quoted(c).cast("double") for c in cols}
    whole = {} if by else exact_quantiles(df, known, shares)
    names = [n for n in _DESCRIBED if not (by and n in ("q25", "q50", "q75"))]
    aggs = []
    for i, (c, x) in enumerate(known.items()):
        q = [] if by else [F.lit(v).cast("double") for v in whole[c]]
        aggs += [v.alias(f"{i}_{n}") for v, n in zip(_described(x, q), names, strict=True)]
    row = df.groupBy(*map(quoted, by)).agg(*aggs)
    if by:
        row = _with_quantiles(row, df, by, {str(i): x for i, x in enumerate(known.values())}, shares, ["q25", "q50", "q75"])
    structs = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{i}_{n}").alias(n) for n in _DESCRIBED)) for i, c in enumerate(cols)))
    return row.select(*map(quoted, by), F.inline(structs))


def _with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], values: Mapping[str, Column], shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Adds to a table of groups the quantiles of each, as ``value_name``, or ``name`` where the value is called ''."""
    found = grouped_quantiles(df, by, values, shares)
    keys = [f"_by{i}" for i in range(len(by))]
    new = [f"{v}_{n}" if v else n for v in values for n in names]
    found = found.toDF(*keys, *new)
    return groups.join(found, same_keys(groups, found, by, keys)).drop(*keys)


def distinct_counts(df: DataFrame, counted: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: for each name, how many different known values its columns have together."""
    return df.agg(*(F.count_distinct(*map(quoted, cols)).alias(name) for name, cols in counted.items()))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1; NULL below 3 values."""
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2; NULL below 4 values."""
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*(x for i, c in enumerate(cols) for x in (sample_skewness(quoted(c)).alias(f"{i}_skewness"), sample_kurtosis(quoted(c)).alias(f"{i}_kurtosis"))))
    return _stacked(row, cols, ["skewness", "kurtosis"])


def by_time(df: DataFrame, time: str, col: str) -> DataFrame:
    c = quoted(col)
    groups = df.groupBy(quoted(time)).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"))
    return _with_quantiles(groups, df, [time], {"": c}, (0.5,), ["median"]).select(quoted(time), "n_rows", "mean", "median", "variance").orderBy(quoted(time))


def group_mean(df: DataFrame, by: Sequence[str], col: str, alias: str | None = None) -> DataFrame:
    return df.groupBy(*map(quoted, by)).agg(F.avg(quoted(col)).alias(alias or f"mean_{col}"), F.count(F.lit(1)).alias("n_rows"))


def quartile_band(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    groups = df.groupBy(*map(quoted, by)).agg(F.count(F.lit(1)).alias("size"))
    return _with_quantiles(groups, df, by, {"": quoted(col)}, (0.25, 0.5, 0.75), ["q25", "median", "q75"]).select(*map(quoted, by), "q25", "median", "q75", "size")


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of a key, ties by value."""
    return df.filter(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), quoted(key)).limit(k)


def in_top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.join(top_groups(df, key, k).select(quoted(key)), key, "left_semi")


def ranking(df: DataFrame, entity: str, col: str, k: int) -> DataFrame:
    """The ``k`` entities with the lowest and with the highest means."""
    means = df.groupBy(quoted(entity)).agg(F.avg(quoted(col)).alias("mean")).filter("mean IS NOT NULL")
    low = means.orderBy("mean", quoted(entity)).limit(k).withColumn("end", F.lit("lowest"))
    return low.unionByName(means.orderBy(F.desc("mean"), quoted(entity)).limit(k).withColumn("end", F.lit("highest")))


def best_per_group(df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The row with the least metric of each group, as one combined minimum."""
    rest = [c for c in df.columns if c not in by]
    order = [metric, *ties]
    row = F.struct(*(quoted(c) for c in [*order, *(c for c in rest if c not in order)]))
    least = df.filter(quoted(metric).isNotNull()).groupBy(*map(quoted, by)).agg(F.min(row).alias("_row"))
    return least.select(*(quoted(c) if c in by else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def mean_and_std(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Over seeds or repeats: mean and sample standard deviation."""
    return df.groupBy(*map(quoted, by)).agg(F.avg(quoted(col)).alias("mean"), F.stddev(quoted(col)).alias("std"), F.count(F.lit(1)).alias("n"))


# errors of predictions -------------------------------------------------------


def with_errors(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    e = quoted(true) - quoted(pred)
    return df.withColumns({"error": e, "abs_error": F.abs(e)})


def error_by(df: DataFrame, by: str, error: str = "error", by_order: bool = False) -> DataFrame:
    """Size, MAE and RMSE by a group (worst first), or in the order of a time."""
    e = quoted(error)
    out = df.groupBy(quoted(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.orderBy(quoted(by)) if by_order else out.orderBy(F.desc("mae"), quoted(by))


def mae_by_entity(df: DataFrame, entity: str, k: int = 25) -> DataFrame:
    return df.groupBy(quoted(entity)).agg(F.avg("abs_error").alias("mae"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("mae"), F.col(entity).asc_nulls_first()).limit(k)


def worst_errors(df: DataFrame, k: int, ids: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc("abs_error"), *map(quoted, ids)).select(*map(quoted, [*ids, "y_true", "y_pred", "error", "abs_error"])).limit(k)


def regression_metrics(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 in one aggregate; R2 is NULL for a constant outcome."""
    y, e = quoted(true).cast("double"), quoted(true) - quoted(pred)
    known = F.when(e.isNotNull(), y)
    sst = F.var_pop(known) * F.count(known)
    return df.groupBy(*map(quoted, by)).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"))


def sort_results(df: DataFrame) -> DataFrame:
    return df.orderBy("rmse", "mae", F.desc("r2"))


# correlation -----------------------------------------------------------------

#: Pairs in one aggregate; more go into further jobs over the same input.
PAIRS = 500


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, r`` for pairs in order of the columns, over the rows where both are known."""
    pairs, parts = list(combinations(cols, 2)), []
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        row = df.agg(*(F.corr(quoted(a).cast("double"), quoted(b).cast("double")).alias(f"{i}_r") for i, (a, b) in enumerate(some)))
        parts.append(row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.col(f"{i}_r"), F.lit(None).cast("double")).alias("r")) for i, (a, b) in enumerate(some))))))
    if not parts:
        raise ValueError("two columns at least")
    return _union(parts)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The full matrix, long: ``a, b, r`` with 1 on the diagonal."""
    half = correlation_pairs(df, cols)
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diagonal)


def high_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    return correlation_pairs(df, cols).withColumn("abs_r", F.abs("r")).filter(F.col("abs_r") > threshold).orderBy(F.desc("abs_r"), "a", "b")


def correlation_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """``feature, r, abs_r``, strongest first."""
    row = df.agg(*(F.corr(quoted(c).cast("double"), quoted(target).cast("double")).alias(f"{i}_r") for i, c in enumerate(cols)))
    return _stacked(row, list(cols), ["r"]).withColumn("abs_r", F.abs("r")).orderBy(F.desc_nulls_last("abs_r"), "feature")


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns replaced by their average ranks over the rows in which all are known.

    Ranks come from counts: of a column's different values each is counted, and
    running sums over ranges of values (see ``running_counts``) give its rank,
    so no task sorts a whole column.
    """
    known = df.select(*map(quoted, cols)).dropna()
    for c in cols:
        counts = known.groupBy(quoted(c)).agg(F.count(F.lit(1)).alias("_n"))
        ranks = running_counts(counts, c, "_n").select(quoted(c), (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_rank_{c}"))
        known = known.join(ranks, c)
    return known.select(*(F.col(f"_rank_{c}").alias(c) for c in cols))


def running_counts(df: DataFrame, by: str, n: str, parts: int = 64) -> DataFrame:
    """Adds ``_before``, the sum of ``n`` over all smaller values of ``by`` (unique, numeric).

    Approximate quantiles cut the values into ``parts`` ranges; sums of ranges
    are a small table, and a window runs inside a range only.
    """
    cuts = df.agg(F.approx_percentile(quoted(by).cast("double"), F.array(*(F.lit(i / parts) for i in range(1, parts)))).alias("q"))
    ranged = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("q", lambda x: x < quoted(by).cast("double")))).drop("q")  # one row
    sums = ranged.groupBy("_range").agg(F.sum(n).alias("_total"))
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = Window.partitionBy("_range").orderBy(quoted(by)).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(F.broadcast(ahead), "_range")  # ``parts`` rows
    return both.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_range", "_ahead")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the rank correlation, ties by average ranks.

    Rows are summed to pairs of values first, and these are read from memory or
    disk after that; ranks come from counts by value, so rows are never sorted.
    """
    pairs = df.select(quoted(a).alias("a"), quoted(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).persist()
    counts = {c: pairs.groupBy(c).agg(F.sum("n").alias("n")).persist() for c in ("a", "b")}
    try:
        n = pairs.agg(F.sum("n")).first()[0] or 0
        ranked = pairs
        for c in ("a", "b"):
            ranks = running_counts(counts[c], c, "n")
            ranked = ranked.join(ranks.select(c, (F.col("_before") + (F.col("n") - n) / 2).alias(f"_{c}")), c)  # less the mean rank
        row = ranked.agg(*(F.sum(F.col("n") * F.col(x) * F.col(y)).alias(x + y) for x, y in (("_a", "_b"), ("_a", "_a"), ("_b", "_b")))).first()
        spread = (row["_a_a"] or 0.0) * (row["_b_b"] or 0.0)
        return df.sparkSession.createDataFrame([(row["_a_b"] / spread**0.5 if spread else None,)], "rho double")
    finally:
        for kept in (pairs, *counts.values()):
            kept.unpersist()


def gramian(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregate (not centred)."""
    k, at = len(cols), [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = np.zeros((k, k))
    for start in range(0, len(at), PAIRS):
        some = at[start : start + PAIRS]
        row = df.agg(*(F.coalesce(F.sum(quoted(cols[i]).cast("double") * quoted(cols[j]).cast("double")), F.lit(0.0)).alias(f"s{n}") for n, (i, j) in enumerate(some))).first()
        for n, (i, j) in enumerate(some):
            out[i, j] = out[j, i] = row[f"s{n}"]
    return out


def vif_of(g: np.ndarray) -> np.ndarray:
    """Variance inflation without an intercept from a Gramian: G_ii (G^-1)_ii; infinite if collinear."""
    scale = np.sqrt(np.diag(g))
    out = np.full(len(g), np.inf)
    live = scale > 0
    if not live.any():
        return out
    r = g[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    values, vectors = np.linalg.eigh(r)
    small = values <= 1e-12 * values.max()
    inverse = (vectors[:, ~small] ** 2 / values[~small]).sum(axis=1)
    tied = (vectors[:, small] ** 2).sum(axis=1) > 1e-9
    out[live] = np.where(tied, np.inf, inverse)
    return out


def vif_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, vif``, highest first; medians stand in for missing values, infinite ones are NULL."""
    filled = fill_global_median(df.select(*(finite(quoted(c)).alias(c) for c in cols)), cols)
    rows = [(c, float(v) if np.isfinite(v) else None) for c, v in zip(cols, vif_of(gramian(filled, cols)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").orderBy(F.desc_nulls_first("vif"), "feature")


# numbers behind charts -------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n`` over equal widths from minimum to maximum; the last bin is closed."""
    c = quoted(col).cast("double")
    ends = df.agg(F.min(c).alias("_low"), F.max(c).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    no = F.when(width > 0, F.least(F.floor((c - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = df.filter(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(no.alias("bin"), "_low", "_high").agg(F.count(F.lit(1)).alias("n"))  # one row
    return counted.select("bin", (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Quartiles, whiskers (the data's ends within 1.5 interquartile ranges) and the number of points outside."""
    q = quartile_band(df, [by], col).select(quoted(by), "q25", "median", "q75")
    both = df.select(quoted(by), quoted(col).alias("_v")).join(q, by)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("_v").between(F.col("q25") - reach, F.col("q75") + reach)
    value = F.when(inside, F.col("_v"))
    return both.groupBy(quoted(by), "q25", "median", "q75").agg(F.min(value).alias("low_whisker"), F.max(value).alias("high_whisker"), F.count_if(~inside).alias("n_outside"))
