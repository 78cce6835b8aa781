"""Merging panels on entity and time, and what a merge loses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_last
from .hot import Hot
from .schema import quoted, require_columns
from .windows import fill_both_ways

HOW = ("inner", "left", "right", "outer")
CARDINALITY = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def check_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    """Raise if a key of ``df`` has more than one row; NULL keys count."""
    if not df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError(f"keys of the {side} side are not unique")


def unique_keys(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``df``, which fails when it is read if a key has more than one row; NULL keys count."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, keys)))
    bad = F.raise_error(F.lit(f"keys of the {side} side are not unique")).cast("boolean")
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, bad).otherwise(True)).drop("_n")


def merge_panels(left: DataFrame, right: DataFrame, on: Sequence[str] = ("country", "year"), how: str = "inner", validate: str | None = "one_to_one", suffixes: tuple[str, str] = ("_x", "_y"), null_keys: bool = False) -> DataFrame:
    """Join on the key columns; other columns that both have get the suffixes.

    ``validate`` names the cardinality that must hold; where it does not, the
    query fails. Keys are counted in the join's own exchange, not in a pass of
    their own. With ``null_keys`` a NULL key meets another NULL key.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {', '.join(HOW)}")
    require_columns(left, on, "left")
    require_columns(right, on, "right")
    if validate is not None:
        if validate not in CARDINALITY:
            raise ValueError(f"validate is one of {', '.join(CARDINALITY)}")
        left, right = (unique_keys(df, on, side) if unique else df for unique, df, side in zip(CARDINALITY[validate], (left, right), ("left", "right"), strict=True))
    both = (set(left.columns) & set(right.columns)) - set(on)
    a = left.select(*(quoted(c).alias(c + suffixes[0] if c in both else c) for c in left.columns))
    b = right.select(*(quoted(c).alias(f"_key_{c}" if c in on else c + suffixes[1] if c in both else c) for c in right.columns))

    def equal(c: str) -> Column:
        return a[c].eqNullSafe(b[f"_key_{c}"]) if null_keys else a[c] == b[f"_key_{c}"]

    joined = a.join(b, reduce(lambda x, y: x & y, map(equal, on)), how)
    keys = [F.coalesce(a[c], b[f"_key_{c}"]).alias(c) for c in on]
    return joined.select(*keys, *(a[c] for c in a.columns if c not in on), *(b[c] for c in b.columns if not c.startswith("_key_")))


def key_coverage(left: DataFrame, right: DataFrame, on: Sequence[str] = ("country", "year")) -> DataFrame:
    """One row: different keys of each side, common ones, and those that each side loses."""
    sides = [df.select(*map(quoted, on)).dropna().distinct().withColumn(f"_{s}", F.lit(True)) for s, df in (("l", left), ("r", right))]
    both = sides[0].join(sides[1], list(on), "outer")
    in_left, in_right = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return both.agg(
        F.count_if(in_left).alias("left_keys"), F.count_if(in_right).alias("right_keys"), F.count_if(in_left & in_right).alias("common_keys"), F.count_if(in_left & ~in_right).alias("left_lost"), F.count_if(in_right & ~in_left).alias("right_lost")
    )


def keys_lost(left: DataFrame, right: DataFrame, on: Sequence[str] = ("country", "year")) -> DataFrame:
    """The keys themselves, with the side that loses them."""
    a, b = (df.select(*map(quoted, on)).distinct() for df in (left, right))
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right")))


def restrict_to(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``other``, too."""
    return df.join(other.select(*map(quoted, on)), list(on), "left_semi")


def attach(df: DataFrame, metadata: DataFrame, on: Sequence[str], cols: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Columns of ``metadata`` by key. It has a key once; or, with an ``order``, the last row of a key by it counts, then by the columns."""
    cols = [c for c in (cols or metadata.columns) if c not in on]
    if order is not None:
        metadata = keep_last(metadata.select(*map(quoted, dict.fromkeys([*on, *order, *cols]))), on, order)
    return df.join(metadata.select(*map(quoted, [*on, *cols])), list(on), "left")


def attach_nearest(df: DataFrame, metadata: DataFrame, entity: str, time: str, cols: Sequence[str], order: Sequence[str] = (), restrict: bool = False, hot: Hot | None = None) -> DataFrame:
    """Metadata of the same time; where there is none, the last before, else the first after, within the rows of ``df``.

    Of repeated metadata keys the last row by ``order`` counts; with
    ``restrict`` entities that the metadata do not have go.
    """
    known = metadata.dropna(subset=[entity, time])
    df = restrict_to(df, known, [entity]) if restrict else df
    both = attach(df, known, [entity, time], cols, order)
    return fill_both_ways(both, entity, time, cols, hot)


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the share of known values of each column."""
    return df.agg(*(F.avg(quoted(c).isNotNull().cast("double")).alias(c) for c in cols))


def common_times(left: DataFrame, right: DataFrame, time: str) -> DataFrame:
    return left.select(quoted(time)).intersect(right.select(quoted(time)))


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_results(frames: Sequence[DataFrame], on: Sequence[str], how: str = "outer") -> DataFrame:
    """Result tables of a few rows side by side by key, such as importances of several models."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def metric_gap(results: DataFrame, on: Sequence[str], split: str, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics under two splits side by side, and their differences (second less first)."""
    a, b = (results.filter(quoted(split) == s).select(*map(quoted, on), *(quoted(m).alias(f"{m}_{s}") for m in metrics)) for s in (first, second))
    both = a.join(b, list(on))
    return both.withColumns({f"{m}_gap": quoted(f"{m}_{second}") - quoted(f"{m}_{first}") for m in metrics})
