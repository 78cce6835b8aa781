"""Rows that share a key. What is first or last is by an order that the caller gives, ties by all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import quoted


def _order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str]:
    given = list(order)
    return given + [c for c in df.columns if c not in given and c not in keys]


def shared_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows share their key with another, and how many keys do."""
    n = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return n.agg(F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("duplicate_rows"), F.count_if(many).alias("duplicate_keys"))


def shared_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that share their key with another. Keys are counted first, so no task sorts all rows of a hot one."""
    many = df.groupBy(*(quoted(c).alias(f"_by_{c}") for c in keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    test = F.lit(True)
    for c in keys:
        test = test & quoted(c).eqNullSafe(F.col(f"_by_{c}"))
    return df.join(many, test, "left_semi")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The row of each key that comes first.

    A minimum over whole rows, combined before the shuffle, so a key with very
    many rows costs no sort and no task of its own.
    """
    return _extreme(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    return _extreme(df, keys, order, F.max)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = _order(df, keys, order)
    if not rest:
        return df.distinct()
    row = F.struct(*(quoted(c) for c in rest))
    best = df.groupBy(*map(quoted, keys)).agg(pick(row).alias("_row"))
    return best.select(*(quoted(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def drop_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key is theirs alone."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_n"), *(F.min(quoted(c)).alias(c) for c in rest)).filter("_n = 1")
    return one.select(*map(quoted, df.columns))


def mean_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row a key: means of numeric columns, first known values of the others."""
    by = F.struct(*(quoted(c) for c in _order(df, keys, order)))
    out = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        c = quoted(f.name)
        first = F.min(F.when(c.isNotNull(), F.struct(by, c.alias("v"))))["v"]
        out.append((F.avg(c) if isinstance(f.dataType, T.NumericType) else first).alias(f.name))
    grouped = df.groupBy(*map(quoted, keys))
    return (grouped.agg(*out) if out else df.select(*map(quoted, keys)).distinct()).select(*map(quoted, df.columns))


def deduplicate(df: DataFrame, keys: Sequence[str], policy: str = "keep_first", order: Sequence[str] = ()) -> DataFrame:
    if policy == "keep_first":
        return keep_first(df, keys, order)
    if policy == "keep_last":
        return keep_last(df, keys, order)
    if policy == "drop_all":
        return drop_all(df, keys)
    if policy == "mean_aggregate":
        return mean_aggregate(df, keys, order)
    raise ValueError(f"unknown policy {policy!r}: keep_first, keep_last, drop_all or mean_aggregate")
