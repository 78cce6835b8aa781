"""Fills by medians, and the three steps of a panel's imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import Hot
from .quantiles import exact_quantiles, grouped_quantiles
from .schema import quoted, require_columns
from .windows import interpolate


def fill_group_median(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """NULLs become the median of their group; rows without a group, and groups without a value, stay."""
    require_columns(df, [*by, *cols])
    if not cols:
        return df
    medians = grouped_quantiles(df.dropna(subset=list(by)), by, {f"_med{i}": quoted(c) for i, c in enumerate(cols)}, (0.5,)).toDF(*(f"_by_{c}" for c in by), *(f"_med{i}" for i in range(len(cols))))
    test = F.lit(True)
    for c in by:
        test = test & (quoted(c) == F.col(f"_by_{c}"))
    joined = df.join(medians, test, "left")
    return joined.withColumns({c: F.coalesce(quoted(c).cast("double"), F.col(f"_med{i}")) for i, c in enumerate(cols)}).select(*map(quoted, df.columns))


def fill_global_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """NULLs become the median of the column: an exact one (see ``quantiles``), or an approximate one from one pass."""
    if not cols:
        return df
    if exact:
        medians = {c: v[0] for c, v in exact_quantiles(df, {c: quoted(c) for c in cols}, (0.5,)).items()}
    else:
        row = df.agg(*(F.approx_percentile(quoted(c), 0.5, 10000).alias(f"m{i}") for i, c in enumerate(cols))).first()
        medians = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(medians[c]).cast("double")) for c in cols})


def filled_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row: values of each column that were NULL and are not any more."""
    a = before.select(*map(quoted, keys), *(F.isnull(quoted(c)).alias(f"_{c}") for c in cols))
    both = a.join(after.select(*map(quoted, keys), *map(quoted, cols)), list(keys))
    return both.agg(*(F.count_if(F.col(f"_{c}") & quoted(c).isNotNull()).alias(c) for c in cols))


def impute_panel(
    df: DataFrame, entity: str, time: str, target: str | None = None, interpolated: Sequence[str] = (), limit: int = 2, group_by: Sequence[str] = (), group_cols: Sequence[str] = (), median_cols: Sequence[str] = (), hot: Hot | None = None
) -> tuple[DataFrame, DataFrame]:
    """Interpolation, group medians, global medians; the target is never filled. And counts of each step, one row.

    Counts come from marks made beside each step, so the panel is not read again for them.
    """
    keep = lambda cols: [c for c in cols if c in df.columns and c != target]
    steps = {"interpolated": keep(interpolated), "group_median": keep(group_cols), "median": keep(median_cols)}
    out = df
    marks = []

    def mark(step: str) -> None:
        nonlocal out
        new = {f"_{step}_{c}": F.isnull(quoted(c)) for c in steps[step]}
        marks.extend(new)
        out = out.withColumns(new) if new else out

    mark("interpolated")
    out = interpolate(out, entity, time, steps["interpolated"], limit, hot) if steps["interpolated"] else out
    after_first = {c: F.isnull(quoted(c)).alias(f"_after1_{c}") for c in steps["interpolated"]}
    out = out.select("*", *after_first.values())
    mark("group_median")
    out = fill_group_median(out, group_by, steps["group_median"]) if group_by else out
    after_second = {c: F.isnull(quoted(c)).alias(f"_after2_{c}") for c in steps["group_median"]}
    out = out.select("*", *after_second.values())
    mark("median")
    out = fill_global_median(out, steps["median"])
    ends = {"interpolated": "_after1_", "group_median": "_after2_"}
    counts = [
        F.count_if(F.col(f"`_{step}_{c}`") & ~(F.col(f"`{ends[step]}{c}`") if step in ends else F.isnull(quoted(c)))).alias(f"{step}_{c}") for step, cols in steps.items() for c in cols
    ]
    summary = out.agg(F.count(F.lit(1)).alias("rows"), *counts)
    return out.select(*map(quoted, df.columns)), summary
