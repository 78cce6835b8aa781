"""Ordered operators within an entity. All columns of an operator share one sort.

Windows run over the rows of one entity, of which there is one for each time.
Entities with too many rows for one task are cut into ranges of time where the
operator is given ``hot`` (see ``hot_entities``); results are the same. The few
windows without an entity run over yearly aggregates or result tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .hot import CHUNK, HOME, NO, Hot
from .schema import quoted


def _by(entity: str, time: str):
    return Window.partitionBy(quoted(entity)).orderBy(quoted(time))


def _both_ways(entity: str, w: WindowSpec, hot: Hot | None) -> tuple[WindowSpec, WindowSpec]:
    """The rows up to each row, and those from it on, nearest last.

    The second runs backwards over the rows' numbers: Spark goes through the
    rest of the entity anew for each row of a frame that ends with it.
    """
    whole = Window.unboundedPreceding, 0
    parts = [quoted(entity)] if hot is None else [quoted(entity), CHUNK]
    return w.rowsBetween(*whole), Window.partitionBy(*parts).orderBy(F.desc(NO)).rowsBetween(*whole)


def rolling(c: Column, w, width: int, start: int, end: int) -> Column:
    """Mean over rows start..end, only where ``width`` of them are known."""
    over = w.rowsBetween(start, end)
    return F.when(F.count(c).over(over) == width, F.avg(c).over(over))


def _home(rows: DataFrame, df: DataFrame, new: Sequence[str]) -> DataFrame:
    """Without the copies from before ranges and without what numbers rows."""
    return rows.filter(HOME).select(*(quoted(c) for c in dict.fromkeys([*df.columns, *new])))


def lag_features(df: DataFrame, entity: str, time: str, cols: Sequence[str], lags: Sequence[int] = (1,), rolling_cols: Sequence[str] = (), windows: Sequence[int] = (), drop_incomplete: bool = False, drop_missing: Sequence[str] = (), hot: Hot | None = None) -> DataFrame:
    """``c_lagk`` for each column and lag, and ``c_rollmeanw`` over the w rows before.

    Lags count rows, not years. ``drop_incomplete`` drops rows where any new
    column is NULL, ``drop_missing`` those where one of its columns is. Rows
    without an entity get no lags.
    """
    if any(k < 1 for k in (*lags, *windows)):
        raise ValueError("lags and windows are 1 at least")
    w, known, rows = _by(entity, time), quoted(entity).isNotNull(), df
    if hot is not None:
        rows, w = hot.with_rows_before(df, max([0, *lags, *windows]))
    new = {f"{c}_lag{k}": F.when(known, F.lag(quoted(c), k).over(w)) for c in cols for k in lags}
    new |= {f"{c}_rollmean{n}": F.when(known, rolling(quoted(c), w, n, -n, -1)) for c in rolling_cols for n in windows}
    out = _home(rows.withColumns(new), df, new) if hot is not None else rows.withColumns(new)
    gone = [*(new if drop_incomplete else ()), *drop_missing]
    return out.dropna(subset=gone) if gone else out


def interpolate(df: DataFrame, entity: str, time: str, cols: Sequence[str], limit: int = 2, hot: Hot | None = None) -> DataFrame:
    """Linear by row between the nearest known values, up to ``limit`` rows from either; ends copy the nearest, as far.

    Rows without an entity stay as they are.
    """
    if limit < 1:
        raise ValueError("limit is 1 at least")
    w = _by(entity, time) if hot is None else hot.inside()
    back, ahead = _both_ways(entity, w, hot)
    numbered = df.withColumn(NO, F.row_number().over(w)) if hot is None else hot.with_edges(hot.numbered(df), {str(i): quoted(c).cast("double") for i, c in enumerate(cols)})
    marks = {}
    for i, c in enumerate(cols):
        x = F.when(quoted(c).isNotNull(), F.struct(F.col(NO).alias("n"), quoted(c).cast("double").alias("v")))
        before, after = F.last(x, True).over(back), F.last(x, True).over(ahead)
        marks |= {f"_p{i}": before, f"_n{i}": after} if hot is None else {f"_p{i}": F.coalesce(before, f"_before_{i}"), f"_n{i}": F.coalesce(after, f"_after_{i}")}
    out = numbered.withColumns(marks)
    filled = {}
    for i, c in enumerate(cols):
        p, n = F.col(f"_p{i}"), F.col(f"_n{i}")
        dp, dn = F.col(NO) - p["n"], n["n"] - F.col(NO)
        near = (F.coalesce(dp <= limit, F.lit(False)) | F.coalesce(dn <= limit, F.lit(False))) & quoted(entity).isNotNull()
        between = p["v"] + (n["v"] - p["v"]) * dp / (dp + dn)
        filled[c] = F.when(quoted(c).isNotNull(), quoted(c).cast("double")).when(near, F.coalesce(between, p["v"], n["v"]))
    return out.withColumns(filled).select(*map(quoted, df.columns))


def fill_both_ways(df: DataFrame, entity: str, time: str, cols: Sequence[str], hot: Hot | None = None) -> DataFrame:
    """The last known value before, else the first after."""
    w = _by(entity, time) if hot is None else hot.inside()
    back, ahead = _both_ways(entity, w, hot)
    near = {c: [F.last(quoted(c), True).over(x) for x in (back, ahead)] for c in cols}
    if hot is None:
        rows = df.withColumn(NO, F.row_number().over(w))
        filled = {c: F.coalesce(*x) for c, x in near.items()}
    else:
        rows = hot.with_edges(hot.numbered(df), {str(i): quoted(c) for i, c in enumerate(cols)})
        filled = {c: F.coalesce(near[c][0], F.col(f"_before_{i}.v"), near[c][1], F.col(f"_after_{i}.v")) for i, c in enumerate(cols)}
    return rows.withColumns(filled).select(*map(quoted, df.columns))


def sequences(df: DataFrame, entity: str, time: str, features: Sequence[str], target: str, window: int, meta: Sequence[str] = (), hot: Hot | None = None) -> DataFrame:
    """``entity, time, meta, target, sequence``: the ``window`` rows before each row as an array of arrays.

    Rows with a shorter history, with a NULL in it or without a target are left out.
    """
    rows, w = (df, _by(entity, time)) if hot is None else hot.with_rows_before(df, window)
    over = w.rowsBetween(-window, -1)
    step = F.array(*(quoted(c).cast("double") for c in features))
    out = rows.withColumn("sequence", F.collect_list(step).over(over))
    out = (out if hot is None else out.filter(HOME)).select(quoted(entity), quoted(time), *map(quoted, meta), quoted(target), "sequence")
    full = (F.size("sequence") == window) & F.forall("sequence", lambda s: F.forall(s, lambda v: v.isNotNull()))
    return out.filter(quoted(entity).isNotNull() & quoted(target).isNotNull() & full)


def sequence_delta(df: DataFrame, target: str, position: int) -> DataFrame:
    """Adds ``last_target``, the feature at ``position`` of the last step, and ``delta``, the target less it."""
    last = F.element_at(F.element_at("sequence", -1), position + 1)
    return df.withColumns({"last_target": last, "delta": quoted(target) - last})


def moving_average(df: DataFrame, time: str, col: str, width: int = 5) -> DataFrame:
    """Over a table of one row for each time."""
    return df.withColumn(f"{col}_ma{width}", rolling(quoted(col), Window.orderBy(quoted(time)), width, -(width - 1), 0))


def running_best(df: DataFrame, order: str, score: str) -> DataFrame:
    """Over a table of trials: the best score so far."""
    return df.withColumn("best_so_far", F.max(quoted(score)).over(Window.orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, 0)))


def rank_results(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Over a table of configurations: 1 for the best score, equal scores share a rank."""
    return df.withColumn(name, F.rank().over(Window.orderBy(F.desc(score))))
