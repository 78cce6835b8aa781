"""Wide by time to long, long to a panel, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, year
from .clean import drop_empty_rows
from .dedup import keep_first
from .joins import check_unique
from .schema import prefix_columns, quoted, require_columns, time_columns


def wide_to_long(df: DataFrame, ids: Sequence[str], times: Sequence[str] | None = None, time: str = "year", value: str = "value", start: int | None = None, end: int | None = None) -> DataFrame:
    """A row for each time column. Columns outside [start, end] are dropped before the rows are made."""
    require_columns(df, ids)
    cols = list(times) if times is not None else time_columns(df)
    cols = [c for c in cols if (start is None or int(c) >= start) and (end is None or int(c) <= end)]
    if not cols:
        raise ValueError("there are no time columns")
    same = df.select(*map(quoted, ids), *(number(quoted(c)).alias(c) for c in cols))
    long = same.unpivot([quoted(c) for c in ids], [quoted(c) for c in cols], time, value)
    return long.withColumn(time, year(time))


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """A column for each of ``names``: its first known value by ``order``, the smallest without one.

    Known names spare a pass to find them.
    """
    cells = df.select(*map(quoted, dict.fromkeys([*keys, name, value, *order])))
    if order:
        cells = keep_first(cells.filter(quoted(value).isNotNull() | ~quoted(name).isin(*names)), [*keys, name], order)
    return cells.groupBy(*map(quoted, keys)).pivot(name, list(names)).agg(F.min(quoted(value)))


def wide_to_panel(df: DataFrame, codes: Sequence[str], entity: str = "country", code: str = "indicator_code", start: int | None = None, end: int | None = None, prefix: str = "", validate: bool = False) -> DataFrame:
    """Indicators wide by time to one row for each entity and time, a column for each indicator.

    Rows of other indicators go before anything is unpivoted, and rows without
    any value at the end.
    """
    kept = df.filter(quoted(code).isin(*codes))
    long = wide_to_long(kept, [entity, code], start=start, end=end)
    if validate:
        check_unique(long, [entity, code, "year"], "indicator")
    wide = long_to_wide(long, [entity, "year"], code, "value", codes)
    return drop_empty_rows(prefix_columns(wide, prefix, [entity, "year"]), [entity, "year"])


def metric_matrix(results: DataFrame, rows: str, cols: str, metric: str, names: Sequence[str]) -> DataFrame:
    return results.groupBy(quoted(rows)).pivot(cols, list(names)).agg(F.first(quoted(metric), True))
