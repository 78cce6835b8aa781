"""Filters and repair of values. Rules are column expressions; counts of a stage come from one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clipped, finite, log_eps, number, within
from ..sources.sinks import kept
from .dedup import deduplicate, shared_key_rows
from .quantiles import exact_quantiles
from .schema import keyword_columns, numeric_columns, numeric_text, pick, prepare_keys, quoted, require_columns
from .stats import missing_fractions, output_summary

#: Columns with these words hold shares of people immunised (fixed values).
SHARE_WORDS = ("polio", "diphtheria", "hepatitis", "measles", "immun", "vacc")


def apply_bounds(df: DataFrame, col: str, low: float, high: float, clip: bool = False) -> DataFrame:
    """Values not above ``low`` or above ``high`` become NULL, or are clipped."""
    c = quoted(col)
    return df.withColumn(col, clipped(c, low, high) if clip else F.when(within(c, low, high), c))


def negative_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(~(quoted(c) < 0), quoted(c)) for c in cols if c in df.columns})


def clip_shares(df: DataFrame, words: Sequence[str] = SHARE_WORDS, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Numeric columns whose names have one of the words are clipped to [low, high]."""
    numeric = set(numeric_columns(df))
    return df.withColumns({c: clipped(quoted(c), low, high) for c in keyword_columns(df, words) if c in numeric})


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    require_columns(df, [target])
    return df.filter(quoted(target).isNotNull())


def entities_with_targets(df: DataFrame, entity: str, target: str, least: int) -> DataFrame:
    """Rows of entities with ``least`` known targets or more; counts are combined before the shuffle."""
    good = df.groupBy(entity).agg(F.count(quoted(target)).alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(good, entity, "left_semi")


def entities_with_times(df: DataFrame, entity: str, time: str, least: int) -> DataFrame:
    """Rows of entities with ``least`` different times or more."""
    good = df.groupBy(entity).agg(F.count_distinct(quoted(time)).alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(good, entity, "left_semi")


def time_range(df: DataFrame, time: str, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(quoted(time) >= start)
    return df if end is None else df.filter(quoted(time) <= end)


def drop_empty_rows(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Without rows in which everything but the keys is NULL."""
    skip = set(keys)
    return df.dropna(how="all", subset=[c for c in df.columns if c not in skip])


def drop_sparse_columns(df: DataFrame, threshold: float | None, protected: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Without columns of which more than ``threshold`` is missing. One pass decides."""
    if threshold is None:
        return df, []
    if not 0 < threshold < 1:
        raise ValueError("threshold is between 0 and 1")
    skip = set(protected)
    cols = [c for c in df.columns if c not in skip]
    found = missing_fractions(df, cols)
    gone = [c for c in cols if found[c] > threshold]
    return df.drop(*gone), gone


def drop_constant_columns(df: DataFrame, protected: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Without columns that have one value at most. One pass of minima and maxima decides."""
    skip = set(protected)
    cols = [c for c in df.columns if c not in skip]
    row = df.agg(*(x for i, c in enumerate(cols) for x in (F.min(quoted(c)).alias(f"a{i}"), F.max(quoted(c)).alias(f"b{i}")))).first() if cols else None
    gone = [c for i, c in enumerate(cols) if row[f"a{i}"] == row[f"b{i}"]]
    return df.drop(*gone), gone


def winsorize(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99, exact: bool = True) -> DataFrame:
    """Clip columns to their quantiles: exact ones (see ``quantiles``), or approximate ones from one pass. Columns without values stay."""
    if exact:
        ends = exact_quantiles(df, {c: finite(quoted(c)) for c in cols}, (low, high))
    else:
        row = df.agg(*(F.approx_percentile(finite(quoted(c)), F.array(F.lit(low), F.lit(high)), 10000).alias(f"q{i}") for i, c in enumerate(cols))).first()
        ends = {c: row[f"q{i}"] or [None, None] for i, c in enumerate(cols)}
    return df.withColumns({c: clipped(quoted(c), *ends[c]) for c in cols})


def log_columns(df: DataFrame, cols: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Adds ``log_c`` for each column, negative values as NULL."""
    return df.withColumns({f"log_{c}": log_eps(quoted(c), eps) for c in cols})


def outside(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows in which a column is below or above what its rule allows."""
    test = F.lit(False)
    for c, (low, high) in rules.items():
        test = test | (quoted(c) < low if low is not None else F.lit(False)) | (quoted(c) > high if high is not None else F.lit(False))
    return df.filter(test)


def clean_outcome_panel(
    df: DataFrame,
    target: str,
    entity: str = "country",
    time: str = "year",
    policy: str = "keep_first",
    order: Sequence[str] = (),
    bounds: tuple[float, float] = (0.0, 100.0),
    clip: bool = False,
    negative_cols: Sequence[str] = (),
    share_words: Sequence[str] = SHARE_WORDS,
    min_targets: int = 5,
    max_missing: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The cleaning of a source that has the outcome, and a one-row summary.

    Cast, deduplicate, apply bounds, negative to NULL, clip shares, drop rows
    without the target, keep entities with enough targets, drop sparse columns.
    """
    start = prepare_keys(df, entity, time)
    require_columns(start, [target])
    start = start.withColumn(target, number(target))
    single = deduplicate(start, [entity, time], policy, order)
    valid = apply_bounds(single, target, *bounds, clip=clip)
    valid = clip_shares(negative_to_null(valid, negative_cols), share_words)
    known = kept(drop_missing_target(valid, target), "known-targets")  # counted by entity, and read
    out, gone = drop_sparse_columns(entities_with_targets(known, entity, target, min_targets), max_missing, (entity, time, target))
    bad = ~within(quoted(target), *bounds)
    summary = (
        start.agg(F.count(F.lit(1)).alias("input_rows"))
        .crossJoin(shared_key_rows(start, [entity, time]))
        .crossJoin(single.agg(F.count(F.lit(1)).alias("unique_rows"), F.count_if(bad).alias("out_of_bounds"), F.count_if(quoted(target).isNull()).alias("missing_target")))
        .crossJoin(output_summary(out, time))
        .withColumns({"input_cols": F.lit(len(df.columns)), "dropped_columns": F.array(*map(F.lit, gone)).cast("array<string>")})
    )  # every side is one row
    return out, summary


def clean_covariate_panel(
    df: DataFrame,
    cols: Sequence[str],
    ids: Sequence[str] = (),
    entity: str = "country",
    time: str = "year",
    winsorized: Sequence[str] = (),
    quantiles: tuple[float, float] = (0.01, 0.99),
    logged: Sequence[str] = (),
    eps: float = 1e-6,
    max_missing: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The cleaning of a source of covariates, and a one-row summary.

    Choose columns, make numeric texts numbers, winsorize, add logarithms,
    drop sparse columns. Columns to winsorize or log that there are not are
    passed over.
    """
    start = prepare_keys(df, entity, time)
    chosen, missing = pick(start, cols, [entity, time, *ids])
    chosen, changed = numeric_text(chosen, [entity, time, *ids])
    able = set(numeric_columns(chosen))
    win = [c for c in winsorized if c in able]
    if win:
        chosen = winsorize(kept(chosen, "covariates"), win, *quantiles)  # read for the quantiles, and again
    out = log_columns(chosen, [c for c in logged if c in able], eps)
    out, gone = drop_sparse_columns(out, max_missing, (entity, time, *ids))
    lists = {"missing_columns": missing, "numeric_texts": changed, "dropped_columns": gone}
    summary = start.agg(F.count(F.lit(1)).alias("input_rows")).crossJoin(output_summary(out, time))
    return out, summary.withColumns({k: F.array(*map(F.lit, v)).cast("array<string>") for k, v in lists.items()} | {"input_cols": F.lit(len(df.columns))})
