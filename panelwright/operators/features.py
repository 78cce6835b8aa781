"""Derived columns, and the numeric frame that models take."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame

from ..functions.columns import contains_flag, log1p_clipped, missing_flag
from .clean import drop_missing_target
from .schema import numeric_columns, quoted, require_columns


def add_log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p": log1p_clipped(quoted(c)) for c in cols if c in df.columns})


def add_status_flag(df: DataFrame, col: str = "status", word: str = "developed", name: str = "status_flag") -> DataFrame:
    """1 where the text has the word; an existing flag is kept."""
    return df if col not in df.columns or name in df.columns else df.withColumn(name, contains_flag(quoted(col), word))


def add_missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": missing_flag(quoted(c)) for c in cols if c in df.columns})


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, cols: Sequence[str] = ()) -> DataFrame:
    """``a__x__b`` for the pairs, or for all pairs of ``cols``."""
    pairs = list(pairs) if pairs is not None else list(combinations(cols, 2))
    return df.withColumns({f"{a}__x__{b}": quoted(a) * quoted(b) for a, b in pairs if a in df.columns and b in df.columns})


def model_frame(df: DataFrame, target: str, ids: Sequence[str] = (), leakage: Sequence[str] = (), log1p: Sequence[str] = (), status: str = "status", missing: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Derived columns added; ids, leaking columns and texts dropped; numbers with a known target kept.

    Columns in ``keep`` (keys, say) ride along and are no features.
    """
    require_columns(df, [target])
    out = add_interactions(add_missing_flags(add_status_flag(add_log1p(df, log1p), status), missing), pairs)
    gone = {*ids, *leakage, status, *keep} - {target}
    out = drop_missing_target(out, target)
    cols = [c for c in numeric_columns(out) if c not in gone]
    return out.select(*(quoted(c) for c in keep if c in out.columns), *(quoted(c) if c == target else quoted(c).cast("double").alias(c) for c in cols))
