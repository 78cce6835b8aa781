"""Feature selection: one pass for correlations, one for the Gramian; loops run over these small matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.columns import finite
from .clean import drop_constant_columns
from .impute import fill_global_median
from .schema import numeric_columns, quoted
from .stats import correlation_pairs, gramian, vif_of


def prune_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.9, protected: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Kept and dropped columns. Of each pair that correlates at the threshold one goes: the later one, or the earlier if only the later is protected; none of two protected ones."""
    if len(cols) < 2:
        return list(cols), []
    place, safe = {c: i for i, c in enumerate(cols)}, set(protected)
    high = [sorted((r["a"], r["b"]), key=place.__getitem__) for r in correlation_pairs(df, cols).collect() if r["r"] is not None and abs(r["r"]) >= threshold]  # pairs of columns
    gone = {earlier if later in safe else later for earlier, later in high if not {earlier, later} <= safe}
    return [c for c in cols if c not in gone], sorted(gone)


def _highest(vif: np.ndarray, able: Sequence[int]) -> int:
    """The first of those with the highest inflation. Inflations as near as rounding leaves them (an inflated column is ill-conditioned, so in proportion to the highest) are equal."""
    top = max(vif[i] for i in able)
    if np.isinf(top):
        return next(i for i in able if np.isinf(vif[i]))
    rounding = min(0.01, 64 * len(vif) * np.finfo(float).eps * vif[np.isfinite(vif)].max())
    return next(i for i in able if vif[i] >= top * (1 - rounding))


def prune_vif(df: DataFrame, cols: Sequence[str], threshold: float = 10.0, protected: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Drop unprotected columns, highest inflation first (of equal ones the first column), as long as any column, protected or not, is above the threshold."""
    kept, gone = list(cols), []
    if len(kept) < 2:
        return kept, gone
    filled = fill_global_median(df.select(*(finite(quoted(c)).alias(c) for c in kept)), kept)
    g = gramian(filled, kept)
    while len(kept) > 1:
        vif = vif_of(g)
        able = [i for i, c in enumerate(kept) if c not in protected]
        if not able or not vif.max() > threshold:
            break
        worst = _highest(vif, able)
        gone.append(kept.pop(worst))
        g = np.delete(np.delete(g, worst, 0), worst, 1)
    return kept, gone


def priority_set(priority: Sequence[str], available: Sequence[str], least: int = 1, most: int | None = None) -> list[str]:
    """All available columns ranked: those with a priority by it, the others behind them as they stand. The first ones: as many as have a priority, ``least`` at least, ``most`` at most."""
    rank = {c: i for i, c in enumerate(priority)}
    ranked = sorted(available, key=lambda c: rank.get(c, len(rank)))
    size = max(least, len(rank.keys() & set(available)))
    return ranked[: size if most is None else min(size, most)]


def feature_sets(frame: DataFrame, target: str, keys: Sequence[str] = (), priority: Sequence[str] = (), protected: Sequence[str] = (), corr_threshold: float = 0.9, vif_threshold: float = 10.0, least: int = 1, most: int | None = None) -> tuple[dict[str, list[str]], DataFrame]:
    """Sets A (all that vary), B (A pruned by correlation) and C (by priority, of what inflation leaves of B), and a table of them."""
    varied, constant = drop_constant_columns(frame, [target, *keys])
    a = numeric_columns(varied, [target, *keys])
    b, by_corr = prune_correlated(varied, a, corr_threshold, protected)
    left, by_vif = prune_vif(varied, b, vif_threshold, protected)
    sets = {"A": a, "B": b, "C": priority_set(priority, left, least, most)}
    why = {"constant": constant, "correlated": by_corr, "inflated": by_vif}
    rows = [("set", name, i, c) for name, cols in sets.items() for i, c in enumerate(cols)] + [("dropped", name, i, c) for name, cols in why.items() for i, c in enumerate(cols)]
    table = frame.sparkSession.createDataFrame(rows, "kind string, name string, place int, feature string")
    return sets, table
