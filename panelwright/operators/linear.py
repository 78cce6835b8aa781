"""Linear models from Gramians: one pass over the data for all folds, all penalties and all refits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import quoted
from .stats import PAIRS

#: Penalties that are tried (fixed values).
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
L1_RATIOS = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass(frozen=True)
class Linear:
    intercept: float
    coef: dict[str, float]
    name: str = "linear"
    info: dict | None = None

    def expression(self) -> Column:
        return reduce(lambda a, b: a + b, (quoted(c) * float(w) for c, w in self.coef.items()), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("y_pred", self.expression())

    def importances(self) -> dict[str, float]:
        return dict(self.coef)


def fold_gramians(df: DataFrame, cols: Sequence[str], target: str, fold: Column | None = None) -> dict[int, np.ndarray]:
    """By fold, the sums of products of (1, columns, target) over complete rows, in one grouped aggregate."""
    names = [None, *cols, target]
    value = lambda c: F.lit(1.0) if c is None else quoted(c).cast("double")
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.dropna(subset=[*cols, target]).withColumn("_fold", fold if fold is not None else F.lit(0))
    out: dict[int, np.ndarray] = {}
    for start in range(0, len(at), PAIRS):
        some = at[start : start + PAIRS]
        for r in rows.groupBy("_fold").agg(*(F.sum(value(names[i]) * value(names[j])).alias(f"s{n}") for n, (i, j) in enumerate(some))).collect():  # folds
            g = out.setdefault(r["_fold"], np.zeros((len(names), len(names))))
            for n, (i, j) in enumerate(some):
                g[i, j] = g[j, i] = r[f"s{n}"]
    return out


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, means (columns, target), covariance sums of columns, with the target, and of the target."""
    n = g[0, 0]
    m = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(m, m)
    return n, m, c[:-1, :-1], c[:-1, -1], max(c[-1, -1], 0.0)


def _r2(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """R2 of a model on the rows behind a Gramian."""
    v = np.r_[b, w, -1.0]
    _, _, _, _, sst = _centred(g)
    return float(1 - v @ g @ v / sst) if sst > 0 else float("nan")


def solve_ridge(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and an unpenalised intercept; least norm where columns are collinear."""
    _, m, a, b, _ = _centred(g)
    w = np.linalg.lstsq(a + alpha * np.eye(len(a)), b, rcond=None)[0] if len(a) else np.zeros(0)
    return w, float(m[-1] - m[:-1] @ w)


def solve_elastic(g: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 1000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Coordinate descent for ``|y - Xw|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2)``."""
    n, m, a, b, _ = _centred(g)
    a, b = a / n, b / n
    w = np.zeros(len(b))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(w)):
            if a[i, i] <= 0:
                continue
            r = b[i] - a[i] @ w + a[i, i] * w[i]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0.0) / (a[i, i] + alpha * (1 - l1_ratio))
            moved = max(moved, abs(new - w[i]) * np.sqrt(a[i, i]))
            w[i] = new
        if moved < tol:
            break
    return w, float(m[-1] - m[:-1] @ w)


def _scores(parts: dict[int, np.ndarray], solve) -> list[float]:
    total = sum(parts.values())
    return [_r2(parts[f], *solve(total - parts[f])) for f in sorted(parts)]


def elastic_scores(parts: dict[int, np.ndarray], alpha: float, l1_ratio: float = 1.0) -> list[float]:
    """R2 of each fold."""
    return _scores(parts, lambda g: solve_elastic(g, alpha, l1_ratio))


def fit_mean(df: DataFrame, target: str) -> Linear:
    return Linear(df.agg(F.avg(quoted(target))).first()[0] or 0.0, {}, "mean")


def ols_of(parts: dict[int, np.ndarray], cols: Sequence[str]) -> Linear:
    w, b = solve_ridge(sum(parts.values()), 0.0)
    return Linear(b, dict(zip(cols, w.tolist(), strict=True)), "ols")


def fit_ols(df: DataFrame, cols: Sequence[str], target: str) -> Linear:
    return ols_of(fold_gramians(df, cols, target), cols)


def part_of(parts: dict[int, np.ndarray], cols: Sequence[str], own: Sequence[str]) -> dict[int, np.ndarray]:
    """Sums of products of some of the columns, cut out of those of all."""
    at = [0, *(list(cols).index(c) + 1 for c in own), len(cols) + 1]
    return {f: g[np.ix_(at, at)] for f, g in parts.items()}


def ridge_scores(parts: dict[int, np.ndarray], alphas: Sequence[float] = RIDGE_ALPHAS) -> dict[float, list[float]]:
    """R2 of each fold by penalty, in closed form."""
    return {a: _scores(parts, lambda g, a=a: solve_ridge(g, a)) for a in alphas}


def fit_ridge(df: DataFrame, cols: Sequence[str], target: str, fold: Column | None = None, alphas: Sequence[float] = RIDGE_ALPHAS) -> Linear:
    return ridge_of(fold_gramians(df, cols, target, fold), cols, alphas)


def ridge_of(parts: dict[int, np.ndarray], cols: Sequence[str], alphas: Sequence[float] = RIDGE_ALPHAS) -> Linear:
    """The penalty with the best mean R2 over folds; the first of equal ones. Without folds the first penalty."""
    means = {a: float(np.mean(s)) for a, s in ridge_scores(parts, alphas).items()} if len(parts) > 1 else {alphas[0]: 0.0}
    best = max(means, key=means.__getitem__)
    w, b = solve_ridge(sum(parts.values()), best)
    return Linear(b, dict(zip(cols, w.tolist(), strict=True)), "ridge", {"alpha": best, "scores": means})


def fit_elastic(df: DataFrame, cols: Sequence[str], target: str, fold: Column, l1_ratios: Sequence[float] = (1.0,), n_alphas: int = 30, eps: float = 1e-3, name: str = "lasso", alpha: float | None = None) -> Linear:
    return elastic_of(fold_gramians(df, cols, target, fold), cols, l1_ratios, n_alphas, eps, name, alpha)


def elastic_of(parts: dict[int, np.ndarray], cols: Sequence[str], l1_ratios: Sequence[float] = (1.0,), n_alphas: int = 30, eps: float = 1e-3, name: str = "lasso", alpha: float | None = None) -> Linear:
    """Lasso or elastic net; the penalty ``alpha`` with the first ratio, or penalties from the least that empties the model down to ``eps`` times it, chosen by folds."""
    total = sum(parts.values())
    if alpha is not None:
        w, c = solve_elastic(total, alpha, l1_ratios[0])
        return Linear(c, dict(zip(cols, w.tolist(), strict=True)), name, {"l1_ratio": l1_ratios[0], "alpha": alpha})
    n, _, _, b, _ = _centred(total)
    top = float(np.abs(b).max() / n) if len(b) else 0.0
    best, best_score = (l1_ratios[0], max(top, 1e-12)), -np.inf
    for ratio in l1_ratios:
        for alpha in np.geomspace(max(top / ratio, 1e-12), max(eps * top / ratio, 1e-15), n_alphas):
            score = float(np.mean(_scores(parts, lambda g, a=alpha, r=ratio: solve_elastic(g, a, r))))
            if score > best_score:
                best, best_score = (ratio, float(alpha)), score
    w, c = solve_elastic(total, best[1], best[0])
    return Linear(c, dict(zip(cols, w.tolist(), strict=True)), name, {"l1_ratio": best[0], "alpha": best[1], "score": best_score})
