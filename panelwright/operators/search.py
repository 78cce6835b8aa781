"""Search over hyper-parameters: seeded candidates, folds, a table of scores, and a refit of the best."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import fold_gramians, solve_elastic, solve_ridge
from .mlprep import is_train, prepare
from .models import Fitted, evaluate, train
from .quantiles import grouped_quantiles
from .schema import quoted
from .stats import regression_metrics
from .windows import rank_results

#: Ranges by model (fixed values). A range is drawn from by logarithm, evenly, or by whole numbers with both ends.
LOG, EVEN, WHOLE = "log", "even", "whole"
RANGES: dict[str, dict[str, Any]] = {
    "ridge": {"alphas": (LOG, 1e-2, 1e3)},
    "lasso": {"alpha": (LOG, 1e-4, 1e2)},
    "elastic_net": {"alpha": (LOG, 1e-4, 1e2), "l1_ratio": (EVEN, 0.05, 0.95)},
    "forest": {"trees": (WHOLE, 50, 300), "depth": (WHOLE, 3, 15), "min_leaf": (WHOLE, 2, 20), "subset": ["sqrt", "log2"]},
    "gbt": {"rate": (LOG, 0.01, 0.3), "depth": (WHOLE, 3, 8), "min_leaf": (WHOLE, 10, 50), "iterations": (WHOLE, 100, 500)},
}
#: Sets of parameters of ``gbt`` that are tried one by one (fixed values): five points, of which the last one's 63 leaves are a depth
#: of 6 here, and nine trials over depth, rate and sampling.
GBT_SWEEP = [{"rate": 0.03, "depth": 3}, {"rate": 0.05, "depth": 3}, {"rate": 0.05, "depth": 5}, {"rate": 0.1, "depth": 3}, {"rate": 0.05, "depth": 6}]
GBT_TRIALS = [
    {"iterations": 1200, "rate": 0.05, "depth": 3, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 1200, "rate": 0.05, "depth": 5, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 1200, "rate": 0.05, "depth": 7, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 1500, "rate": 0.03, "depth": 5, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 1500, "rate": 0.05, "depth": 5, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 1500, "rate": 0.1, "depth": 5, "subsample": 0.9, "subset": "0.9"},
    {"iterations": 800, "rate": 0.05, "depth": 5, "subsample": 0.8, "subset": "0.8"},
    {"iterations": 1200, "rate": 0.05, "depth": 5, "subsample": 0.8, "subset": "0.8"},
    {"iterations": 1500, "rate": 0.05, "depth": 5, "subsample": 1.0, "subset": "0.8"},
]


def grid(options: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]


def draw(model: str, n: int, seed: int = 42, ranges: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    """``n`` candidates; the same seed draws the same ones."""
    r, own = random.Random(seed), RANGES[model] if ranges is None else ranges

    def one(v: Any) -> Any:
        if isinstance(v, list):
            return r.choice(v)
        kind, low, high = v
        return r.randint(low, high) if kind == WHOLE else r.uniform(low, high) if kind == EVEN else float(np.exp(r.uniform(np.log(low), np.log(high))))

    return [{k: one(v) for k, v in own.items()} for _ in range(n)]


def _fold_score(df: DataFrame, model: str, params: Mapping[str, Any], features: Sequence[str], target: str, key: Sequence[str], fold: int) -> float:
    labelled = df.withColumn("split", F.when(F.col("_fold") == fold, "test").otherwise("train"))
    fitted = train(labelled, model, features, target, key, **params)
    row = regression_metrics(fitted.predict(labelled.filter("split = 'test'"), target, key)).first()
    return -row["rmse"] if row["rmse"] is not None else float("nan")


def _linear_scores(rows: DataFrame, model: str, candidates: Sequence[Mapping[str, Any]], features: Sequence[str], target: str, folds: int) -> list[list[float]]:
    """Scores by candidate and fold, as fits in each fold would give them, from sums by fold.

    Values are scaled alike for all folds first, for accuracy only, and NULLs
    are marked beside them. From sums of products of values, marks and target
    by fold come those of the other folds with NULLs at the other folds'
    median, and values less their mean, by their deviation.
    """
    names = list(features)
    rough = prepare(rows, names, scale="standard")
    at, width = np.array([rough.centres[c] for c in names]), np.array([rough.widths[c] for c in names])
    x = {c: (quoted(c).cast("double") - float(a)) / float(w) for c, a, w in zip(names, at, width, strict=True)}
    sums = {}
    moments = [f(v).alias(f"{n}{i}") for i, v in enumerate(x.values()) for n, f in (("n", F.count), ("a", F.avg), ("v", F.var_pop))]
    for r in rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("rows"), *moments).collect():  # folds
        sums[r["_fold"]] = (r["rows"], *(np.array([r[f"{n}{i}"] or 0.0 for i in range(len(names))]) for n in "nav"))
    gaps = [i for i in range(len(names)) if any(s[1][i] < s[0] for s in sums.values())]
    medians = np.zeros((folds, len(names)))
    if gaps:
        others = rows.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("_out") != F.col("_fold"))
        for r in grouped_quantiles(others, ["_out"], {names[i]: x[names[i]] for i in gaps}, (0.5,)).collect():  # folds
            for i in gaps:
                medians[r["_out"], i] = -at[i] / width[i] if r[f"{names[i]}_0"] is None else r[f"{names[i]}_0"]
    marks = [f"_gap{i}" for i in gaps]
    flat = rows.select("_fold", quoted(target), *(F.coalesce(v, F.lit(0.0)).alias(f"_x{i}") for i, v in enumerate(x.values())), *(F.isnull(quoted(names[i])).cast("double").alias(m) for i, m in zip(gaps, marks, strict=True)))
    parts = fold_gramians(flat, [*(f"_x{i}" for i in range(len(names))), *marks], target, F.col("_fold"))
    total, size = sum(parts.values()), len(names)
    scores: list[list[float]] = [[] for _ in candidates]
    for f in range(folds):
        if f not in parts:
            for own in scores:
                own.append(float("nan"))
            continue
        n, a, v = _pooled([s for g, s in sums.items() if g != f])
        whole = sum(s[0] for g, s in sums.items() if g != f)
        centre = (n * a + (whole - n) * medians[f]) / max(1, whole)
        spread = (n * (v + (a - centre) ** 2) + (whole - n) * (medians[f] - centre) ** 2) / max(1, whole)
        scale = np.sqrt(spread)
        scale[scale == 0] = 1 / width[scale == 0]  # a width of 0 counts as 1, in the column's own units
        turn = np.zeros((len(total), size + 2))
        turn[0, 0] = turn[-1, -1] = 1.0
        for i in range(size):
            turn[0, i + 1], turn[i + 1, i + 1] = -centre[i] / scale[i], 1 / scale[i]
        for j, i in enumerate(gaps):
            turn[size + 1 + j, i + 1] = medians[f][i] / scale[i]
        fit, held = (turn.T @ g @ turn for g in (total - parts[f], parts[f]))
        for own, c in zip(scores, candidates, strict=True):
            if model == "ridge":
                w, b = solve_ridge(fit, c["alphas"] if isinstance(c["alphas"], float | int) else c["alphas"][0])
            else:
                w, b = solve_elastic(fit, c["alpha"], c.get("l1_ratio", 1.0))
            e = np.r_[b, w, -1.0]
            own.append(-float(np.sqrt(max(0.0, e @ held @ e) / held[0, 0])))
    return scores


def _pooled(sums: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and variances of several parts together."""
    n = sum(s[1] for s in sums)
    safe = np.maximum(n, 1)
    a = sum(s[1] * s[2] for s in sums) / safe
    return n, a, sum(s[1] * (s[3] + (s[2] - a) ** 2) for s in sums) / safe


def search(df: DataFrame, model: str, candidates: Sequence[Mapping[str, Any]], features: Sequence[str], target: str, key: Sequence[str], fold: Column, folds: int, parallelism: int = 4) -> DataFrame:
    """``candidate, params, mean_score, std_score, rank`` over the training rows; the score is the negative RMSE.

    The preparation is fitted inside each fold, without the rows held out.
    Linear models need a few passes for all candidates and folds; other models
    a fit for each, some at a time.
    """
    rows = df.filter(is_train()).withColumn("_fold", fold).cache()
    try:
        if model in ("ridge", "lasso", "elastic_net"):
            scores = _linear_scores(rows, model, candidates, features, target, folds)
        else:
            jobs = [(c, f) for c in candidates for f in range(folds)]
            with ThreadPoolExecutor(parallelism) as pool:
                flat = list(pool.map(lambda job: _fold_score(rows, model, job[0], features, target, key, job[1]), jobs))
            scores = [flat[i * folds : (i + 1) * folds] for i in range(len(candidates))]
    finally:
        rows.unpersist()
    table = [(i, str(dict(c)), float(np.mean(s)), float(np.std(s))) for i, (c, s) in enumerate(zip(candidates, scores, strict=True))]
    out = df.sparkSession.createDataFrame(table, "candidate int, params string, mean_score double, std_score double")
    return rank_results(out, "mean_score").orderBy("rank", "candidate")


def tune(df: DataFrame, model: str, candidates: Sequence[Mapping[str, Any]], features: Sequence[str], target: str, key: Sequence[str], fold: Column, folds: int) -> tuple[Fitted, DataFrame, DataFrame]:
    """The best candidate refitted on all training rows, the table, and test rows of the default and the tuned model."""
    table = search(df, model, candidates, features, target, key, fold, folds)
    best = dict(candidates[table.first()["candidate"]])
    if model == "ridge" and isinstance(best.get("alphas"), float | int):
        best["alphas"] = (best["alphas"],)
    tuned, plain = train(df, model, features, target, key, **best), train(df, model, features, target, key)
    test = df.filter("split = 'test'")
    both = [evaluate(f.predict(test, target, key), {"model": model, "variant": v}) for f, v in ((plain, "default"), (tuned, "tuned"))]
    return tuned, table, both[0].unionByName(both[1])
