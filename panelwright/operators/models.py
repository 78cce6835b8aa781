"""Models by name, each fitted as Spark work, and the table of their results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import L1_RATIOS, RIDGE_ALPHAS, Linear, elastic_of, fit_elastic, fit_mean, fit_ols, fit_ridge, fold_gramians, ols_of, part_of, ridge_of
from .mlprep import Preparation, is_train, prepare
from .schema import quoted
from .splits import hash_fold
from .stats import regression_metrics, sort_results, with_errors

#: Iterations without a lower error on val rows after which boosting stops (fixed value).
PATIENCE = 50


@dataclass(frozen=True)
class Trees:
    """A fitted ensemble with the names of its inputs."""

    model: Model
    inputs: list[str]
    name: str
    info: dict | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        plain = {c: f"_f{i}" for i, c in enumerate(self.inputs)}
        wide = df.withColumns({p: quoted(c) for c, p in plain.items()})
        vectors = VectorAssembler(inputCols=list(plain.values()), outputCol="_features").transform(wide)
        return self.model.setFeaturesCol("_features").setPredictionCol("y_pred").transform(vectors).drop("_features", *plain.values())

    def importances(self) -> dict[str, float]:
        return dict(zip(self.inputs, self.model.featureImportances.toArray().tolist(), strict=True))


def _vectors(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    plain = [f"_f{i}" for i in range(len(cols))]
    narrow = df.select(*(quoted(c).alias(p) for c, p in zip(cols, plain, strict=True)), quoted(target).cast("double").alias("label"), "split")
    return VectorAssembler(inputCols=plain, outputCol="features").transform(narrow.dropna()).select("features", "label", "split")


def fit_forest(df: DataFrame, cols: Sequence[str], target: str, trees: int = 300, min_leaf: int = 2, depth: int = 12, subset: str = "sqrt", bins: int = 32, seed: int = 42, **_: Any) -> Trees:
    rows = _vectors(df.filter(is_train()), cols, target)
    est = RandomForestRegressor(numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, featureSubsetStrategy=subset, maxBins=bins, seed=seed)
    return Trees(est.fit(rows), list(cols), "forest", {"trees": trees})


def best_prefix(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """How many iterations to keep: up to the least error, the first of equal ones, looking no further than ``patience`` iterations without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of the first ``n`` trees."""
    jvm, java = SparkContext._active_spark_context._jvm, model._java_obj
    kind = jvm.org.apache.spark.ml.regression
    trees = SparkContext._gateway.new_array(kind.DecisionTreeRegressionModel, n)
    weights = SparkContext._gateway.new_array(SparkContext._gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = GBTRegressionModel(kind.GBTRegressionModel(java.uid(), trees, weights))
    cut._resetUid(model.uid)
    return model._copyValues(cut)


def fit_gbt(df: DataFrame, cols: Sequence[str], target: str, iterations: int = 100, depth: int = 5, rate: float = 0.1, min_leaf: int = 1, patience: int = PATIENCE, subsample: float = 1.0, subset: str = "all", seed: int = 42, **_: Any) -> Trees:
    """Gradient boosting; rows labelled val choose how many trees are kept.

    The ensemble grows on the training rows in steps of ``patience`` trees at
    least. The squared errors of all its prefixes are one aggregate over the
    val rows; it is cut where they are least, once they have not been lower
    for ``patience`` iterations.
    """
    rows = _vectors(df.filter(F.col("split").isin("train", "val")), cols, target).persist()
    try:
        fit, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
        est = GBTRegressor(maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, subsamplingRate=subsample, featureSubsetStrategy=subset, seed=seed)
        if val.isEmpty():
            model = est.setMaxIter(iterations).fit(fit)
            return Trees(model, list(cols), "gbt", {"best_iteration": model.getNumTrees})
        n = min(iterations, 2 * patience)
        while True:  # twice the trees each time: less than twice the work of the last
            model = est.setMaxIter(n).fit(fit)
            errors = model.evaluateEachIteration(val, "squared")
            best = best_prefix(errors, patience)
            if n >= iterations or len(errors) - best >= patience:
                break
            n = min(iterations, 2 * n)
        return Trees(first_trees(model, best), list(cols), "gbt", {"best_iteration": best, "errors": errors})
    finally:
        rows.unpersist()


def _linear(fit: Callable[..., Linear]) -> Callable[..., Linear]:
    def run(df: DataFrame, cols: Sequence[str], target: str, key: Sequence[str] = (), folds: int = 5, seed: int = 42, **kw: Any) -> Linear:
        return fit(df.filter(is_train()), cols, target, hash_fold(key, folds, seed), **kw)

    return run


@dataclass(frozen=True)
class Spec:
    """How a model is fitted, and how its inputs are scaled."""

    fit: Callable[..., Linear | Trees]
    scale: str


REGISTRY: dict[str, Spec] = {
    "mean": Spec(lambda df, cols, target, **_: fit_mean(df.filter(is_train()), target), "none"),
    "ols": Spec(lambda df, cols, target, **_: fit_ols(df.filter(is_train()), cols, target), "standard"),
    "ridge": Spec(_linear(lambda df, cols, target, fold, alphas=(0.1, 1.0, 10.0, 100.0, 1000.0), **_: fit_ridge(df, cols, target, fold, alphas)), "standard"),
    "lasso": Spec(_linear(lambda df, cols, target, fold, alpha=None, **_: fit_elastic(df, cols, target, fold, alpha=alpha)), "standard"),
    "elastic_net": Spec(_linear(lambda df, cols, target, fold, alpha=None, l1_ratio=None, **_: fit_elastic(df, cols, target, fold, L1_RATIOS if l1_ratio is None else (l1_ratio,), name="elastic_net", alpha=alpha)), "standard"),
    "forest": Spec(fit_forest, "none"),
    "gbt": Spec(fit_gbt, "none"),
}


def pick_models(names: Sequence[str] | None = None) -> dict[str, Spec]:
    names = list(REGISTRY) if names is None else list(names)
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown models: {', '.join(unknown)}; known: {', '.join(REGISTRY)}")
    return {n: REGISTRY[n] for n in names}


@dataclass(frozen=True)
class Fitted:
    """A model with the preparation it was fitted behind."""

    prep: Preparation
    model: Linear | Trees

    def predict(self, df: DataFrame, target: str, ids: Sequence[str] = ()) -> DataFrame:
        """Ids, ``split``, ``y_true, y_pred, error, abs_error``; ids ride along, nothing is joined back."""
        keep = list(dict.fromkeys([*ids, target, *(["split"] if "split" in df.columns else [])]))
        ready = self.prep.apply(df, keep)
        out = self.model.predict(ready).withColumnRenamed(target, "y_true").withColumn("y_true", F.col("y_true").cast("double"))
        kept = [c for c in keep if c != target]
        return with_errors(out).select(*map(quoted, kept), "y_true", "y_pred", "error", "abs_error")


def train(df: DataFrame, name: str, features: Sequence[str], target: str, key: Sequence[str], categorical: Sequence[str] = (), indicators: bool = False, scale: str | None = None, **kw: Any) -> Fitted:
    """Prepare on the training rows and fit one model; ``df`` has the labels in ``split``."""
    spec = pick_models([name])[name]
    numeric = [c for c in features if c not in categorical]
    prep = prepare(df.filter(is_train()), numeric, categorical, scale or spec.scale, indicators)
    keep = list(dict.fromkeys([*key, target, "split"]))
    return Fitted(prep, spec.fit(prep.apply(df, keep), prep.names, target, key=key, **kw))


def evaluate(predictions: DataFrame, info: Mapping[str, Any]) -> DataFrame:
    """A result row for each split that was predicted, with ``info`` as columns."""
    out = regression_metrics(predictions, by=["split"])
    return out.select(*(F.lit(v).alias(k) for k, v in info.items()), "split", "n", "rmse", "mae", "r2")


#: Linear models by what they take from sums by fold; their options beside ``alphas``, ``alpha`` and ``l1_ratio`` need a fit of their own.
FROM_SUMS: dict[str, Callable[..., Linear]] = {
    "mean": lambda parts, cols: Linear(sum(g[0, -1] for g in parts.values()) / max(1.0, sum(g[0, 0] for g in parts.values())), {}, "mean"),
    "ols": lambda parts, cols: ols_of(parts, cols),
    "ridge": lambda parts, cols, alphas=RIDGE_ALPHAS: ridge_of(parts, cols, alphas),
    "lasso": lambda parts, cols, alpha=None: elastic_of(parts, cols, alpha=alpha),
    "elastic_net": lambda parts, cols, alpha=None, l1_ratio=None: elastic_of(parts, cols, L1_RATIOS if l1_ratio is None else (l1_ratio,), name="elastic_net", alpha=alpha),
}


def linear_results(df: DataFrame, jobs: Sequence[tuple[str, str]], feature_sets: Mapping[str, Sequence[str]], target: str, key: Sequence[str], options: Mapping[str, Mapping[str, Any]], on: Sequence[str], folds: int = 5, seed: int = 42) -> list[tuple]:
    """Result rows of linear models on feature sets, from two scans for any number of them.

    All columns of all sets are prepared together, sums of their products by
    fold are gathered once, and every model is solved from its set's part of
    them. All models are scored in one aggregate.
    """
    cols = list(dict.fromkeys(c for name, _ in jobs for c in feature_sets[name]))
    prep = prepare(df.filter(is_train()), cols, scale="standard")
    ready = prep.apply(df, list(dict.fromkeys([*key, target, "split"])))
    parts = fold_gramians(ready.filter(is_train()), cols, target, hash_fold(key, folds, seed))
    fitted = [FROM_SUMS[name](part_of(parts, cols, feature_sets[own]), feature_sets[own], **dict(options.get(name, {}))) for own, name in jobs]
    y = quoted(target).cast("double")
    aggs = []
    for i, model in enumerate(fitted):
        e = y - model.expression()
        sst = F.var_pop(F.when(e.isNotNull(), y)) * F.count(e)
        aggs += [F.count(e).alias(f"n{i}"), F.sqrt(F.avg(e * e)).alias(f"rmse{i}"), F.avg(F.abs(e)).alias(f"mae{i}"), (1 - F.try_divide(F.sum(e * e), sst)).alias(f"r2{i}")]
    rows = ready.filter(F.col("split").isin(*on)).groupBy("split").agg(*aggs).collect()  # one a split
    return [(name, own, len(feature_sets[own]), r["split"], *(r[f"{k}{i}"] for k in ("n", "rmse", "mae", "r2"))) for i, (own, name) in enumerate(jobs) for r in rows]


def compare(df: DataFrame, models: Sequence[str], feature_sets: Mapping[str, Sequence[str]], target: str, key: Sequence[str], options: Mapping[str, Mapping[str, Any]] | None = None, on: Sequence[str] = ("test",), parallelism: int = 4) -> DataFrame:
    """Result rows of every model on every feature set, best first.

    The labelled frame is cached, if it is not already, for as long as models
    are fitted; what comes back are the result rows, a few for each model. All
    linear models on all sets share two scans, others are fitted some at a time.
    """
    pick_models(models)
    cached = df.storageLevel.useMemory or df.storageLevel.useDisk  # by the caller, who frees it
    df = df if cached else df.persist()

    def result(job: tuple[str, str]) -> list[tuple]:
        set_name, name = job
        fitted = train(df, name, feature_sets[set_name], target, key, **dict((options or {}).get(name, {})))
        rows = evaluate(fitted.predict(df.filter(F.col("split").isin(*on)), target, key), {})
        return [(name, set_name, len(feature_sets[set_name]), *r) for r in rows.collect()]  # one a split

    jobs = [(s, m) for s in feature_sets for m in models]
    plain = {"alphas", "alpha", "l1_ratio"}
    shared = [(s, m) for s, m in jobs if m in FROM_SUMS and feature_sets[s] and set((options or {}).get(m, {})) <= plain]
    try:
        rows = linear_results(df, shared, feature_sets, target, key, options or {}, on) if shared else []
        with ThreadPoolExecutor(parallelism) as pool:
            rows += [r for part in pool.map(result, [j for j in jobs if j not in shared]) for r in part]
    finally:
        if not cached:
            df.unpersist()
    return sort_results(df.sparkSession.createDataFrame(rows, "model string, feature_set string, n_features int, split string, n long, rmse double, mae double, r2 double"))
