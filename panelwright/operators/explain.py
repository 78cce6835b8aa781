"""Importances and effects. Rows are multiplied by a small grid, predicted in one pass and averaged."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import Linear
from .models import Trees
from .numbers import numbered_rows, shuffled
from .quantiles import exact_quantiles
from .schema import quoted
from .stats import regression_metrics


def _sample(df: DataFrame, key: Sequence[str], rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of seed and key, numbered from 1.

    The limit is what bounds the multiplied rows below; it is a parameter.
    """
    few = df.withColumn("_u", F.xxhash64(F.lit(seed), *map(quoted, key))).orderBy("_u", *map(quoted, key)).limit(rows)
    return few.withColumn("_no", F.row_number().over(Window.orderBy("_u", *map(quoted, key)))).drop("_u")


def permutation_importance(model: Linear | Trees, df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], repeats: int = 5, seed: int = 42, score: str = "rmse") -> DataFrame:
    """``feature, importance_mean, importance_std``: how much worse the score gets when a feature's values are dealt anew.

    ``score`` is "rmse" or "mae", of which the rise counts, or "r2", of which the drop counts.

    Values are dealt anew over all rows: rows are numbered in order of their
    key, each repeat is a permutation of the numbers, and a row's donor is
    found by an equality join on it. All features and repeats are predicted in
    one pass over rows x features x repeats.
    """
    if score not in ("rmse", "mae", "r2"):
        raise ValueError("score is rmse, mae or r2")
    known = df.dropna(subset=[*features, target]).select(*map(quoted, key), quoted(target).alias("_y"), F.struct(*map(quoted, features)).alias("_own"))
    base, n = numbered_rows(known, key)
    base = base.select("_no", F.col("_y").alias("y_true"), "_own")
    turns = base.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    turns = turns.withColumn("_from", shuffled(F.col("_no"), n, F.lit(seed), F.col("_repeat")))
    wide = turns.join(base.select(F.col("_no").alias("_from"), F.col("_own").alias("_new")), "_from").withColumn("_feature", F.explode(F.array(F.lit(""), *map(F.lit, features))))
    wide = wide.filter((F.col("_feature") != "") | (F.col("_repeat") == 0))  # the rows as they are, once
    swapped = wide.select("_feature", "_repeat", "y_true", *(F.when(F.col("_feature") == c, F.col(f"_new.`{c}`")).otherwise(F.col(f"_own.`{c}`")).alias(c) for c in features))
    scores = regression_metrics(model.predict(swapped), by=["_feature", "_repeat"]).select("_feature", "_repeat", score).collect()  # one a feature and repeat
    before = next((r[score] for r in scores if not r["_feature"]), None)
    rows = []
    for c in features:
        drops = [(before - r[score]) if score == "r2" else (r[score] - before) for r in scores if r["_feature"] == c]
        rows.append((c, float(np.mean(drops)) if drops else None, float(np.std(drops)) if drops else None))
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double").orderBy(F.desc("importance_mean"), "feature")


def linear_shap(model: Linear, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, mean_abs_shap``: mean of \\|weight x (value - mean)\\|, which is exact for a linear model."""
    means = df.agg(*(F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(features)))
    both = df.crossJoin(F.broadcast(means))  # one row
    row = both.agg(*(F.avg(F.abs((quoted(c) - F.col(f"_m{i}")) * float(model.coef[c]))).alias(f"v{i}") for i, c in enumerate(features)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("mean_abs_shap")) for i, c in enumerate(features))))).orderBy(F.desc("mean_abs_shap"), "feature")


def sampled_shap(model: Linear | Trees, df: DataFrame, features: Sequence[str], key: Sequence[str], rows: int = 200, permutations: int = 8, seed: int = 42) -> DataFrame:
    """``feature, mean_abs_shap`` of any model by sampled Shapley values.

    Each row is paired with other rows as background; along a random order of
    the features one after the other takes the row's value, and a feature's
    share is the step in the prediction.
    """
    base = _sample(df.dropna(subset=list(features)), key, rows, seed).select("_no", *map(quoted, features)).persist()
    n, k = base.count(), len(features)
    turns = base.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    other = turns.withColumn("_back", F.pmod(F.xxhash64(F.lit(seed), "_no", "_turn"), F.lit(max(1, n))).cast("int") + 1)
    back = base.select(F.col("_no").alias("_back"), F.struct(*map(quoted, features)).alias("_b"))
    drawn = F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed + 1 + i), "_no", "_turn").alias("h"), F.lit(i).alias("i")) for i in range(k))))
    steps = other.join(back, "_back").withColumn("_order", F.transform(drawn, lambda x: x["i"])).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k))))
    mixed = steps.withColumns({c: F.when(F.array_position("_order", F.lit(i)) <= F.col("_step"), quoted(c)).otherwise(F.col(f"_b.`{c}`")) for i, c in enumerate(features)})
    predicted = model.predict(mixed).select("_no", "_turn", "_step", "_order", "y_pred")
    w = Window.partitionBy("_no", "_turn").orderBy("_step")  # one row a step
    moved = predicted.withColumn("_d", F.col("y_pred") - F.lag("y_pred").over(w)).filter("_step > 0").withColumn("_i", F.element_at("_order", F.col("_step")))
    each = moved.groupBy("_no", "_i").agg(F.avg("_d").alias("_phi")).groupBy("_i").agg(F.avg(F.abs("_phi")).alias("mean_abs_shap"))
    names = F.array(*map(F.lit, features))
    try:
        rows = [tuple(r) for r in each.select(F.element_at(names, F.col("_i") + 1), "mean_abs_shap").collect()]  # one a feature
    finally:
        base.unpersist()
    return df.sparkSession.createDataFrame(rows, "feature string, mean_abs_shap double").orderBy(F.desc("mean_abs_shap"), "feature")


def partial_dependence(model: Linear | Trees, df: DataFrame, feature: str, features: Sequence[str], points: int = 20) -> DataFrame:
    """``feature, value, mean_pred`` over evenly spaced values between the 5th and 95th percentile; all rows take part."""
    base = df.dropna(subset=list(features)).select(*map(quoted, features))
    low, high = exact_quantiles(df, {feature: quoted(feature)}, (0.05, 0.95))[feature]
    values = [] if low is None else [low + (high - low) * i / max(1, points - 1) for i in range(points)]
    grid = df.sparkSession.createDataFrame([(v,) for v in values], "_value double")
    wide = base.crossJoin(F.broadcast(grid)).withColumn(feature, F.col("_value"))  # ``points`` rows
    return model.predict(wide).groupBy(F.col("_value").alias("value")).agg(F.avg("y_pred").alias("mean_pred")).select(F.lit(feature).alias("feature"), "value", "mean_pred").orderBy("value")


def importance_table(df: DataFrame, models: dict[str, Linear | Trees]) -> DataFrame:
    """Coefficients or impurity importances, a column a model, a row a feature."""
    features = sorted({f for m in models.values() for f in m.importances()})
    rows = [(f, *(m.importances().get(f) for m in models.values())) for f in features]
    schema = "feature string" + "".join(f", `{n}` double" for n in models)
    return df.sparkSession.createDataFrame(rows, schema).orderBy("feature")
