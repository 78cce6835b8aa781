"""Exact Shapley values of tree ensembles.

The game is that of the trees themselves: where a split's feature is not known,
both branches count, by their shares of the training rows. A leaf is worth its
value times a product over the features on its path: 1 or 0 for a known feature,
as the row meets all its splits or not, and the product of the branches' shares
for an unknown one. The weights of the Shapley value are integrals of
``t^s (1 - t)^(d - 1 - s)``, so a feature's part of a leaf is its own difference
times the integral over t from 0 to 1 of the product of ``share (1 - t) + met t``
over the other features, a polynomial that Gauss's quadrature integrates
without error.

Leaves go to the workers as arrays in one broadcast, of the size of the model,
which its parameters bound; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .models import Trees
from .schema import quoted

#: Numbers of a block of rows x leaves x features.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Leaves:
    """Leaves of all trees; a path's features are filled up with ones that change nothing (share 1, always met)."""

    value: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        """The mean prediction over the training rows of the trees."""
        return float(self.value @ self.share.prod(1))


def leaves(model: Trees, df: DataFrame) -> Leaves:
    """The leaves of a fitted ensemble; ``df`` names the session."""
    spark, fitted = df.sparkSession, model.model
    path = scratch_path(spark, "trees")
    fitted.write().save(path)
    weights = np.array(fitted.treeWeights)
    if model.name == "forest":
        weights = weights / len(weights)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["impurityStats"][0].alias("rows"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"].alias("split"))
    trees: dict[int, dict[int, tuple]] = {}
    for tree, no, *rest in nodes.collect():  # the model, which the driver has fitted
        trees.setdefault(tree, {})[no] = rest
    found: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
    for tree, own in trees.items():
        open_: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while open_:
            no, way = open_.pop()
            value, rows, left, right, split = own[no]
            if left < 0:
                found.append((weights[tree] * value, way))
                continue
            if split["numCategories"] != -1:
                raise ValueError("splits have to be thresholds")
            f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            open_.append((left, way | {f: (low, min(high, cut), share * own[left][1] / rows)}))
            open_.append((right, way | {f: (max(low, cut), high, share * own[right][1] / rows)}))
    depth = max(1, max((len(way) for _, way in found), default=1))
    found.sort(key=lambda x: len(x[1]))
    filled = [list(way.items()) + [(0, (-np.inf, np.inf, 1.0))] * (depth - len(way)) for _, way in found]
    low, high, share = (np.array([[w[1][i] for w in way] for way in filled]).reshape(-1, depth) for i in range(3))
    return Leaves(np.array([v for v, _ in found]), np.array([[w[0] for w in way] for way in filled], np.int64).reshape(-1, depth), low, high, share)


def shapley(own: Leaves, x: np.ndarray) -> np.ndarray:
    """Rows x features; every block of rows and leaves is one array operation."""
    depth, limit = own.feature.shape[1], np.finfo(float).max
    x = np.clip(x, -limit, limit)
    at, weight = np.polynomial.legendre.leggauss((depth + 1) // 2)  # without error up to degree depth
    at, weight = (at + 1) / 2, weight / 2
    out = np.zeros(x.shape)
    some = max(1, min(len(own.value), BLOCK // depth // 16))
    for i in range(0, len(own.value), some):
        part = slice(i, i + some)
        feature, share = own.feature[part], own.share[part]
        order = np.argsort(feature, axis=None, kind="stable")
        kinds, starts = np.unique(feature.ravel()[order], return_index=True)
        rows = max(1, BLOCK // feature.size)
        for j in range(0, len(x), rows):
            values = x[j : j + rows][:, feature]
            met = ((values > own.above[part]) & (values <= own.upto[part])).astype(float)
            sums = np.zeros(met.shape)
            for t, w in zip(at, weight, strict=True):
                factor = share * (1 - t) + met * t  # above 0, as t is below 1 and no branch is without rows
                sums += w * factor.prod(2, keepdims=True) / factor
            sums *= (met - share) * own.value[part][:, None]
            out[j : j + rows, kinds] += np.add.reduceat(sums.reshape(len(sums), -1)[:, order], starts, axis=1)
    return out


def contributions(model: Trees, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``base`` and ``contributions``, an array in the order of the model's inputs, for each row without NULLs in them.

    ``base`` and the contributions add up to the prediction. The work of a row
    grows with leaves x depth^2: small for boosted trees of some levels, a
    fraction of a second for hundreds of trees of a dozen levels.
    """
    own = leaves(model, df)
    sent, base, k = df.sparkSession.sparkContext.broadcast(own), own.base, len(model.inputs)
    plain = [f"_f{i}" for i in range(k)]
    rows = df.dropna(subset=list(model.inputs)).select(*map(quoted, keep), *(quoted(c).cast("double").alias(p) for c, p in zip(model.inputs, plain, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            phi = shapley(sent.value, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.full(len(x), base)), lists], [*keep, "base", "contributions"])

    schema = rows.select(*map(quoted, keep), F.lit(0.0).alias("base"), F.array(F.lit(0.0)).alias("contributions")).schema
    return rows.mapInArrow(run, schema)


def tree_shap(model: Trees, df: DataFrame) -> DataFrame:
    """``feature, mean_abs_shap`` over all rows of ``df`` that lack no input, the largest first."""
    each = contributions(model, df, []).select(F.posexplode("contributions").alias("_i", "_phi"))
    names = F.array(*map(F.lit, model.inputs))
    out = each.groupBy("_i").agg(F.avg(F.abs("_phi")).alias("mean_abs_shap"))
    return out.select(F.element_at(names, F.col("_i") + 1).alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")
