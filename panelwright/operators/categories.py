"""Columns with any number of categories: numbered in a table, joined by value, and never one expression or list entry each.

A dense preparation makes a column of every category, which is right for a few
hundred. Here the categories are a table. Rows get their numbers by equality
joins, so they become sparse vectors with one entry for each column. A ridge
model takes one such column by blocks: what categories add to the sums of
products is diagonal, so all their weights are eliminated in one aggregate over
the table and only the numeric weights are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.sinks import kept, scratch_path
from .mlprep import Preparation
from .numbers import numbered_rows
from .schema import quoted
from .stats import PAIRS

#: Type and parts of a vector as Parquet holds it; 0 marks a sparse one.
_SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


@dataclass(frozen=True)
class Dictionary:
    """Categories of some columns: ``table`` has ``col`` (place in ``cols``), ``value``, ``n`` and ``at``, numbered from 0 over all columns by column, then value."""

    cols: list[str]
    table: DataFrame
    modes: dict[str, str | None]
    size: int

    def value(self, c: str) -> Column:
        """The category of a row; NULL counts as the most frequent one."""
        return F.coalesce(quoted(c).cast("string"), F.lit(self.modes[c]))

    def look_up(self, df: DataFrame, name: str = "codes") -> DataFrame:
        """Adds an array of the numbers of a row's categories, ascending; unknown categories have none."""
        out = df
        for i, c in enumerate(self.cols):
            own = self.table.filter(F.col("col") == i).select(F.col("value").alias(f"_v{i}"), F.col("at").cast("int").alias(f"_at{i}"))
            out = out.join(own, self.value(c) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        codes = [F.col(f"_at{i}") for i in range(len(self.cols))]
        found = F.array_compact(F.array(*codes)) if codes else F.array().cast("array<int>")
        return out.select(*map(quoted, df.columns), found.alias(name))


def category_dictionary(train: DataFrame, cols: Sequence[str], least: int = 1) -> Dictionary:
    """Counted before the shuffle, numbered in ranges; of each column only the most frequent category (ties: the smallest) goes to the driver.

    Categories of fewer than ``least`` training rows are treated as unknown ones.
    NULLs are none. A table without rows gives an empty dictionary.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("col"), quoted(c).cast("string").alias("value")) for i, c in enumerate(cols)))
    if not cols:
        raise ValueError("name a column")
    counts = train.select(F.inline(cells)).dropna().groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    numbered, size = numbered_rows(counts, ["col", "value"], "at")
    table = kept(numbered, "categories")
    top = table.groupBy("col").agg(F.min(F.struct(-F.col("n"), "value"))["value"].alias("value")).collect()  # one a column
    modes = {cols[r["col"]]: r["value"] for r in top}
    return Dictionary(list(cols), table, {c: modes.get(c) for c in cols}, size)


def sparse_features(df: DataFrame, prep: Preparation, dictionary: Dictionary, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns and a sparse vector ``features``, written once: prepared columns first, then categories by number.

    A vector has as many entries as there are prepared and categorical
    columns. The names of ``prep`` and the dictionary's order are those that
    ``prepare`` gives to columns of their own.
    """
    plain, d = prep.columns(), len(prep.names)
    rows = dictionary.look_up(df, "_codes")
    indices = F.concat(F.array(*map(F.lit, range(d))).cast("array<int>"), F.transform("_codes", lambda x: x + d))
    values = F.concat(F.array(*plain.values()).cast("array<double>"), F.array_repeat(F.lit(1.0), F.size("_codes")))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(d + dictionary.size).alias("size"), indices.alias("indices"), values.alias("values")).cast(_SPARSE)
    out = rows.select(*map(quoted, keep), vector.alias("features"))
    path = scratch_path(df.sparkSession, "sparse")
    out.write.parquet(path)
    schema = StructType([*out.schema.fields[:-1], StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def fit_sparse(rows: DataFrame, target: str, alpha: float, rounds: int = 1000) -> LinearRegressionModel:
    """Ridge over ``features`` by gradients summed in a tree; ``alpha`` weighs squared weights against squared errors, the intercept is free.

    For any number of categorical columns. Each round sends the weights to all
    tasks and sums a gradient of that length, 8 bytes a category.
    """
    own = rows.select("features", quoted(target).cast("double").alias("label")).dropna()
    n, spread = own.agg(F.count("label"), F.stddev_samp("label")).first()
    if not n:
        raise ValueError("no row has a target")
    # the estimator divides its penalty by the target's deviation
    est = LinearRegression(solver="l-bfgs", regParam=alpha * (spread or 1.0) / n, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=rounds)
    return est.fit(own)


@dataclass(frozen=True)
class Absorbed:
    """Weights of numeric columns, and a table ``value, n, effect`` with the weight of each category."""

    intercept: float
    coef: dict[str, float]
    category: str
    effects: DataFrame
    mode: str | None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``; a NULL category counts as the most frequent one, an unknown one adds nothing."""
        own = self.effects.select(F.col("value").alias("_v"), F.col("effect").alias("_effect"))
        both = df.join(own, F.coalesce(quoted(self.category).cast("string"), F.lit(self.mode)) == F.col("_v"), "left")
        line = F.lit(self.intercept)
        for c, w in self.coef.items():
            line = line + quoted(c).cast("double") * w
        return both.select(*map(quoted, df.columns), (line + F.coalesce("_effect", F.lit(0.0))).alias("y_pred"))


def _cells(rows: DataFrame, cols: Sequence[str]) -> list[DataFrame]:
    """By category, counts and means, and scatter sums of pairs of columns, some pairs in a table."""
    x = [F.col(c) for c in cols]
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = []
    for start in range(0, max(1, len(at)), PAIRS):
        some = at[start : start + PAIRS]
        scatter = [(F.covar_pop(x[i], x[j]) * F.count(F.lit(1))).alias(f"w{i}_{j}") for i, j in some]
        out.append(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(x)), *scatter))
    return out


def absorbed_sums(rows: DataFrame, cols: Sequence[str], alpha: float) -> np.ndarray:
    """Sums of products of (1, columns) with the categories' weights eliminated.

    With the category's mean m, its scatter W about m and n rows, the
    elimination leaves ``W + m m' n alpha / (n + alpha)``: a sum of positive
    terms, in which nothing cancels.
    """
    k = len(cols)
    g = np.zeros((k + 1, k + 1))
    share = F.col("n") * F.lit(float(alpha)) / (F.col("n") + F.lit(float(alpha)))
    mean = [F.lit(1.0), *(F.col(f"m{i}") for i in range(k))]
    for no, cells in enumerate(_cells(rows, cols)):
        aggs = {c: F.sum(quoted(c)) for c in cells.columns if c.startswith("w")}
        pairs = {c: tuple(int(v) for v in c[1:].split("_")) for c in aggs}
        aggs |= {f"b{i}_{j}": F.sum(mean[i + 1] * mean[j + 1] * share) for i, j in pairs.values()}
        if not no:
            aggs |= {f"o{i}": F.sum(mean[i] * share) for i in range(k + 1)}
        r = cells.agg(*(v.alias(c) for c, v in aggs.items())).first()
        for c, (i, j) in pairs.items():
            g[i + 1, j + 1] = g[j + 1, i + 1] = (r[c] or 0.0) + (r[f"b{i}_{j}"] or 0.0)
        if not no:
            g[0] = g[:, 0] = [r[f"o{i}"] or 0.0 for i in range(k + 1)]
    return g


def fit_absorbed(train: DataFrame, cols: Sequence[str], category: str, target: str, alphas: Sequence[float] = (1.0,)) -> Mapping[float, Absorbed]:
    """A ridge model for each penalty, with a weight for each category of one column, however many there are.

    Takes complete rows of ``cols`` and ``target``; a NULL category counts as
    the most frequent one (ties: the smallest). Weights of columns and of
    categories are penalised, the intercept is not. At a penalty of 0 the
    intercept is 0, categories take its place, and columns that are constant
    within every category have no weight: the fixed-effects regression.

    The rows are kept once, as narrow as the model. Each penalty is one grouped
    aggregate, with sums before the shuffle, so a hot category is a row from
    each task; weights of categories never leave the cluster.
    """
    if any(a < 0 for a in alphas):
        raise ValueError("a penalty is 0 at least")
    k = len(cols)
    plain = [f"_x{i}" for i in range(k + 1)]
    own = train.select(quoted(category).cast("string").alias("value"), *(quoted(c).cast("double").alias(p) for c, p in zip([*cols, target], plain, strict=True))).dropna(subset=plain)
    own = kept(own, "absorbed-rows")
    top = own.filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct(-F.col("n"), "value"))["value"]).first()
    mode = top[0] if top else None
    rows = own.withColumn("value", F.coalesce("value", F.lit(mode)))
    cells = kept(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *(F.avg(p).alias(p) for p in plain)), "absorbed-means")
    out = {}
    for alpha in alphas:
        g = absorbed_sums(rows, plain, alpha)
        free = slice(1 if alpha == 0 else 0, k + 1)  # nothing is left of the intercept at 0
        a = g[free, free] + alpha * np.diag([0.0] * (alpha != 0) + [1.0] * k)
        w = np.linalg.lstsq(a, g[free, -1], rcond=None)[0] if len(a) else np.zeros(0)
        b, coef = (0.0, w) if alpha == 0 else (float(w[0]), w[1:])
        rest = F.col(plain[-1]) - F.lit(b)
        for p, c in zip(plain[:-1], coef.tolist(), strict=True):
            rest = rest - F.col(p) * c
        effects = cells.select("value", "n", (rest * F.col("n") / (F.col("n") + F.lit(float(alpha)))).alias("effect"))
        out[alpha] = Absorbed(b, dict(zip(cols, coef.tolist(), strict=True)), category, effects, mode)
    return out


def center_effects(model: Absorbed) -> Absorbed:
    """With the mean effect over rows in the intercept, so that an unknown category counts as an average one."""
    mean = model.effects.agg(F.try_divide(F.sum(F.col("effect") * F.col("n")), F.sum("n"))).first()[0] or 0.0
    return Absorbed(model.intercept + mean, model.coef, model.category, model.effects.withColumn("effect", F.col("effect") - mean), model.mode)
