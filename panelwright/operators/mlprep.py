"""Preparation of model inputs: everything is fitted on training rows, in two aggregates, and applied as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .schema import categorical_columns, numeric_columns, quoted

SCALES = ("standard", "robust", "none")
#: Categories of a column that may each become a column.
DENSE = 2000


def is_train() -> Column:
    return F.col("split") == "train"


@dataclass(frozen=True)
class Preparation:
    """Fitted numbers: medians, centres and widths of numeric columns, modes and categories of the others."""

    numeric: list[str]
    medians: dict[str, float]
    centres: dict[str, float]
    widths: dict[str, float]
    indicators: list[str] = field(default_factory=list)
    modes: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Of the columns that come out, in order."""
        return [*self.numeric, *(f"{c}_missing" for c in self.indicators), *(f"{c}={v}" for c, own in self.categories.items() for v in own)]

    def columns(self) -> dict[str, Column]:
        out = {c: (F.coalesce(quoted(c).cast("double"), F.lit(self.medians[c])) - self.centres[c]) / self.widths[c] for c in self.numeric}
        out |= {f"{c}_missing": F.isnull(quoted(c)).cast("double") for c in self.indicators}
        for c, own in self.categories.items():
            value = F.coalesce(quoted(c).cast("string"), F.lit(self.modes[c]))
            out |= {f"{c}={v}": (value == v).cast("double") for v in own}  # unknown: all zero
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*map(quoted, keep), *(x.alias(n) for n, x in self.columns().items()))

    def assembled(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Kept columns and one vector ``features``."""
        out = self.apply(df, keep)
        plain = {n: f"_f{i}" for i, n in enumerate(self.names)}
        out = out.select(*map(quoted, keep), *(quoted(n).alias(p) for n, p in plain.items()))
        return VectorAssembler(inputCols=list(plain.values()), outputCol="features").transform(out).drop(*plain.values())


def prepare(train: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] = (), scale: str = "standard", indicators: bool = False, exclude: Sequence[str] = (), max_categories: int | None = None) -> Preparation:
    """Fit on the rows of ``train``.

    NULLs become medians, or the most frequent category (ties: the smallest).
    "standard" divides by the population deviation, "robust" by the
    interquartile range around the median; a width of 0 counts as 1.
    Indicators are made for columns with NULLs in the training rows. Every
    category gets a column of its own, or only the ``max_categories`` most
    frequent ones of a column. Without that number a column of more than
    ``DENSE`` categories is an error; ``categories`` takes any number.
    """
    if scale not in SCALES:
        raise ValueError(f"scale is one of {', '.join(SCALES)}")
    numeric = list(numeric if numeric is not None else numeric_columns(train, exclude))
    known = {c: quoted(c).cast("double") for c in numeric}
    medians = {c: v[0] if v[0] is not None else 0.0 for c, v in exact_quantiles(train, known, (0.5,)).items()}
    moments = [x for i, c in enumerate(numeric) for x in (F.count_if(F.isnull(known[c])).alias(f"z{i}"), F.count(known[c]).alias(f"n{i}"), F.avg(known[c]).alias(f"a{i}"), F.var_pop(known[c]).alias(f"v{i}"))]
    row = train.agg(*moments).first() if numeric else None
    centres, widths = dict.fromkeys(numeric, 0.0), dict.fromkeys(numeric, 1.0)
    if scale == "standard":
        for i, c in enumerate(numeric):  # moments of the filled column, from those of the known values
            z, n, mean, var = (row[f"{k}{i}"] or 0.0 for k in "znav")
            centres[c] = (n * mean + z * medians[c]) / (n + z) if n + z else 0.0
            spread = n * (var + (mean - centres[c]) ** 2) + z * (medians[c] - centres[c]) ** 2
            widths[c] = (spread / (n + z)) ** 0.5 or 1.0 if n + z else 1.0
    elif scale == "robust":
        for c, (low, middle, high) in exact_quantiles(train, {c: F.coalesce(x, F.lit(medians[c])) for c, x in known.items()}, (0.25, 0.5, 0.75)).items():
            centres[c], widths[c] = middle or 0.0, ((high or 0.0) - (low or 0.0)) or 1.0
    flagged = [c for i, c in enumerate(numeric) if indicators and row[f"z{i}"]]
    modes, categories = {}, {}
    if categorical:
        texts = train.select(*(quoted(c).cast("string").alias(c) for c in categorical)).unpivot([], [quoted(c) for c in categorical], "col", "value").dropna()
        counts = texts.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "value"))  # cut to the first ones before the shuffle
        top = counts.withColumn("place", place).filter(F.col("place") <= (DENSE + 1 if max_categories is None else max_categories))
        for r in top.orderBy("col", "place").collect():  # the categories, each of which becomes a column
            modes.setdefault(r["col"], r["value"])
            categories.setdefault(r["col"], []).append(r["value"])
        if max_categories is None and (wide := [c for c, own in categories.items() if len(own) > DENSE]):
            raise ValueError(f"more than {DENSE} categories in {', '.join(wide)}: give max_categories, or take categories.sparse_features")
        categories = {c: sorted(own) for c, own in categories.items()}
        categories = {c: categories.get(c, []) for c in categorical}
        modes = {c: modes.get(c, "") for c in categorical}
    return Preparation(numeric, medians, centres, widths, flagged, modes, categories)


def feature_types(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical predictors by type."""
    return numeric_columns(df, exclude), categorical_columns(df, exclude)


def scale_sequences(df: DataFrame, size: int) -> DataFrame:
    """Standardise each feature of ``sequence`` with mean and deviation over all steps of the training rows.

    Statistics are a table of ``size`` rows, made from one explode of training rows.
    """
    steps = df.filter(is_train()).select(F.explode("sequence").alias("s")).select(F.posexplode("s").alias("at", "v"))
    stats = steps.groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("w"))
    row = stats.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("m", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w"))))).alias("_stats"))
    both = df.crossJoin(F.broadcast(row))  # one row with ``size`` entries
    scaled = F.transform("sequence", lambda s: F.transform(s, lambda v, i: (v - F.element_at("_stats", i)["m"]) / F.element_at("_stats", i)["w"]))
    return both.withColumn("sequence", scaled).drop("_stats")
