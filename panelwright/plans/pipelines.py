"""The three lifecycles: building the panel, experiments over time, search and interpretation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import row_mean
from ..operators.clean import clean_covariate_panel, clean_outcome_panel
from ..operators.explain import importance_table, linear_shap, partial_dependence, permutation_importance
from ..operators.features import model_frame
from ..operators.hot import ROWS, hot_entities
from ..operators.impute import impute_panel
from ..operators.joins import attach_nearest, key_coverage, merge_panels
from ..operators.linear import Linear
from ..operators.mlprep import is_train
from ..operators.models import compare, evaluate, train
from ..operators.reshape import wide_to_panel
from ..operators.schema import quoted
from ..operators.search import tune
from ..operators.selection import feature_sets
from ..operators.splits import equal_folds, overlap_split, time_split, train_val_test
from ..operators.stats import output_summary
from ..operators.trees import tree_shap
from ..operators.windows import lag_features
from ..sources.readers import SourceSpec, load_standardized
from ..sources.sinks import kept


def combine_targets(df: DataFrame, cols: Sequence[str], name: str = "outcome", strategy: str = "mean") -> DataFrame:
    """One outcome from several columns: the mean of the known ones, or the first known in order."""
    if strategy == "mean":
        return df.withColumn(name, row_mean(*cols))
    if strategy == "first_non_null":
        return df.withColumn(name, F.coalesce(*map(quoted, cols)))
    raise ValueError("strategy is mean or first_non_null")


@dataclass(frozen=True)
class PanelOptions:
    """Choices of ``build_panel``; defaults are those of a country x year panel."""

    entity: str = "country"
    time: str = "year"
    targets: tuple[str, ...] = ("outcome_a", "outcome_b")
    target: str = "outcome"
    strategy: str = "mean"
    how: str = "inner"
    validate: str = "one_to_one"
    suffixes: tuple[str, str] = ("_a", "_b")
    outcome: Mapping[str, Any] = field(default_factory=dict)
    covariates: Mapping[str, Any] = field(default_factory=dict)
    impute: Mapping[str, Any] = field(default_factory=dict)
    hot_rows: int = ROWS


def build_panel(outcome: DataFrame, covariates: DataFrame, o: PanelOptions) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Clean both sources, merge them, make the outcome, impute. Summaries are frames; none is read unless asked for.

    The cleaned sources and the merged panel are written once, as all that
    follows reads them more than once; keys are checked in the exchange of the
    merge. Entities with more than ``hot_rows`` rows are cut into ranges of time.
    """
    left, left_summary = clean_outcome_panel(outcome, **{"target": o.targets[0], "entity": o.entity, "time": o.time} | dict(o.outcome))
    left = kept(left, "panel-outcome")
    cols = o.covariates.get("cols") or [c for c in covariates.columns if c not in (o.entity, o.time)]
    right, right_summary = clean_covariate_panel(covariates, **{"cols": cols, "entity": o.entity, "time": o.time} | {k: v for k, v in o.covariates.items() if k != "cols"})
    right = kept(right, "panel-covariates")
    merged = merge_panels(left, right, [o.entity, o.time], o.how, o.validate, o.suffixes)
    panel = kept(combine_targets(merged, [c for c in o.targets if c in merged.columns], o.target, o.strategy), "panel-merged")
    filled, impute_summary = impute_panel(panel, o.entity, o.time, o.target, hot=hot_entities(panel, o.entity, o.time, o.hot_rows), **o.impute)
    summaries = {"outcome": left_summary, "covariates": right_summary, "keys": key_coverage(left, right, [o.entity, o.time]), "impute": impute_summary, "panel": output_summary(filled, o.time)}
    return filled, summaries


def preprocess(spark: SparkSession, sources: Mapping[str, SourceSpec], options: PanelOptions, outcome: str = "outcome", covariates: str = "covariates") -> tuple[DataFrame, dict[str, DataFrame]]:
    """From files to the panel."""
    frames, counts = load_standardized(spark, dict(sources))
    panel, summaries = build_panel(frames[outcome], frames[covariates], options)
    return panel, summaries | {"sources": counts}


def indicator_experiment(panel: DataFrame, wide: DataFrame, codes: Sequence[str], target: str, models: Sequence[str], metadata: Sequence[str] = (), lags: Sequence[int] = (1,), entity: str = "country", time: str = "year", prefix: str = "ind_") -> tuple[DataFrame, DataFrame]:
    """Pivot indicators, carry metadata of the panel to them, add lags, split on common years, compare models.

    The labelled frame, and result rows. Train, val and test come from the years both tables have.
    """
    indicators = wide_to_panel(wide, codes, entity=entity, prefix=prefix)
    joined = attach_nearest(indicators, panel, entity, time, list(metadata), restrict=True) if metadata else indicators
    both = joined.join(panel.select(entity, time, target), [entity, time], "left")
    features = [prefix + c for c in codes]
    lagged = lag_features(both, entity, time, [target, *features], lags)
    own = [*features, *(f"{c}_lag{k}" for c in [target, *features] for k in lags)]
    labelled = overlap_split(lagged.filter(quoted(target).isNotNull()), panel, time)[0]
    return labelled, compare(labelled, models, {"indicators": own}, target, [entity, time])


def time_experiment(frame: DataFrame, target: str, key: Sequence[str], time: str, models: Sequence[str], test_times: int = 3, val_times: int = 0, sets: Mapping[str, Sequence[str]] | None = None, options: Mapping[str, Mapping[str, Any]] | None = None, **selection: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature sets on the training rows, a split by time, every model on every set: labelled frame, sets, results."""
    labelled = train_val_test(frame, time, val_times, test_times, target)[0] if val_times else time_split(frame, time, test_times, target)[0]
    if sets is None:
        sets, table = feature_sets(model_frame(labelled.filter(is_train()).drop("split"), target, keep=key), target, key, **selection)
    else:
        table = frame.sparkSession.createDataFrame([("set", n, i, c) for n, own in sets.items() for i, c in enumerate(own)], "kind string, name string, place int, feature string")
    return labelled, table, compare(labelled, models, sets, target, key, options, ("val", "test") if val_times else ("test",))


def tune_and_explain(labelled: DataFrame, model: str, candidates: Sequence[Mapping[str, Any]], features: Sequence[str], target: str, key: Sequence[str], folds: int = 3, seed: int = 42) -> dict[str, DataFrame]:
    """Search on training rows, default against tuned on test rows, importances and effects of the tuned model."""
    own = equal_folds(labelled.filter(is_train()), key, folds, seed).unionByName(labelled.filter(~is_train()).withColumn("fold", F.lit(None).cast("int")))
    fitted, table, variants = tune(own, model, candidates, features, target, key, F.col("fold"), folds)
    test = fitted.prep.apply(labelled.filter("split = 'test'"), [*key, target])
    names = fitted.prep.names
    permuted = permutation_importance(fitted.model, test, names, target, key, repeats=3)
    shap = linear_shap(fitted.model, test, names) if isinstance(fitted.model, Linear) else tree_shap(fitted.model, test)
    effects = [partial_dependence(fitted.model, test, r["feature"], names) for r in permuted.limit(2).collect()]  # two rows
    both = effects[0]
    for e in effects[1:]:
        both = both.unionByName(e)
    return {"search": table, "variants": variants, "permutation": permuted, "shap": shap, "effects": both, "coefficients": importance_table(labelled, {model: fitted.model})}


def seed_stability(labelled: DataFrame, model: str, features: Sequence[str], target: str, key: Sequence[str], seeds: Sequence[int], **params: Any) -> DataFrame:
    """Mean and deviation over seeds of each feature's importance, and of the error on test rows."""
    rows, errors = [], []
    for s in seeds:
        fitted = train(labelled, model, features, target, key, seed=s, **params)
        rows += [(s, f, float(v)) for f, v in fitted.model.importances().items()]
        errors.append(evaluate(fitted.predict(labelled.filter("split = 'test'"), target, key), {"seed": s}))
    table = labelled.sparkSession.createDataFrame(rows, "seed int, feature string, importance double")
    per = table.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev("importance").alias("std"), F.count(F.lit(1)).alias("n"))
    rmse = errors[0]
    for e in errors[1:]:
        rmse = rmse.unionByName(e)
    return per.unionByName(rmse.agg(F.lit("(rmse)").alias("feature"), F.avg("rmse").alias("mean"), F.stddev("rmse").alias("std"), F.count(F.lit(1)).alias("n"))).orderBy("feature")
