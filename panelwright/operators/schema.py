"""Names, types and column choice. No job runs here but for the numeric check of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, trimmed, year


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def clean_name(name: str) -> str:
    """Lower snake case; ``%`` reads percent and ``&`` reads and."""
    text = name.strip().lower().replace("%", " percent ").replace("&", " and ")
    return re.sub(r"[^0-9a-z]+", "_", text).strip("_")


def require_columns(df: DataFrame, cols: Iterable[str], name: str = "frame") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"{name} has no column {', '.join(missing)}")


def rename_clean(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Clean all names, then apply ``renames``. Two columns that would get one name raise."""
    names = [(renames or {}).get(n, n) for n in map(clean_name, df.columns)]
    if len(set(names)) < len(names):
        raise ValueError(f"names collide: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    return df.select(*(quoted(c).alias(n) for c, n in zip(df.columns, names, strict=True)))


def standardize_panel(df: DataFrame, entity_col: str, time_col: str, renames: Mapping[str, str] | None = None, entity: str = "country", time: str = "year") -> DataFrame:
    """Keys renamed to ``entity`` and ``time``, trimmed and cast; all other names cleaned, then renamed."""
    require_columns(df, [entity_col, time_col])
    df = rename_clean(df, {clean_name(entity_col): entity, clean_name(time_col): time} | dict(renames or {}))
    texts = {c for c, t in df.dtypes if t == "string"} - {time}
    return df.select(*(trimmed(quoted(c)).alias(c) if c in texts else year(quoted(c)).alias(c) if c == time else quoted(c) for c in df.columns))


def standardize_wide(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """A table wide by time: columns without a name go, ids are renamed and trimmed, time columns stay."""
    ids = {"Country Name": "country", "Country Code": "country_code", "Indicator Name": "indicator_name", "Indicator Code": "indicator_code"} | dict(renames or {})
    kept = [c for c in df.columns if not re.match("Unnamed", c)]
    return df.select(*(trimmed(quoted(c)).alias(ids[c]) if c in ids else quoted(c) for c in kept))


def standardize_source(df: DataFrame, loader: str, entity_col: str | None, time_col: str | None, renames: Mapping[str, str] | None = None) -> DataFrame:
    if loader == "preamble-csv":
        return standardize_wide(df, renames)
    if entity_col is None or time_col is None:
        raise ValueError("a panel source names its entity and time columns")
    return standardize_panel(df, entity_col, time_col, renames)


def prepare_keys(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Key columns trimmed and cast, ready for a join."""
    require_columns(df, [entity, time])
    return df.withColumns({entity: trimmed(entity), time: year(time)})


def strict_year(df: DataFrame, time: str) -> DataFrame:
    """Cast ``time``; rows that cannot be cast raise when the frame is read, with no pass of its own."""
    cast = year(time)
    text = F.concat(F.lit(f"{time} is no whole number: "), F.coalesce(quoted(time).cast("string"), F.lit("NULL")))
    return df.withColumn(time, F.when(cast.isNotNull(), cast).otherwise(F.raise_error(text).cast("bigint")))


def pick(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Ids and those of ``cols`` that there are; the ones that there are not."""
    require_columns(df, ids)
    wanted = list(dict.fromkeys([*ids, *cols]))
    return df.select(*(quoted(c) for c in wanted if c in df.columns)), [c for c in cols if c not in df.columns]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BooleanType) and f.name not in skip]


def numeric_text(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Text columns in which any value is a number become numbers; one pass over all of them decides."""
    skip = set(exclude)
    texts = [c for c, t in df.dtypes if t == "string" and c not in skip]
    if not texts:
        return df, []
    found = df.agg(*(F.count(number(quoted(c))).alias(c) for c in texts)).first()
    changed = [c for c in texts if found[c]]
    return df.withColumns({c: number(quoted(c)) for c in changed}), changed


def prefix_columns(df: DataFrame, prefix: str, keys: Iterable[str]) -> DataFrame:
    skip = set(keys)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in skip})


def time_columns(df: DataFrame, low: int = 1950, high: int = 2050) -> list[str]:
    """Columns whose names are years."""
    return [c for c in df.columns if re.fullmatch(r"\d{4}", c.strip()) and low <= int(c) <= high]


def keyword_columns(df: DataFrame, words: Iterable[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def collect_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Required columns, which there must be, then the optional ones there are; each once."""
    require_columns(df, required)
    return list(dict.fromkeys([*required, *(c for c in optional if c in df.columns)]))


def infer_target(df: DataFrame, candidates: Sequence[str]) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {', '.join(candidates)} is a column")


def split_target(df: DataFrame, target: str, exclude: Iterable[str] = ()) -> tuple[list[str], str]:
    """Names of the predictors, and of the target, which stays in the frame beside them."""
    require_columns(df, [target])
    skip = {target, *exclude}
    return [c for c in df.columns if c not in skip], target
