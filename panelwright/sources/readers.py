"""Readers of raw sources. Every column is read as text; casts are explicit afterwards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import known_text
from ..operators.schema import standardize_source
from .records import Layout, layout, read_records

#: Columns that a preamble file has in its header line (fixed values).
ID_HEADER = ("Country Name", "Country Code", "Indicator Name", "Indicator Code")

#: Blank lines that may stand before a plain file's header.
LEADING = 64


@dataclass(frozen=True)
class SourceSpec:
    """Where a source is and how it is brought to the panel's names."""

    path: str
    loader: str = "csv"
    entity_col: str | None = None
    time_col: str | None = None
    renames: dict[str, str] = field(default_factory=dict)


def _known(df: DataFrame) -> DataFrame:
    return df.select(*(known_text(F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of them, each with a header; all columns text, missing-value words as NULL.

    Quoted cells may hold commas, doubled quotes and line breaks; a file is
    read in many tasks all the same. A missing path raises.
    """
    found = layout(spark, path, within=1 + LEADING)
    if found is None:
        raise ValueError(f"{path}: no header")
    return _known(read_records(spark, path, found))


def read_preamble_csv(spark: SparkSession, path: str, id_header: tuple[str, ...] = ID_HEADER, preamble: int = 4) -> DataFrame:
    """A CSV file that may have ``preamble`` lines before its header.

    The first lines are looked at; the header is the record with all id columns
    that starts in one of them. What stands before the first record is dropped
    by its place. Cells are read as in ``read_csv``.
    """
    found = layout(spark, path, lambda cells: set(id_header) <= {c.strip() for c in cells}, preamble + 2)
    if found is None:
        raise ValueError(f"{path}: no header with {', '.join(id_header)} in the first {preamble + 2} lines")
    return _known(read_records(spark, path, Layout(tuple(c.strip() for c in found.names), found.skip)))


#: Readers by name of the format.
LOADERS = {"csv": read_csv, "preamble-csv": read_preamble_csv, "parquet": lambda spark, path: spark.read.parquet(path)}


def load_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.loader not in LOADERS:
        raise ValueError(f"unknown loader {spec.loader!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[spec.loader](spark, spec.path)


def load_standardized(spark: SparkSession, specs: dict[str, SourceSpec]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All sources with the panel's names, and a row for each with its numbers of rows and columns (one aggregate a source)."""
    frames = {name: standardize_source(load_source(spark, s), s.loader, s.entity_col, s.time_col, s.renames) for name, s in specs.items()}
    counts = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).alias("cols"))
        counts = row if counts is None else counts.unionByName(row)
    return frames, counts
