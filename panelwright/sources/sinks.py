"""Sinks: tables as CSV or Parquet, one-row summaries as JSON, a growing run log, and reuse of built panels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.utils import AnalysisException


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); it goes when the driver ends.

    Where the setting is absent the session has to be a local one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read back: what stands before is not run again, whatever is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite ``path``; ``partition_by`` columns become folders, so that later reads prune."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt is parquet or csv")
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _row(values: Mapping[str, Any]) -> Row:
    return Row(**{k: _row(v) if isinstance(v, Mapping) else v for k, v in values.items()})


def write_summary(spark: SparkSession, values: Mapping[str, Any] | DataFrame, path: str) -> None:
    """A nested mapping, or a frame of a few rows, as JSON lines."""
    df = values if isinstance(values, DataFrame) else spark.createDataFrame([_row(values)])
    df.coalesce(1).write.mode("overwrite").json(path)


def append_run(result: DataFrame, path: str) -> None:
    """Add rows to a run log; new columns may come with any of them."""
    result.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log with all columns that any row has."""
    return spark.read.option("mergeSchema", True).parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, or what ``build`` makes, written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        write_table(build(), path)
        return spark.read.parquet(path)
