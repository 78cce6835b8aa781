"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that splits words and is stripped from lines: 0x09-0x0D and the blank.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent the session has to be a local one (tests), and
    a temporary folder of this machine is set as its checkpoint folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder, read it back.

    Lost executors cost no recomputation of what stands before. The folder
    goes when the driver's JVM ends, or with ``free``. ``options`` are the
    writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = at
    return out


def free(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these frames, once everything that reads it has been written itself."""
    for df in tables:
        at = df.written_at
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of keys in which NULL equals NULL."""
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right[k])
    return test


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a NULL id, which is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def row_key(df: DataFrame, *columns: str) -> Column:
    """64-bit hash of a row's values; never NULL, and alike for alike rows. Maps have no hash and are left out."""
    return F.xxhash64(*(F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns if df.schema[c].dataType.typeName() != "map"))


def finite(vector: str) -> Column:
    """Whether no component of an array is NULL, NaN or infinite."""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


#: Bits of a limb: those of a million tasks add up in 64 bits.
LIMB = 40


def limbs(totals: np.ndarray, name: str) -> pa.RecordBatch:
    """A task's exact sums, rows of Python integers, as rows ``name, limb, parts`` of 64-bit integers; rows of zeros are left out."""
    out: list[tuple[int, int, list[int]]] = []
    for i, row in enumerate(totals.tolist()):
        left, limb = row, 0
        while any(left):
            out.append((i, limb, [(abs(v) & (1 << LIMB) - 1) * (1 if v >= 0 else -1) for v in left]))
            left, limb = [(abs(v) >> LIMB) * (1 if v >= 0 else -1) for v in left], limb + 1
    cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays(cols, [name, "limb", "parts"])


def joined(parts: DataFrame, name: str, rows: int, width: int) -> list[list[int]]:
    """The sums of all tasks' ``limbs``, ``rows`` x ``width`` Python integers; Spark adds, the driver gets the sums alone."""
    found = parts.select(name, "limb", F.posexplode("parts").alias("at", "part")).groupBy(name, "limb", "at").agg(F.sum("part").alias("part"))
    out = [[0] * width for _ in range(rows)]
    for r in found.filter("part != 0").collect():
        out[r[name]][r["at"]] += r["part"] << LIMB * r["limb"]
    return out
