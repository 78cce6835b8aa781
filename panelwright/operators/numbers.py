"""Dense row numbers without a sort of all rows in one task, and random orders of them without any sort."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .schema import quoted

#: Rounds of the network, and walks of a number that falls outside; the part that does is below two by the root of their count.
ROUNDS, WALKS = 4, 64


def numbered_rows(df: DataFrame, key: Sequence[str] = (), name: str = "_no") -> tuple[DataFrame, int]:
    """Rows with numbers from 0 in order of ``key`` (in no order without one), written once, and how many there are.

    Ranges of the key are sorted each on its own; a range's rows are numbered
    as they are written, and sums of ranges' sizes put the numbers together.
    """
    if key:
        df = df.repartitionByRange(*map(quoted, key)).sortWithinPartitions(*map(quoted, key))
    own = kept(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    sizes = kept(sizes.withColumn("_ahead", ahead), "ranges")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    return own.join(sizes.select("_part", "_ahead"), part == F.col("_part")).withColumn(name, F.col("_ahead") + inside).drop("_at", "_part", "_ahead"), n


def shuffled(number: Column, n: int, *keys: Column) -> Column:
    """A random permutation of 0..n-1, another one for each value of ``keys``, as an expression of the number alone.

    A network of four rounds permutes the next square; numbers that fall
    outside go through it again until they are inside.
    """
    a = isqrt(max(0, n - 1)) + 1

    def mixed(i: Column, r: Column) -> Column:
        text = F.concat_ws(":", *(k.cast("string") for k in keys), i.cast("string"), r.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / a).cast("long").alias("l"), (x % a).cast("long").alias("r"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.struct(s["r"].alias("l"), ((s["l"] + mixed(i, s["r"])) % a).alias("r")))
        return F.transform(F.array(end), lambda s: s["l"] * a + s["r"])[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
