"""Windows over entities that have too many rows for one task.

Such an entity is cut into ranges of time. Windows run inside a range; what
they need from beyond its edges is carried: row numbers by sums of ranges'
sizes, the nearest known values by a scan over one row a range, and the last k
rows before a range as copies that are dropped afterwards. Entities that are
not hot are one range, so one plan serves all.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .schema import quoted

#: Rows of an entity that one task sorts, and how many cuts are joined to a row at once.
ROWS, STEP = 5_000_000, 128

CHUNK, NO, HOME = "_chunk", "_no", "_home"


def _below(cuts: str, time: Column) -> Column:
    """How many of the sorted cuts, fewer than ``STEP``, are below the time; found by halves."""
    halves = F.array(*(F.lit(1 << i) for i in reversed(range((STEP - 1).bit_length()))))
    return F.aggregate(halves, F.lit(0), lambda at, n: F.when(F.get(F.col(cuts), at + n - 1) < time, at + n).otherwise(at))


@dataclass(frozen=True)
class Hot:
    """Entities with too many rows, and the times at which each is cut."""

    entity: str
    time: str
    cuts: DataFrame

    def split(self, df: DataFrame) -> DataFrame:
        """Adds the number of the row's range; rows of one time are in one range.

        Each ``STEP``-th cut is looked through first, then those up to the next
        of these, so a row neither carries nor reads all cuts of its entity.
        """
        every = F.size("cuts") / F.lit(STEP)
        coarse = self.cuts.filter("cuts IS NOT NULL").select(F.col("entity").alias("_hot"), F.expr(f"filter(cuts, (x, i) -> (i + 1) % {STEP} = 0)").alias("_coarse"))
        fine = self.cuts.filter("cuts IS NOT NULL").select(F.col("entity").alias("_own"), F.explode(F.sequence(F.lit(0), F.floor(every).cast("int"))).alias("_at"), "cuts")
        fine = fine.select("_own", "_at", F.slice("cuts", F.col("_at") * STEP + 1, STEP - 1).alias("_fine"))
        rows = df.join(coarse, quoted(self.entity).eqNullSafe(F.col("_hot")), "left").withColumn("_group", _below("_coarse", quoted(self.time)))
        rows = rows.join(fine, quoted(self.entity).eqNullSafe(F.col("_own")) & (F.col("_group") == F.col("_at")), "left")
        return rows.withColumn(CHUNK, F.coalesce(F.col("_at") * STEP + _below("_fine", quoted(self.time)), F.lit(0))).drop("_hot", "_coarse", "_own", "_at", "_fine", "_group")

    def inside(self) -> WindowSpec:
        return Window.partitionBy(quoted(self.entity), CHUNK).orderBy(quoted(self.time))

    def numbered(self, df: DataFrame, ahead: int = 0) -> DataFrame:
        """Adds the range, the row's number within its entity from 1, and, for ``ahead`` rows, which ranges soon after need this row."""
        rows = kept(self.split(df), "hot-rows")
        order = Window.partitionBy("_e").orderBy("_c")  # one row a range
        sizes = rows.groupBy(quoted(self.entity).alias("_e"), F.col(CHUNK).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if ahead:
            sizes = sizes.withColumn("_next", F.collect_list(F.struct("_c", "_offset")).over(order.rowsBetween(1, ahead)))
        own = rows.withColumn(NO, F.row_number().over(self.inside()))
        both = own.join(sizes.drop("_n"), quoted(self.entity).eqNullSafe(F.col("_e")) & (F.col(CHUNK) == F.col("_c"))).drop("_e", "_c")
        return both.withColumn(NO, F.col("_offset") + F.col(NO)).drop("_offset")

    def with_rows_before(self, df: DataFrame, k: int) -> tuple[DataFrame, WindowSpec]:
        """Numbered rows and, before each range, copies of the ``k`` rows that stand there; and the window over a range.

        Rows that are not copies have ``_home``. Every row before a range that
        is needed there is among the last k of its own range, and no more than
        the k next ranges can need it.
        """
        rows = self.numbered(df, k)
        needed = F.filter("_next", lambda x: F.col(NO) > x["_offset"] - k)
        copies = rows.select(*(quoted(c) for c in df.columns), NO, F.inline(needed)).select(*(quoted(c) for c in df.columns), NO, F.col("_c").alias(CHUNK), F.lit(False).alias(HOME))
        both = rows.select(*(quoted(c) for c in df.columns), NO, CHUNK, F.lit(True).alias(HOME)).unionByName(copies)
        return both, Window.partitionBy(quoted(self.entity), CHUNK).orderBy(NO)

    def with_edges(self, numbered: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        """Adds ``_before_name`` and ``_after_name``: structs ``n, v`` of the nearest rows beyond the range in which a value is known."""
        known = {k: F.when(v.isNotNull(), F.struct(F.col(NO).alias("n"), v.alias("v"))) for k, v in values.items()}
        edges = numbered.groupBy(quoted(self.entity).alias("_e"), F.col(CHUNK).alias("_c")).agg(*(x for k, v in known.items() for x in (F.max(v).alias(f"_last_{k}"), F.min(v).alias(f"_first_{k}"))))
        ranges = Window.partitionBy("_e")  # one row a range
        back, on = (ranges.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_c"), F.desc("_c")))
        edges = edges.select("_e", "_c", *(x for k in known for x in (F.last(f"_last_{k}", True).over(back).alias(f"_before_{k}"), F.last(f"_first_{k}", True).over(on).alias(f"_after_{k}"))))
        return numbered.join(edges, quoted(self.entity).eqNullSafe(F.col("_e")) & (F.col(CHUNK) == F.col("_c"))).drop("_e", "_c")


def hot_entities(df: DataFrame, entity: str, time: str, rows: int = ROWS) -> Hot | None:
    """The entities with more than ``rows`` rows, cut into ranges of about half as many; None if there are none.

    One aggregate, and a second one over the hot entities only. Rows without an
    entity count as one. A range cannot be shorter than one time.
    """
    sizes = df.groupBy(quoted(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    sizes = kept(sizes, "hot-entities")  # fewer than one for each ``rows`` rows
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return None
    parts = min(10_000, ceil(2 * most / rows))
    own = df.select(quoted(entity).alias("entity"), quoted(time).alias("time"))
    own = own.join(sizes.select(F.col("entity").alias("_e")), F.col("entity").eqNullSafe(F.col("_e")), "left_semi")
    cuts = own.groupBy("entity").agg(F.array_distinct(F.approx_percentile("time", F.lit(np.arange(1, parts) / parts), 10_000)).alias("cuts"))
    return Hot(entity, time, kept(cuts, "hot-cuts"))
