"""Upkeep of a panel from a stream with the same expressions that clean a batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import finite, within
from ..operators.schema import quoted


def repair(events: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Row-wise: NaN, infinite and out-of-range values become NULL. For batches and streams alike."""
    return events.withColumns({c: F.when(within(finite(quoted(c)), low, high), finite(quoted(c))) for c, (low, high) in bounds.items()})


def panel_updates(events: DataFrame, entity: str, ts: str, value: str, step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums and counts by entity and time step; rows later than ``late`` are left out, and state ends with them."""
    stamped = events.withWatermark(ts, late)
    out = stamped.groupBy(quoted(entity), F.window(quoted(ts), step)).agg(F.sum(quoted(value)).alias("total"), F.count(quoted(value)).alias("n_values"), F.count(F.lit(1)).alias("n_events"))
    return out.select(quoted(entity), F.col("window.start").alias("time"), "total", "n_values", "n_events")


def write_panel(updates: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append closed time steps to Parquet; the checkpoint makes a restart go on where it was."""
    writer = updates.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start()


def read_panel(updates: DataFrame, entity: str) -> DataFrame:
    """The panel of means; steps without a known value are NULL."""
    return updates.select(quoted(entity), "time", F.try_divide("total", "n_values").alias("value"), "n_events")
