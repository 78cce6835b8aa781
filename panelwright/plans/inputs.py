"""Panels derived from the given tables; the queries run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..operators.joins import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with segment, nation and region: the metadata of the customer-year panel."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    own = c.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), "c_nationkey", F.col("c_acctbal").alias("acctbal"))
    return own.join(places, own["c_nationkey"] == places["n_nationkey"]).select("custkey", "segment", "nation", "region", "acctbal")


def orders_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n_orders"))


def customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year: mean price, number of orders, metadata. Orders are summed before anything is joined."""
    return attach(orders_by_year(spark, sf_dir), customers(spark, sf_dir), ["custkey"])


def shipped_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x year of shipping: revenue and mean quantity; a line that is there twice counts once."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    single = keep_first(line, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_quantity", "l_extendedprice", "l_discount"])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = single.join(o, single["l_orderkey"] == o["o_orderkey"])
    return both.groupBy(F.col("o_custkey").alias("custkey"), F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_quantity").alias("quantity"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day without gaps: mean value and number of events, NULL where there was none."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    daily = e.groupBy("user_id", "day").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_events"))
    ends = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = daily.select("user_id").distinct().crossJoin(F.broadcast(ends)).select("user_id", F.explode(F.sequence("first", "last")).alias("day"))  # one row
    return grid.join(daily, ["user_id", "day"], "left")


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and event type by day of the month, as columns named like years 2001..2031."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.dayofmonth("ts") + 2000).alias("day"), "value")
    return e.groupBy("user_id", "event_type").pivot("day", list(range(2001, 2032))).agg(F.avg("value"))
