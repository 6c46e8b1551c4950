"""Reading the given Parquet tables, and the price panels that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.plans.panel import between, densify, subset

PRICE_BASE, PRICE_SCALE = 100.0, 50_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, assets: list[str] | None = None) -> DataFrame:
    """Weekly bars of order prices, one asset per order priority: a partial aggregate per week and priority is all that is shuffled.

    start and end (Mondays or other days) and assets are filters of the scan: a week is in where its Monday is.
    """
    orders = table(spark, sf_dir, "orders")
    if start:
        first = F.date_trunc("week", F.date_add(F.lit(start).cast("date"), 6))
        orders = orders.where(F.col("o_orderdate") >= first)
    if end:
        orders = orders.where(F.col("o_orderdate") < F.date_add(F.date_trunc("week", F.lit(end).cast("date")), 7))
    if assets:
        orders = orders.where(F.col("o_orderpriority").isin(*assets))
    o = orders.select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"),
        F.col("o_orderpriority").alias("asset"),
        "o_orderkey",
        (F.lit(PRICE_BASE) + F.col("o_totalprice") / F.lit(PRICE_SCALE)).alias("px"),
    )
    return o.groupBy("date", "asset").agg(
        F.min_by("px", "o_orderkey").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def order_panel(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, assets: list[str] | None = None) -> DataFrame:
    """The dense weekly panel: every week for every priority, NULL where there was no order; from start to end and for some assets only, if they are given.

    A part has the weeks and the assets that the whole panel has there: they are read from their own columns alone.
    """
    if not (start or end or assets):
        return densify(order_bars(spark, sf_dir))
    orders = table(spark, sf_dir, "orders")
    dates = between(orders.select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).distinct(), start, end)
    known = orders.select(F.col("o_orderpriority").alias("asset"))
    return densify(order_bars(spark, sf_dir, start, end, assets), dates, subset(known, assets) if assets else known)


def supplier_panel(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"), carried: tuple[str, ...] = ()) -> DataFrame:
    """Every ship date for every supplier, with bars of unit prices: assets grow with the table. Of the fields only those named are made."""
    li = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("string").alias("asset"),
        (F.lit(PRICE_BASE) + F.col("l_extendedprice") / F.col("l_quantity") / 50.0).alias("px"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )
    made = {"open": F.min_by("px", "k"), "high": F.max("px"), "low": F.min("px"), "close": F.max_by("px", "k"), "volume": F.count("*").cast("double")}
    return densify(li.groupBy("date", "asset").agg(*[made[f].alias(f) for f in fields]), carried=carried)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values per event type."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("asset"), "event_id", "value")
    return e.groupBy("ts", "asset").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
