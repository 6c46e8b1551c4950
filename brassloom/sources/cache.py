"""Tables that are fetched or made once and added to: what is left to fetch, and trades by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch_plan(listed: DataFrame, fetched: DataFrame, key: str, volume: str, least: float, limit: int | None = None) -> DataFrame:
    """The listed rows of at least some volume that haven't been fetched, largest volume first; limit is how many a run may take."""
    left = listed.where(F.col(volume) >= least).join(fetched.select(key).distinct(), key, "left_anti").orderBy(F.col(volume).desc(), key)
    return left.limit(limit) if limit else left


def months_missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, month) of wanted that stored doesn't hold yet."""
    return wanted.select("key", "month").distinct().join(stored.select("key", "month").distinct(), ["key", "month"], "left_anti")


def write_trades(trades: DataFrame, path: str) -> None:
    """Trades in a folder for each variant; a variant that is written again replaces its folder and leaves the others."""
    trades.repartition("variant").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)


def read_trades(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """All trades, or those of a variant, of which only its folder is read."""
    df = spark.read.parquet(path)
    return df.where(F.col("variant") == variant) if variant else df
