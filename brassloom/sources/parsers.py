"""Parsers of market data files as DataFrame operations: text payloads in a column, or files that Spark reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHART = "struct<timestamp:array<bigint>,gmtoffset:bigint,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>,adjclose:array<double>>"
CANDLE = "struct<end_period_ts:bigint,yes_bid:struct<close:double,close_dollars:double>,yes_ask:struct<close:double,close_dollars:double>,volume:double,volume_fp:double>"


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV files with the header Date,Open,High,Low,Close[,Volume]; a folder with any other file raises, and so does one without files' text.

    Volume may be there in some files only: it is the sixth field wherever it stands.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")
    header = F.col("value").startswith("Date,Open,High,Low,Close")
    files = lines.groupBy("file").agg(F.count(F.when(header, 1)).alias("headers"))
    bad, n = files.agg(F.min(F.when(F.col("headers") == 0, F.col("file"))), F.count("*")).first()
    if bad or not n:
        raise ValueError(f"no daily bars in {bad or path}")
    part = F.split("value", ",")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    rows = lines.where(~header).select(F.try_element_at(part, F.lit(1)).try_cast("date").alias("date"), *[number(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 2)])
    return rows.withColumn("adj_close", F.col("close"))


def parse_daily_csv(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The same from payload columns: one text of lines per row; a payload without the header gives no rows."""
    lines = F.split(F.col(text), "\r?\n")
    rows = payloads.where(F.col(text).startswith("Date,")).select(*keys, F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("_l")).where("_l <> ''")
    part = F.split("_l", ",")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    out = rows.select(*keys, F.try_element_at(part, F.lit(1)).try_cast("date").alias("date"), *[number(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 2)])
    return out.withColumn("adj_close", F.col("close"))


def parse_chart(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of a chart document with parallel arrays; days without a close are dropped, an adjusted close falls back to it."""
    c = payloads.select(*keys, F.from_json(text, CHART).alias("c")).select(*keys, "c.*")
    z = F.arrays_zip(F.col("timestamp"), F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), F.coalesce("adjclose", "close").alias("adjclose"))
    rows = c.select(*keys, "gmtoffset", F.inline(z))
    day = F.to_date(F.timestamp_seconds(F.col("timestamp") + F.coalesce("gmtoffset", F.lit(0))))
    return rows.where("close IS NOT NULL").select(*keys, day.alias("date"), "open", "high", "low", "close", F.coalesce("adjclose", "close").alias("adj_close"), "volume")


def parse_series_csv(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """date and value of two-column lines; what is no number (a dot) is NULL, headers are dropped."""
    part = F.split(F.col(text), ",")
    return lines.select(*keys, F.try_element_at(part, F.lit(1)).try_cast("date").alias("date"), F.try_element_at(part, F.lit(2)).try_cast("double").alias("value")).where("date IS NOT NULL")


def parse_candles(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of positional candles [t, low, high, open, close, volume]; of equal times the first is kept."""
    rows = payloads.select(*keys, F.posexplode(F.from_json(text, "array<array<double>>")).alias("_n", "x"))
    at = lambda i: F.try_element_at("x", F.lit(i))
    out = rows.select(*keys, F.timestamp_seconds(at(1).cast("long")).alias("ts"), at(4).alias("open"), at(3).alias("high"), at(2).alias("low"), at(5).alias("close"), at(6).alias("volume"), "_n")
    return out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "ts").orderBy("_n"))).where("_k = 1").drop("_n", "_k")


def kline_time(t: Column) -> Column:
    """Times in milliseconds or, from 1e14 on, microseconds."""
    return F.when(t > 100_000_000_000_000, F.timestamp_micros(t)).otherwise(F.timestamp_millis(t))


def parse_klines(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of twelve-field klines, of which the first six are kept."""
    rows = payloads.select(*keys, F.explode(F.from_json(text, "array<array<string>>")).alias("x"))
    at = lambda i: F.try_element_at("x", F.lit(i))
    return rows.select(*keys, kline_time(at(1).cast("long")).alias("ts"), *[at(i).try_cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 2)])


def read_zipped_klines(spark: SparkSession, path: str) -> DataFrame:
    """Klines from zip files, each of whose first member is a CSV without header. Zip is no codec of Spark: a task unpacks a file."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    lines = []
                    for line in io.TextIOWrapper(f, "utf-8"):
                        lines.append(line.strip())
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
                            lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    part = F.split("line", ",")
    at = lambda i: F.try_element_at(part, F.lit(i))
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "line string")
    return rows.where(at(1).try_cast("long").isNotNull()).select(kline_time(at(1).cast("long")).alias("ts"), *[at(i).try_cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 2)])


def parse_quote_candles(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Candles of binary markets whose fields have one name live and another in the archive; a missing volume is 0."""
    c = payloads.select(*keys, F.explode(F.from_json(text, f"array<{CANDLE}>")).alias("c"))
    either = lambda x: F.coalesce(F.col(f"c.{x}.close_dollars"), F.col(f"c.{x}.close"))
    return c.select(*keys, F.col("c.end_period_ts").alias("end_ts"), either("yes_bid").alias("bid_close"), either("yes_ask").alias("ask_close"), F.coalesce("c.volume_fp", "c.volume", F.lit(0.0)).alias("volume"))


def manifest(df: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """key, rows, first, last and a hash of the content that doesn't depend on the order of rows."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.lit(key).alias("key"), F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.sha2(F.sum(row).cast("string").cast("binary"), 256).alias("digest"))


def parse_markets(rows: DataFrame, key: str, texts: list[str], numbers: list[str], times: list[str]) -> DataFrame:
    """One row per key (the smallest, where they differ), with text columns cast to numbers and UTC times; what can't be is NULL."""
    typed = rows.select(key, *texts, *[F.col(c).try_cast("double").alias(c) for c in numbers], *[F.col(c).try_cast("timestamp").alias(c) for c in times])
    return typed.groupBy(key).agg(F.min(F.struct(*texts, *numbers, *times)).alias("s")).select(key, "s.*")
