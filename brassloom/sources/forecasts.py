"""Archived forecasts: monthly CSV parts whose columns come and go, and a store to which only missing months are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is kept of a part; the last four are there in some parts only.
KEYS, VALUES = ("runtime", "ftime", "station", "model"), ("n_x", "txn", "xnd", "tmp")
SCHEMA = "runtime timestamp, ftime timestamp, station string, model string, n_x double, txn double, xnd double, tmp double, month string"
#: Parts up to which their headers (a line each) are broadcast.
FEW = 100_000


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))


def _typed(lines: DataFrame, header: Column, line: Column, keep: list[str]) -> DataFrame:
    """Rows by the names in their own part's header; a part without a column has NULLs there. Rows without a forecast of the part's kind are dropped."""
    names, cells = F.col("_names"), F.col("_cells")
    at = lambda c: F.when(F.array_contains(names, c), F.try_element_at(cells, F.array_position(names, F.lit(c)).cast("int")))
    rows = lines.withColumn("_names", _cells(F.rtrim(header))).withColumn("_cells", _cells(F.rtrim(line)))
    columns = [at(c).try_cast("timestamp").alias(c) if c in ("runtime", "ftime") else at(c).alias(c) for c in KEYS]
    rows = rows.select(*keep, *columns, *[at(c).try_cast("double").alias(c) for c in VALUES], F.array_contains(names, "n_x").alias("_daily"))
    return rows.where(F.when(F.col("_daily"), F.col("n_x")).otherwise(F.col("txn")).isNotNull() & F.col("runtime").isNotNull()).drop("_daily")


def parse_forecasts(payloads: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and forecasts of payloads, each a whole part with its header."""
    lines = payloads.select(*keys, F.split(F.col(text), "\r?\n").alias("_l"))
    rows = lines.select(*keys, F.element_at("_l", 1).alias("_header"), F.explode(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))).alias("_line")).where("_line <> ''")
    return _typed(rows, F.col("_header"), F.col("_line"), keys)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts of CSV files, with the month that a file's name ends with (``...YYYY-MM.csv``).

    A line is matched with the header of its own file, so files may differ in columns and in their order. Lines aren't held by file: a long
    file is read by several tasks.
    """
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"))
    headers = lines.where(F.col("_line").rlike(r'(^|,)"?runtime"?(,|\s*$)')).groupBy(F.col("_file").alias("_f")).agg(F.min("_line").alias("_header"))
    n = headers.count()
    rows = lines.join(F.broadcast(headers) if n <= FEW else headers, F.col("_file") == F.col("_f")).where("_line <> _header AND _line <> ''")
    rows = rows.withColumn("month", F.regexp_extract("_file", r"(\d{4}-\d{2})\.csv$", 1))
    return _typed(rows, F.col("_header"), F.col("_line"), ["month"]).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def stored_months(spark: SparkSession, path: str) -> DataFrame:
    """(model, station, month) that the store holds, from its folders; none where there is no store yet."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "model string, station string, month string")
    return stored_forecasts(spark, path, once=False).select("model", "station", "month").distinct()


def add_months(forecasts: DataFrame, path: str) -> None:
    """Write the months of each model and station that the store lacks; a month that is there stays as it is.

    A month is a folder that a run replaces as a whole, so a run that is repeated after a failure leaves no part twice.
    """
    spark = forecasts.sparkSession
    by = ["model", "station", "month"]
    new = forecasts.join(stored_months(spark, path), by, "left_anti")
    new.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored_forecasts(spark: SparkSession, path: str, once: bool = True) -> DataFrame:
    """The store's forecasts; a run's forecast that two months hold, as parts overlap, comes once, from the earlier month."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if not once:
        return df
    key = ["model", "station", "runtime", "ftime"]
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct("month", *[c for c in rest if c != "month"])).alias("s"))
    return first.select(*[F.col(c) if c in key else F.col(f"s.{c}").alias(c) for c in df.columns])
