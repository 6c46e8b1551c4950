"""Price panels in long form: one row per (date, asset), on a dense grid of dates and assets."""

from __future__ import annotations

import datetime as dt
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "adj_close", "volume")
#: Cells of a large panel in one part; an asset is never cut.
PART = 1_000_000


def by_asset(*more: str) -> Window:
    return Window.partitionBy(*more, "asset").orderBy("date")


def by_date(*more: str) -> Window:
    return Window.partitionBy(*more, "date")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local session names none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brassloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root or sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def densify(bars: DataFrame, dates: DataFrame | None = None, assets: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """All dates for all assets. Bars are made once and checkpointed, as both the grid and its values need them.

    An asset's bar is exploded into the dates from its own to the next bar's, its first one into those before it as well, so
    bars are all that is shuffled, by asset, and never the grid; the parts of a large panel grow in number, not in size. dates (date) and assets (asset) give the
    grid where bars are only a part of the panel, so that what a slice or a subset doesn't hold is filtered in the scan of what
    the bars are made of. Fields are NULL on dates without a bar; those in carried keep their last value there.
    """
    bars = stored(bars)
    if "adj_close" not in bars.columns:
        bars = bars.withColumn("adj_close", F.col("close"))
    for c in FIELDS:
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(None).cast("double"))
    # Dates are some days a year, whatever the number of assets. They are numbered from 1; 0 stands for what has no place in the grid.
    days = F.array_sort(F.collect_set("date")).alias("_dates")
    if dates is None and assets is None:
        found = stored(bars.agg(days, F.approx_count_distinct("asset").alias("_assets")))
    else:
        known = stored((bars if assets is None else assets).select("asset").distinct())
        found = stored((bars if dates is None else dates).agg(days).withColumn("_assets", F.lit(known.count())))
        bars = known.join(bars, "asset", "left")
    calendar = found.select(F.posexplode("_dates").alias("_n", "date")).select((F.col("_n") + 1).alias("_n"), "date")
    n_dates, n_assets = found.select(F.size("_dates"), "_assets").first()
    if n_dates * n_assets > 4 * PART:  # smaller panels are left to Spark's own number of parts
        bars = bars.repartition(max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_dates * n_assets // PART), "asset")
    w, n = Window.partitionBy("asset").orderBy("_n"), F.col("_n")
    runs = bars.join(F.broadcast(calendar), "date", "left").withColumn("_n", F.when(F.col("asset").isNotNull() & n.isNotNull(), n).otherwise(0))
    runs = runs.withColumns({c: F.when(n > 0, F.col(c)) for c in FIELDS})
    last = {f"_{c}": F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c in carried}
    # Bars of one date stay beside each other: a panel doesn't hide that its keys aren't unique.
    runs = runs.withColumns({"_from": F.when((n == 0) | F.lag(n).over(w).isNull(), 1).otherwise(n), "_to": F.greatest(F.coalesce(F.lead(n).over(w), F.lit(n_dates + 1)) - 1, n), **last})
    cells = runs.where("_from <= _to").drop("date").withColumn("_at", F.explode(F.sequence("_from", "_to")))
    cells = cells.join(F.broadcast(calendar.withColumnRenamed("_n", "_at")), "_at")
    value = lambda c: F.when(F.col("_at") >= n, F.col(f"_{c}")) if c in carried else F.when(F.col("_at") == n, F.col(c))
    return cells.select("date", "asset", *[value(c).alias(c) for c in FIELDS])


def duplicates(bars: DataFrame) -> DataFrame:
    """Keys that occur more than once; a panel must have none."""
    return bars.groupBy("date", "asset").count().where("count > 1")


def between(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both inclusive. Apply it before windows: Catalyst doesn't push dates through a window by asset."""
    if start:
        panel = panel.where(F.col("date") >= F.lit(start).cast("date"))
    return panel.where(F.col("date") <= F.lit(end).cast("date")) if end else panel


def subset(panel: DataFrame, assets: list[str]) -> DataFrame:
    return panel.where(F.col("asset").isin(*assets))


def adj_open() -> Column:
    """The open on the scale of adjusted closes."""
    return F.col("open") * F.try_divide(F.col("adj_close"), F.col("close"))


@dataclass(frozen=True)
class Splits:
    """Development up to dev_end, validation up to val_end, holdout after it (inclusive ends)."""

    dev_end: str = "1998-12-31"
    val_end: str = "2000-06-30"
    name: str = "orders"

    def label(self, date: Column | str = "date") -> Column:
        d = F.col(date) if isinstance(date, str) else date
        return F.when(d <= F.lit(self.dev_end).cast("date"), "DEVELOPMENT").when(d <= F.lit(self.val_end).cast("date"), "VALIDATION").otherwise("HOLDOUT")

    def bounds(self, split: str) -> tuple[str | None, str | None]:
        after = lambda d: (dt.date.fromisoformat(d) + dt.timedelta(days=1)).isoformat()
        try:
            return {
                "DEVELOPMENT": (None, self.dev_end),
                "VALIDATION": (after(self.dev_end), self.val_end),
                "HOLDOUT": (after(self.val_end), None),
                "RESEARCH": (None, self.val_end),
                "DEV+VAL": (None, self.val_end),
            }[split]
        except KeyError:
            raise ValueError(f"unknown split {split!r}") from None

    def explode(self, df: DataFrame, names: tuple[str, ...] = ("DEVELOPMENT", "VALIDATION", "DEV+VAL"), date: str = "date") -> DataFrame:
        """Each row once for every named split that holds it, in one pass over df."""
        inside = []
        for n in names:
            a, b = self.bounds(n)
            ok = F.lit(True)
            if a:
                ok = ok & (F.col(date) >= F.lit(a).cast("date"))
            if b:
                ok = ok & (F.col(date) <= F.lit(b).cast("date"))
            inside.append(F.when(ok, F.lit(n)))
        return df.withColumn("split", F.explode(F.array_compact(F.array(*inside))))


class HoldoutViolation(RuntimeError):
    """Rows after the end of validation were about to be used without the holdout having been opened."""


def guard(panel: DataFrame, splits: Splits, opened: bool = False) -> DataFrame:
    """panel, if nothing in it is later than validation (or the holdout has been opened)."""
    last = panel.agg(F.max("date")).first()[0]
    if last is not None and not opened and str(last) > splits.val_end:
        raise HoldoutViolation(f"panel goes to {last}, validation ends {splits.val_end}")
    return panel


def weight_faults(weights: DataFrame, panel: DataFrame, max_gross: float = 1.0, allow_short: bool = False) -> DataFrame:
    """One row: counts of shorts, dates over the gross limit, non-finite weights, and weights for unknown assets or dates."""
    w = F.col("weight")
    own = weights.agg(
        F.count(F.when((w < -1e-9) & F.lit(not allow_short), 1)).alias("n_short"),
        F.count(F.when(F.isnan(w) | (F.abs(w) == F.lit(float("inf"))), 1)).alias("n_nonfinite"),
    )
    gross = weights.groupBy("date").agg(F.sum(F.abs(w)).alias("g")).agg(F.count(F.when(F.col("g") > max_gross + 1e-6, 1)).alias("n_over"))
    assets = weights.select("asset").distinct().join(panel.select("asset").distinct(), "asset", "left_anti").agg(F.count("*").alias("n_assets"))
    dates = weights.select("date").distinct().join(panel.select("date").distinct(), "date", "left_anti").agg(F.count("*").alias("n_dates"))
    return own.crossJoin(gross).crossJoin(assets).crossJoin(dates)


def monthly_rf(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """date, rf: a month's percent rate (month, percent) spread over the month's dates so that they compound to it. A month without a rate raises."""
    days = panel.select("date").distinct().withColumn("month", F.trunc("date", "month"))
    days = days.withColumn("n", F.count("*").over(Window.partitionBy("month")))
    rate = F.when(F.col("percent").isNull(), F.raise_error(F.concat(F.lit("no rate for "), F.col("month").cast("string"))).cast("double")).otherwise(F.col("percent"))
    return days.join(rates, "month", "left").withColumn("percent", rate).select("date", (F.pow(1 + F.col("percent") / 100.0, F.lit(1.0) / F.col("n")) - 1).alias("rf"))


def annual_rf(dates: DataFrame) -> DataFrame:
    """date, rf of (key, date, annual): a times the days since the last date over 365; the first one counts a day, and none less."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("key").orderBy("date")))
    return dates.select("key", "date", (F.col("annual") * F.greatest(F.coalesce(gap, F.lit(1)), F.lit(1)) / 365.0).alias("rf"))
