"""Time of day: hold during a window of hours each day, paying for both legs, scored on every split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brassloom.operators import metrics
from brassloom.operators.windows import pct_change
from brassloom.plans.panel import Splits


@dataclass(frozen=True)
class Hours:
    """From the hour ``first`` up to ``last``, which isn't held; a window that ends before it begins goes over midnight and belongs to the day on which it began."""

    name: str
    first: int
    last: int

    def holds(self, hour: Column) -> Column:
        if self.first < self.last:
            return (hour >= self.first) & (hour < self.last)
        return (hour >= self.first) | (hour < self.last)

    def day(self, ts: Column) -> Column:
        """The day that an hour of the window belongs to."""
        date = F.to_date(ts)
        return F.when(F.hour(ts) < self.last, F.date_sub(date, 1)).otherwise(date) if self.first >= self.last else date


def daily(bars: DataFrame, windows: list[Hours], bps: float, until: str, keys: list[str]) -> DataFrame:
    """(keys, variant, date, gross, net) of bars (keys, ts, close), hour by hour: every window on every day from its first one to ``until``, days without a bar in it at 0.

    An hour is exploded into the windows that hold it, so all windows are one pass; bps is the cost of a side.
    """
    r = bars.withColumn("r", pct_change("close", 1, Window.partitionBy(*keys).orderBy("ts"))).where("r IS NOT NULL")
    at = F.array_compact(F.array(*[F.when(w.holds(F.hour("ts")), F.struct(F.lit(w.name).alias("variant"), w.day(F.col("ts")).alias("date"))) for w in windows]))
    held = r.withColumn("_w", F.explode(at)).select(*keys, "_w.variant", "_w.date", "r").where(F.col("date") <= F.lit(until).cast("date"))
    by = [*keys, "variant"]
    gross = held.groupBy(*by, "date").agg((F.product(1 + F.col("r")) - 1).alias("gross"))
    # The days between two that have bars are filled up from the earlier one, so no calendar is joined.
    w = Window.partitionBy(*by).orderBy("date")
    upto = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.lit(until).cast("date"))
    dense = gross.withColumn("_upto", F.greatest("date", upto)).withColumn("_day", F.explode(F.sequence("date", "_upto")))
    own = lambda x: F.when(F.col("_day") == F.col("date"), x).otherwise(0.0)
    return dense.select(*by, F.col("_day").alias("date"), own(F.col("gross")).alias("gross"), own(F.col("gross") - 2 * bps / 1e4).alias("net"))


def score(days: DataFrame, splits: Splits, keys: list[str], ppy: float = 365, rf: float = 0.0) -> DataFrame:
    """(keys, variant, split) with the summary of net returns, the Sharpe ratio before costs, and the number of days that were traded."""
    by = [*keys, "variant", "split"]
    each = splits.explode(days.withColumn("rf", F.lit(rf)))
    before = each.groupBy(*by).agg(metrics.sharpe(F.col("gross") - rf, ppy).alias("gross_sharpe"), F.count(F.when(F.col("gross") != 0, 1)).alias("n_trades"))
    return metrics.summarize(each.withColumnRenamed("net", "r"), by, ppy).join(before, by)
