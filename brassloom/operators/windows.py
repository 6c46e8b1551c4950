"""Ordered windows on a dense panel. A frame that lacks values gives NULL, not a value of what is there."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from brassloom.plans.panel import by_asset, by_date


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shift(x: Column | str, k: int, w=None) -> Column:
    return F.lag(col(x), k).over(w or by_asset())


def diff(x: Column | str, w=None) -> Column:
    return col(x) - shift(x, 1, w)


def pct_change(x: Column | str, k: int = 1, w=None) -> Column:
    """x over its value k rows before, less 1. Gaps aren't filled: a NULL on either side gives NULL."""
    return F.try_divide(col(x), shift(x, k, w)) - 1


def _full(x: Column, n: int, value: Column, w, least: int | None, lag: int) -> Column:
    frame = (w or by_asset()).rowsBetween(-(lag + n - 1), -lag)
    return F.when(F.count(x).over(frame) >= (least or n), value.over(frame))


def rolling_mean(x: Column | str, n: int, w=None, least: int | None = None, lag: int = 0) -> Column:
    return _full(col(x), n, F.avg(col(x)), w, least, lag)


def rolling_std(x: Column | str, n: int, w=None, least: int | None = None, lag: int = 0) -> Column:
    return _full(col(x), n, F.stddev_samp(col(x)), w, least, lag)


def rolling_sum(x: Column | str, n: int, w=None, least: int | None = None, lag: int = 0) -> Column:
    return _full(col(x), n, F.sum(col(x)), w, least, lag)


def so_far(w=None):
    return (w or by_asset()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ffill(x: Column | str, w=None) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(w))


def equity(r: Column | str, w=None) -> Column:
    """The compounded value of 1. As a sum of logs while returns stay above -1, which streams; a product otherwise."""
    return F.product(1 + col(r)).over(so_far(w))


def drawdown(eq: Column | str, w=None) -> Column:
    """Equity over its peak so far, which is 1 at least, less 1."""
    return col(eq) / F.greatest(F.max(col(eq)).over(so_far(w)), F.lit(1.0)) - 1


def cross_rank(x: Column | str, w=None) -> Column:
    """Rank within a date, largest first, ties by asset; NULL stays NULL."""
    rank = F.row_number().over((w or by_date()).orderBy(col(x).desc_nulls_last(), "asset"))
    return F.when(col(x).isNotNull(), rank)


def first_of_month(w=None) -> Column:
    month = F.trunc("date", "month")
    return F.coalesce(month != F.lag(month).over(w or by_asset()), F.lit(True))


def session_of_month(*by: str) -> tuple[Column, Column]:
    """A date's position in its month from the start (1 first) and from the end (0 last), on the calendar that df holds."""
    month = [*by, F.trunc("date", "month")]
    n = F.row_number().over(Window.partitionBy(*month).orderBy("date"))
    return n, F.count("*").over(Window.partitionBy(*month)) - n


def run_ids(x: Column, w=None) -> Column:
    """Numbers of maximal runs of one value of x, which starts as 0."""
    w = w or by_asset()
    return F.sum(F.when(x != F.coalesce(F.lag(x).over(w), F.lit(0)), 1).otherwise(0)).over(so_far(w))
