"""Sessions of a stock exchange by rule: which days it is closed, which end early, worked out for any range of dates.

Easter is integer arithmetic on the year, other moving holidays are the n-th or last weekday of a month, fixed ones are moved off
weekends. Single closures and early closes that no rule gives are data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days of a year on which the exchange was closed for once, from 1990 on.
CLOSED_ONCE = {
    "1994-04-27": "day of mourning", "2001-09-11": "attack", "2001-09-12": "attack", "2001-09-13": "attack", "2001-09-14": "attack", "2004-06-11": "day of mourning",
    "2007-01-02": "day of mourning", "2012-10-29": "storm", "2012-10-30": "storm", "2018-12-05": "day of mourning", "2025-01-09": "day of mourning",
}
# First years of holidays that were added later.
KING_FROM, JUNETEENTH_FROM = 1998, 2022


def easter_month_day(year: str) -> str:
    """SQL of 100 * month + day of Easter Sunday in the Gregorian calendar, over a column of years."""
    a, b, c = f"({year} % 19)", f"({year} // 100)", f"({year} % 100)"
    h = f"((19 * {a} + {b} - {b} // 4 - (({b} - ({b} + 8) // 25 + 1) // 3) + 15) % 30)"
    w = f"((32 + 2 * ({b} % 4) + 2 * ({c} // 4) - {h} - {c} % 4) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {w}) // 451)"
    n = f"({h} + {w} - 7 * {m} + 114)"
    return f"(100 * ({n} // 31) + {n} % 31 + 1)"


def _rule(date: Column, easter: Column) -> Column:
    """The holiday that a date is by rule, NULL if none; weekends aside."""
    month, day, weekday, year = F.month(date), F.dayofmonth(date), F.weekday(date), F.year(date)
    nth = lambda m, which, n: (month == m) & (weekday == which) & (F.ceil(day / 7) == n)
    last = lambda m, which: (month == m) & (weekday == which) & (F.month(F.date_add(date, 7)) != m)
    # On a Sunday a fixed holiday is kept on Monday, on a Saturday on Friday.
    fixed = lambda m, d: ((month == m) & (day == d)) | ((month == m) & (day == d + 1) & (weekday == 0)) | ((F.month(F.date_add(date, 1)) == m) & (F.dayofmonth(F.date_add(date, 1)) == d) & (weekday == 4))
    # New Year's Day on a Saturday isn't made up for, as the Friday ends the year.
    new_year = ((month == 1) & (day == 1)) | ((month == 1) & (day == 2) & (weekday == 0))
    return (
        F.when(new_year, "New Year's Day")
        .when((year >= KING_FROM) & nth(1, 0, 3), "Martin Luther King Day")
        .when(nth(2, 0, 3), "Washington's Birthday")
        .when(date == F.date_sub(easter, 2), "Good Friday")
        .when(last(5, 0), "Memorial Day")
        .when((year >= JUNETEENTH_FROM) & fixed(6, 19), "Juneteenth")
        .when(fixed(7, 4), "Independence Day")
        .when(nth(9, 0, 1), "Labor Day")
        .when(nth(11, 3, 4), "Thanksgiving Day")
        .when(fixed(12, 25), "Christmas Day")
    )


def days(dates: DataFrame) -> DataFrame:
    """dates (date) with weekend, holiday (its name, or NULL), session (whether there is one) and early (whether it ends early: the day after Thanksgiving, and the days before Independence Day and Christmas that are Monday to Thursday)."""
    df = dates.withColumn("_y", F.year("date"))
    spark_sql = easter_month_day("_y").replace("//", "div")
    df = df.withColumn("_e", F.expr(spark_sql)).withColumn("_easter", F.make_date("_y", F.floor(F.col("_e") / 100).cast("int"), (F.col("_e") % 100).cast("int")))
    once = F.create_map(*[F.lit(x) for k, v in CLOSED_ONCE.items() for x in (k, v)])[F.col("date").cast("string")]
    date, weekday = F.col("date"), F.weekday("date")
    df = df.withColumn("weekend", weekday >= 5).withColumn("holiday", F.when(weekday < 5, F.coalesce(_rule(date, F.col("_easter")), once)))
    after_thanks = (F.month(date) == 11) & (weekday == 4) & (F.ceil(F.dayofmonth(F.date_sub(date, 1)) / 7) == 4) & (F.month(F.date_sub(date, 1)) == 11)
    eve = ((F.month(date) == 7) & (F.dayofmonth(date) == 3) | (F.month(date) == 12) & (F.dayofmonth(date) == 24)) & (weekday < 4)
    session = ~F.col("weekend") & F.col("holiday").isNull()
    return df.withColumn("session", session).withColumn("early", session & (after_thanks | eve)).drop("_y", "_e", "_easter")


def sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """date and early of the sessions from first to last, both inclusive."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days(span).where("session").select("date", "early")


def days_sql(dates: str) -> str:
    """The same in SQL, over a table with the column date."""
    once = ", ".join(f"'{k}'" for k in CLOSED_ONCE)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLOSED_ONCE.items())
    fixed = lambda m, d: f"((mo = {m} AND da = {d}) OR (mo = {m} AND da = {d + 1} AND wd = 0) OR (month(date + 1) = {m} AND day(date + 1) = {d} AND wd = 4))"
    nth = lambda m, w, n: f"(mo = {m} AND wd = {w} AND ceil(da / 7e0) = {n})"
    rule = f"""CASE WHEN (mo = 1 AND da = 1) OR (mo = 1 AND da = 2 AND wd = 0) THEN 'New Year''s Day' WHEN ye >= {KING_FROM} AND {nth(1, 0, 3)} THEN 'Martin Luther King Day' WHEN {nth(2, 0, 3)} THEN 'Washington''s Birthday'
 WHEN date = make_date(ye, ea // 100, ea % 100) - 2 THEN 'Good Friday' WHEN mo = 5 AND wd = 0 AND month(date + 7) <> 5 THEN 'Memorial Day' WHEN ye >= {JUNETEENTH_FROM} AND {fixed(6, 19)} THEN 'Juneteenth' WHEN {fixed(7, 4)} THEN 'Independence Day'
 WHEN {nth(9, 0, 1)} THEN 'Labor Day' WHEN {nth(11, 3, 4)} THEN 'Thanksgiving Day' WHEN {fixed(12, 25)} THEN 'Christmas Day' WHEN date::VARCHAR IN ({once}) THEN CASE date::VARCHAR {names} END END"""
    early = "(mo = 11 AND wd = 4 AND month(date - 1) = 11 AND ceil(day(date - 1) / 7e0) = 4) OR (((mo = 7 AND da = 3) OR (mo = 12 AND da = 24)) AND wd < 4)"
    parts = f"SELECT *, month(date) AS mo, day(date) AS da, year(date) AS ye, isodow(date) - 1 AS wd, {easter_month_day('year(date)')} AS ea FROM {dates}"
    return f"SELECT * EXCLUDE (mo, da, ye, wd, ea), wd >= 5 AS weekend, holiday IS NULL AND wd < 5 AS session, holiday IS NULL AND wd < 5 AND ({early}) AS early FROM (SELECT *, CASE WHEN wd < 5 THEN {rule} END AS holiday FROM ({parts}))"
