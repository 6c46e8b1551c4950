"""Exchange days against known dates, windows of the day against a plain loop, shared as-of lookups against the join."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brassloom.operators import exchange, hours
from brassloom.operators.asof import asof_join, asof_lookup

# Days on which the exchange was closed, by year.
CLOSED = {
    1996: "01-01 02-19 04-05 05-27 07-04 09-02 11-28 12-25",
    2001: "01-01 01-15 02-19 04-13 05-28 07-04 09-03 09-11 09-12 09-13 09-14 11-22 12-25",
    2012: "01-02 01-16 02-20 04-06 05-28 07-04 09-03 10-29 10-30 11-22 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24",
    2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26",
    2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
}
EARLY = {2012: "07-03 11-23 12-24", 2021: "11-26", 2023: "07-03 11-24", 2024: "07-03 11-29 12-24"}
# Easter Sundays.
EASTER = {1990: (4, 15), 1997: (3, 30), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2027: (3, 28)}


def test_known_closures(spark):
    for year, closed in CLOSED.items():
        open_days = {r.date for r in exchange.sessions(spark, f"{year}-01-01", f"{year}-12-31").collect()}
        every = [dt.date(year, 1, 1) + dt.timedelta(days=i) for i in range(366)]
        assert [f"{x:%m-%d}" for x in every if x.year == year and x.weekday() < 5 and x not in open_days] == closed.split()
    for year, early in EARLY.items():
        assert [f"{r.date:%m-%d}" for r in exchange.sessions(spark, f"{year}-01-01", f"{year}-12-31").where("early").orderBy("date").collect()] == early.split()


def test_easter(spark):
    years = spark.createDataFrame([(y,) for y in EASTER], "y int")
    rows = years.select("y", F.expr(exchange.easter_month_day("y").replace("//", "div")).alias("e")).collect()
    assert {r.y: divmod(r.e, 100) for r in rows} == EASTER


def test_windows_of_the_day(spark):
    start = dt.datetime(2024, 1, 1)
    bars = [("m", start + dt.timedelta(hours=h), 100 + (h * 37 % 11) / 10) for h in range(24 * 6) if h % 29 and not 48 <= h < 72]
    windows = [hours.Hours("day", 8, 16), hours.Hours("night", 20, 4)]
    rows = hours.daily(spark.createDataFrame(bars, "market string, ts timestamp, close double"), windows, 5.0, "2024-01-06", ["market"]).collect()
    want = {}
    for (_, _, before), (_, ts, now) in zip(bars, bars[1:]):
        for w in windows:
            h = ts.hour
            if (8 <= h < 16) if w.name == "day" else (h >= 20 or h < 4):
                day = (ts - dt.timedelta(days=1)).date() if w.name == "night" and h < 4 else ts.date()
                want[w.name, day] = want.get((w.name, day), 1.0) * now / before
    got = {(r.variant, r.date): r for r in rows}
    for w in windows:
        days = [d for n, d in want if n == w.name]
        every = [min(days) + dt.timedelta(days=i) for i in range((dt.date(2024, 1, 6) - min(days)).days + 1)]
        assert sorted(d for n, d in got if n == w.name) == every
        for d in every:
            gross = want.get((w.name, d), 1.0) - 1
            assert math.isclose(got[w.name, d].gross, gross, abs_tol=1e-12)
            assert math.isclose(got[w.name, d].net, gross - 0.001 if (w.name, d) in want else 0.0, abs_tol=1e-12)


@pytest.mark.parametrize("tolerance", [None, 3600.0])
def test_shared_lookups_equal_the_join(spark, tolerance):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, t + dt.timedelta(hours=i % 5) if i % 11 else None) for i in range(200)], "i int, k string, at timestamp")
    right = spark.createDataFrame([("a", t + dt.timedelta(minutes=50 * i), float(i)) for i in range(4)] + [("b", t, 9.0), (None, t, 7.0)], "k string, rt timestamp, v double")
    both = [sorted(f(left, right, "at", "rt", ["k"], ["v"], tolerance).collect(), key=lambda r: r.i) for f in (asof_join, asof_lookup)]
    assert both[0] == both[1] and len(both[0]) == 200
    window = asof_lookup(left, right, "at", "rt", ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in window  # distinct pairs come before the window
