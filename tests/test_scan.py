"""Scans over series that are cut into ranges, against one pass over the whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brassloom.operators import folds, scan


@pytest.fixture(scope="module")
def series(spark):
    """Three keys, one of 900 rows, with gaps, ties in their order and a loss of more than all."""
    r = random.Random(1)
    rows, day = [], dt.date(2020, 1, 1)
    for key, n in (("a", 900), ("b", 40), ("c", 1), (None, 70)):
        for i in range(n):
            x = None if r.random() < 0.1 else r.choice((0.0, 0.0, r.gauss(0, 0.05)))
            rows.append((key, day + dt.timedelta(days=i // 3), i, x, r.choice("xyz") if r.random() < 0.5 else None, r.gauss(0, 1) if r.random() < 0.9 else None))
    rows.append(("a", day + dt.timedelta(days=100), -1, -1.5, "x", 3.0))
    return spark.createDataFrame(rows, "k string, date date, i int, r double, v string, z double").repartition(7)


def _keyed(df, *columns):
    out = {}
    for x in df.collect():
        out.setdefault(x.k, []).append((x.date, x.i, *(x[c] for c in columns)))
    return {k: sorted(v, key=lambda t: t[:2]) for k, v in out.items()}


def _equal(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert len(a[k]) == len(b[k])
        for x, y in zip(a[k], b[k]):
            assert all(p == q or (p is not None and q is not None and not isinstance(p, (str, dt.date)) and abs(p - q) <= 1e-9 * (1 + abs(q))) for p, q in zip(x, y)), (k, x, y)


@pytest.mark.parametrize("rows", [7, 60, 10_000])
def test_drawdown_and_time_under_water(spark, series, rows):
    want = {}
    for k, rs in _keyed(series, "r").items():
        equity, peak, under, out = 1.0, 1.0, 0, []
        for date, i, r in rs:
            equity *= 1 + (r or 0.0)
            peak = max(peak, equity)
            under = under + 1 if equity / peak - 1 < 0 else 0
            out.append((date, i, equity, equity / peak - 1, under))
        want[k] = out
    found = scan.drawdown(series.where("k IS NOT NULL"), ["k"], "date", "r", ("i",), rows)
    assert set(found.columns) == {*series.columns, "equity", "dd", "under"}
    want.pop(None)
    _equal(_keyed(found, "equity", "dd", "under"), want)


@pytest.mark.parametrize("rows", [7, 60, 10_000])
def test_numbers_and_runs(spark, series, rows):
    some = series.where("k IS NOT NULL")
    want = {}
    for k, rs in _keyed(some, "v").items():
        n, last, out = 0, object(), []
        for pos, (date, i, v) in enumerate(rs):
            n, last = n + (v != last), v
            out.append((date, i, pos, n))
        want[k] = out
    both = scan.runs(scan.numbered(some, ["k"], "date", ("i",), rows), ["k"], "date", "v", ("i",), rows)
    _equal(_keyed(both, "pos", "run"), want)


@pytest.mark.parametrize("rows", [7, 60])
def test_recursions_equal_streams_by_key(spark, series, rows):
    some = series.where("k IS NOT NULL").withColumn("at", F.col("date").cast("timestamp") + F.make_dt_interval(secs=F.col("i").cast("decimal(18,6)")))
    for how, plain, value in ((scan.Ema(0.2), lambda d: folds.ema(d, ["k"], "at", "r", 0.2), "r"), (scan.ThreeState(1.0, 0.3), lambda d: folds.three_state(d, ["k"], "at", "z", 1.0, 0.3), "z")):
        found = scan.machine(some, ["k"], "at", [value], how, (), rows)
        assert set(found.columns) == {*some.columns, "out"}
        want = plain(some.select("k", "at", value)).select("k", F.col("at").alias("date"), F.lit(0).alias("i"), "out")
        _equal(_keyed(found.select("k", F.col("at").alias("date"), F.lit(0).alias("i"), "out"), "out"), _keyed(want, "out"))


def test_a_long_key_takes_many_tasks(series):
    cut = scan.segmented(series.where("k IS NOT NULL"), ["k"], "date", 50)
    sizes = {(r.k, r["_seg"]): r["count"] for r in cut.groupBy("k", "_seg").count().collect()}
    assert {k for k, s in sizes} == {"a", "b", "c"} and all(s == 0 for k, s in sizes if k != "a")
    assert len([1 for k, s in sizes if k == "a"]) >= 15 and max(sizes.values()) <= 100


def test_empty_series(series):
    none = series.limit(0)
    assert scan.drawdown(none, ["k"], "date").collect() == [] and scan.runs(none, ["k"], "date", "v").collect() == []
    assert scan.machine(none, ["k"], "date", ["r"], scan.Ema(0.1)).collect() == [] and scan.numbered(none, ["k"], "date").collect() == []


def test_ranges_grow_beyond_a_number_of_them(series):
    """Their number is bounded, whatever the rows of a range; none is cut within one time and rows carry no borders."""
    cut = scan.segmented(series.where("k = 'a'"), ["k"], "date", 1)
    each = cut.groupBy("_seg").agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("_seg").collect()
    assert 100 <= len(each) <= scan.SPREAD and set(cut.columns) == {*series.columns, "_seg"}
    assert all(x.b < y.a for x, y in zip(each, each[1:]))


@pytest.mark.parametrize("rows", [7, 10_000])
def test_runs_number_their_rows(spark, series, rows):
    some = series.where("k IS NOT NULL")
    both = scan.runs(scan.numbered(some, ["k"], "date", ("i",), rows), ["k"], "date", "v", ("i",), rows)
    _equal(_keyed(scan.runs(some, ["k"], "date", "v", ("i",), rows, pos="pos"), "pos", "run"), _keyed(both, "pos", "run"))


@pytest.mark.parametrize("rows", [2, 7, 10_000])
def test_no_return_at_a_peak_is_no_drawdown(spark, rows):
    """A product in another order would be a rounding below the peak."""
    values = [0.0003, -0.0002, 0.0004, 0.0, 0.0, 0.0001, -0.0005] * 20
    found = scan.drawdown(spark.createDataFrame([("a", i, x) for i, x in enumerate(values)], "k string, i int, r double"), ["k"], "i", "r", (), rows)
    equity, peak, under, want = 1.0, 1.0, 0, []
    for x in values:
        equity *= 1 + x
        under, peak = (0, equity) if equity >= peak * (1 - 1e-14) else (under + 1, peak)
        want.append(under)
    assert [x.under for x in found.orderBy("i").collect()] == want
