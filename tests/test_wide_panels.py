"""Panels whose assets grow with the tables: bars are shuffled by asset, totals of a date are partial aggregates, and the rows are those of the plain forms."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from brassloom.operators import backtest as B
from brassloom.operators.windows import ffill
from brassloom.plans import panel as P
from brassloom.plans import registry, strategy_queries

SF = "/root/testdata/sf0.001"
DAYS = [dt.date(2000, 1, 1) + dt.timedelta(days=k * k) for k in range(9)]
ODD = [
    (DAYS[2], "late", 1.0), (DAYS[5], "late", None), (DAYS[6], "late", 2.0),
    (DAYS[0], "twice", 3.0), (DAYS[4], "twice", 4.0), (DAYS[4], "twice", 4.0),
    (DAYS[1], "nulls", None), (DAYS[3], "nulls", None), (None, "undated", 5.0), (None, "partly", 6.0), (DAYS[3], "partly", 7.0),
    (DAYS[7], None, 8.0), (DAYS[8], "last", 9.0),
]


def _joined(bars, dates=None, assets=None):
    """The grid as every asset times every date, joined to the bars."""
    grid = (assets or bars).select("asset").distinct().crossJoin((dates or bars).select("date").where("date IS NOT NULL").distinct())
    bars = bars.withColumn("adj_close", F.col("close")).withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low", "volume")})
    return grid.join(bars, ["date", "asset"], "left").select("date", "asset", *P.FIELDS)


def _same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()


@pytest.mark.parametrize("part", [1_000_000, 3])
def test_densify_equals_the_join(spark, monkeypatch, part):
    monkeypatch.setattr(P, "PART", part)
    bars = spark.createDataFrame(ODD, "date date, asset string, close double")
    dates = spark.createDataFrame([(DAYS[k],) for k in (1, 3, 4)] + [(dt.date(2001, 1, 1),)], "date date")
    assets = spark.createDataFrame([(a,) for a in ("late", "twice", "partly", "none")], "asset string")
    _same(P.densify(bars), _joined(bars))
    _same(P.densify(bars, dates), _joined(bars, dates))
    _same(P.densify(bars, None, assets), _joined(bars, None, assets))
    _same(P.densify(bars, dates, assets), _joined(bars, dates, assets))


def test_carried_fields_are_filled(spark):
    bars = spark.createDataFrame(ODD, "date date, asset string, close double").where("asset IS NOT NULL").distinct()
    _same(P.densify(bars, carried=("close",)), _joined(bars).withColumn("close", ffill("close")))


def test_large_panels_have_more_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 10)
    rows = [(d, f"a{i}", 1.0) for d in DAYS for i in range(40)]
    assert P.densify(spark.createDataFrame(rows, "date date, asset string, close double")).rdd.getNumPartitions() > 20


def _rows(spark, short):
    rng, out = random.Random(5), []
    for v in ("a", "b"):
        for i in range(7):
            for k, d in enumerate(DAYS):
                price = None if k < i % 3 else rng.uniform(5, 9)
                out.append((v, d, f"s{i}", price, price, price, rng.uniform(-0.1 if short else 0, 0.14), 0.0004))
    return spark.createDataFrame(out, "variant string, date date, asset string, open double, close double, adj_close double, weight double, rf double")


@pytest.mark.parametrize("mode", B.MODES)
@pytest.mark.parametrize("limit", [1.0, None, "column"])
def test_wide_equals_windows(spark, mode, limit):
    rows, rules = _rows(spark, True), B.Rules(max_gross=F.lit(1.0) if limit == "column" else limit, allow_short=True, splits=None)
    keys = ["variant", "date", "asset"]
    plain, wide = (sorted(B.simulate(rows, mode, rules=rules, wide=w).collect(), key=lambda r: [r[k] for k in keys]) for w in (False, True))
    assert len(plain) == len(wide) == rows.count()
    for a, b in zip(plain, wide):
        assert set(a.asDict()) == set(b.asDict())
        for c, x in a.asDict().items():
            assert b[c] == (pytest.approx(x, rel=1e-9, abs=1e-13) if isinstance(x, float) else x), c


@pytest.mark.parametrize("column", [False, True])
def test_wide_refuses_too_much(spark, column):
    limit = F.lit(0.3) if column else 0.3
    with pytest.raises(Exception, match="gross exposure is over"):
        B.periods(B.simulate(_rows(spark, False), "next_close", rules=B.Rules(max_gross=limit, splits=None), wide=True)).collect()


def test_suppliers_have_no_window_over_a_date(spark):
    plan = registry.QUERIES[strategy_queries.flagship_suppliers.__name__](spark, SF)._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert specs and not any(re.search(r"date#\d+(?! (ASC|DESC))\b", spec) for spec in specs)
