"""Parts of a panel: the same rows as parts of the whole, with filters that reach the scan."""

import pytest

from brassloom.plans import panel as P
from brassloom.sources.tables import order_bars, order_panel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("start", "end", "assets"), [("1997-01-01", "1998-06-30", None), ("1997-01-06", "1997-01-13", None), (None, "1996-02-04", ["2-HIGH"]), ("2001-07-30", None, ["1-URGENT", "none"])])
def test_parts_equal_the_whole(spark, start, end, assets):
    whole = P.between(order_panel(spark, SF), start, end)
    want = P.subset(whole, assets) if assets else whole
    got = order_panel(spark, SF, start, end, assets)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.count()


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = order_bars(spark, SF, "1997-01-01", "1998-06-30", ["5-LOW"])._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed and "o_orderpriority" in pushed
