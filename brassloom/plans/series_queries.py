"""Long single series: the whole line item table, or all events, as one key whose length grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.operators import metrics, quantiles, scan
from brassloom.plans.registry import query
from brassloom.sources.tables import table

#: Rows of a range in these queries: short enough that a series of some tens of thousand rows is cut.
ROWS = 10_000
#: Order and line numbers aren't unique; rows equal in all of these are interchangeable.
TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag", "r")
_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS flag, (l_discount - 5e-2) / 1e2 AS r, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount) AS n FROM lineitem)"
_EVENTS = "e AS (SELECT event_id, (value - 2.5e2) / 1e2 AS x, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)"


def _lines(spark, d) -> DataFrame:
    """Line items by ship date: their discounts, about the mean, as returns of one series."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("at"), ((F.col("l_discount") - 0.05) / 100.0).alias("r"), F.lit("all").alias("of"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", ((F.col("value") - 250.0) / 100.0).alias("x"), F.lit("all").alias("of"))


@query("g_long_drawdown", "l_orderkey l_linenumber under", "equity dd", f"""WITH {_LINES}, p AS (SELECT *, product(1e0 + r) OVER (ORDER BY n) AS equity FROM l), q AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY n), 1e0) - 1e0 AS dd FROM p)
 SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, equity, dd, n - coalesce(max(CASE WHEN dd >= 0 THEN n END) OVER (ORDER BY n), 0) AS under FROM q""")
def g_long_drawdown(spark, d):
    """Equity, drawdown and time under water of one series with every line item, cut into ranges."""
    return scan.drawdown(_lines(spark, d), ["of"], "at", "r", TIES, ROWS)


@query("g_long_runs", "l_orderkey l_linenumber pos run", "", f"WITH {_LINES} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, n - 1 AS pos, (sum(CASE WHEN flag IS DISTINCT FROM before OR n = 1 THEN 1 ELSE 0 END) OVER (ORDER BY n))::BIGINT AS run FROM (SELECT *, lag(flag) OVER (ORDER BY n) AS before FROM l)")
def g_long_runs(spark, d):
    """Positions and runs of one flag in the same series."""
    return scan.runs(_lines(spark, d), ["of"], "at", "flag", TIES, ROWS, pos="pos")


@query("f_long_ema", "event_id", "ema", f"WITH RECURSIVE {_EVENTS}, f AS (SELECT n, event_id, x AS ema FROM e WHERE n = 1 UNION ALL SELECT e.n, e.event_id, 1e-1 * e.x + 9e-1 * f.ema FROM f JOIN e ON e.n = f.n + 1) SELECT event_id, ema FROM f")
def f_long_ema(spark, d):
    """A recursive average over all events as one series: each range is an affine map."""
    return scan.machine(_events(spark, d), ["of"], "ts", ["x"], scan.Ema(0.1), ("event_id",), ROWS // 10).withColumnRenamed("out", "ema")


@query("f_long_bands", "event_id", "held", f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT n, event_id, CASE WHEN x > 1.5e0 THEN -1e0 WHEN x < -1.5e0 THEN 1e0 ELSE 0e0 END AS held FROM e WHERE n = 1
  UNION ALL SELECT e.n, e.event_id, CASE WHEN f.held = 0 THEN CASE WHEN e.x > 1.5e0 THEN -1e0 WHEN e.x < -1.5e0 THEN 1e0 ELSE 0e0 END WHEN (f.held < 0 AND e.x < 5e-1) OR (f.held > 0 AND e.x > -5e-1) THEN 0e0 ELSE f.held END FROM f JOIN e ON e.n = f.n + 1) SELECT event_id, held FROM f""")
def f_long_bands(spark, d):
    """A position between bands over all events as one series: each range is a table of states to states."""
    return scan.machine(_events(spark, d), ["of"], "ts", ["x"], scan.ThreeState(1.5, 0.5), ("event_id",), ROWS // 10).withColumnRenamed("out", "held")


@query("a_exact_quantiles", "l_returnflag", "p01 p50 p95 p999", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY 1")
def a_exact_quantiles(spark, d):
    """Quantiles of prices in three large groups; a group's values are never held in one task."""
    return quantiles.exact(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999})


@query("a_tail_mean", "flag", "cvar", f"WITH {_LINES}, q AS (SELECT flag, quantile_cont(r, 0.05) AS cut FROM l GROUP BY 1) SELECT l.flag, avg(r) FILTER (WHERE r <= cut) AS cvar FROM l JOIN q USING (flag) GROUP BY 1")
def a_tail_mean(spark, d):
    """The mean of the lowest twentieth of returns, ties at the border included."""
    return metrics.tail_mean(_lines(spark, d), ["flag"])
