"""Exchange sessions by rule, time-of-day windows over hourly bars, and as-of lookups of keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.operators import exchange, hours
from brassloom.operators.asof import asof_lookup
from brassloom.plans.panel import Splits
from brassloom.plans.registry import query
from brassloom.sources.tables import table

WINDOWS = [hours.Hours("early", 0, 8), hours.Hours("middle", 8, 16), hours.Hours("late", 14, 22), hours.Hours("night", 20, 4)]
SPLITS = Splits("2024-01-15", "2024-01-25")
BPS, RF = 2.0, 0.0001


@query("x_exchange_days", "date holiday weekend session early n", "", f"WITH o AS (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1) {exchange.days_sql('o')}")
def x_exchange_days(spark, d):
    """Every order date, with how many orders there are, as an exchange sees it."""
    return exchange.days(table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n")))


@query("x_orders_by_session", "date n", "", f"""WITH o AS (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT date FROM ({exchange.days_sql("(SELECT unnest(generate_series((SELECT min(date) FROM o)::TIMESTAMP, (SELECT max(date) FROM o)::TIMESTAMP + INTERVAL 10 DAY, INTERVAL 1 DAY))::DATE AS date)")}) WHERE session)
 SELECT c.date, sum(o.n)::BIGINT AS n FROM o ASOF JOIN c ON o.date <= c.date GROUP BY 1""")
def x_orders_by_session(spark, d):
    """Orders moved to the next session on or after their date: a calendar of at most ten days more than the orders span, joined by day."""
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    # No exchange has been closed for ten days in a row since 1914.
    ahead = F.explode(F.sequence(F.col("date"), F.date_add("date", 10)))
    next_session = exchange.days(o.select(F.col("date").alias("of"), ahead.alias("date"))).where("session").groupBy("of").agg(F.min("date").alias("date"))
    return o.withColumnRenamed("date", "of").join(next_session, "of").groupBy("date").agg(F.sum("n").alias("n"))


def _hourly(spark, d) -> DataFrame:
    """The last price of each hour, by whether the user's number is odd."""
    e = table(spark, d, "events").select((F.col("user_id") % 2).alias("market"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), "event_id", (100.0 + F.col("value") / 500.0).alias("px"), F.col("ts").alias("at"))
    return e.groupBy("market", "ts").agg(F.max_by("px", F.struct("at", "event_id")).alias("close"))


def _when(w: hours.Hours) -> str:
    return f"hour(ts) >= {w.first} {'AND' if w.first < w.last else 'OR'} hour(ts) < {w.last}"


_WINDOWS = " UNION ALL ".join(f"SELECT market, '{w.name}' AS variant, {f'CASE WHEN hour(ts) < {w.last} THEN ts::DATE - 1 ELSE ts::DATE END' if w.first >= w.last else 'ts::DATE'} AS date, r FROM r WHERE r IS NOT NULL AND ({_when(w)})" for w in WINDOWS)
_DAYS = f"""h AS (SELECT user_id % 2 AS market, date_trunc('hour', ts) AS ts, arg_max(1e2 + value / 5e2, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
 r AS (SELECT *, close / lag(close) OVER (PARTITION BY market ORDER BY ts) - 1e0 AS r FROM h),
 g AS (SELECT market, variant, date, product(1e0 + r) - 1e0 AS gross FROM ({_WINDOWS}) WHERE date <= DATE '{SPLITS.val_end}' GROUP BY 1, 2, 3),
 cal AS (SELECT market, variant, unnest(generate_series(min(date)::TIMESTAMP, TIMESTAMP '{SPLITS.val_end}', INTERVAL 1 DAY))::DATE AS date FROM g GROUP BY 1, 2),
 dy AS (SELECT market, variant, date, coalesce(gross, 0e0) AS gross, coalesce(gross - 2 * {BPS} / 1e4, 0e0) AS net FROM cal LEFT JOIN g USING (market, variant, date))"""


@query("k_time_of_day", "market variant split n_periods n_trades", "cagr sharpe max_dd gross_sharpe", f"""WITH {_DAYS}, splits(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '{SPLITS.dev_end}'), ('VALIDATION', DATE '{SPLITS.dev_end}' + 1, DATE '{SPLITS.val_end}'), ('DEV+VAL', DATE '1900-01-01', DATE '{SPLITS.val_end}')),
 e AS (SELECT *, product(1e0 + net) OVER (PARTITION BY market, variant, split ORDER BY date) AS eq FROM dy JOIN splits ON date BETWEEN a AND b), f AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY market, variant, split ORDER BY date), 1e0) - 1e0 AS dd FROM e)
 SELECT market, variant, split, count(*) AS n_periods, count(*) FILTER (WHERE gross <> 0) AS n_trades, CASE WHEN product(1e0 + net) > 0 THEN pow(product(1e0 + net), 3.65e2 / count(*)) - 1e0 ELSE -1e0 END AS cagr,
  CASE WHEN count(*) >= 3 AND stddev_pop(net - {RF}) > 1e-9 * max(abs(net - {RF})) THEN avg(net - {RF}) / stddev_samp(net - {RF}) * sqrt(3.65e2) END AS sharpe, min(dd) AS max_dd,
  CASE WHEN count(*) >= 3 AND stddev_pop(gross - {RF}) > 1e-9 * max(abs(gross - {RF})) THEN avg(gross - {RF}) / stddev_samp(gross - {RF}) * sqrt(3.65e2) END AS gross_sharpe FROM f GROUP BY 1, 2, 3""")
def k_time_of_day(spark, d):
    """Four windows of the day, one over midnight, on both markets and all splits."""
    return hours.score(hours.daily(_hourly(spark, d), WINDOWS, BPS, SPLITS.val_end, ["market"]), SPLITS, ["market"], 365, RF)


@query("j_asof_shared", "event_id", "last_value", """WITH v AS (SELECT date_trunc('hour', ts) AS at, event_type, max(value) AS value FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2), e AS (SELECT event_id, event_type, date_trunc('day', ts) AS day FROM events)
 SELECT e.event_id, v.value AS last_value FROM e ASOF LEFT JOIN v ON v.event_type = e.event_type AND v.at <= e.day""")
def j_asof_shared(spark, d):
    """What was known of its type when an event's day began: all events of a day and type share one lookup."""
    e = table(spark, d, "events").select("event_id", "event_type", F.date_trunc("day", "ts").cast("timestamp").alias("day"), "ts", "value", "user_id")
    known = e.where("user_id % 3 = 0").groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("at"), "event_type").agg(F.max("value").alias("last_value"))
    return asof_lookup(e.select("event_id", "event_type", "day"), known, "day", "at", ["event_type"], ["last_value"])
