"""Panels, slices, windows and joins over the weekly order panel and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brassloom.operators import windows as W
from brassloom.operators.asof import align, asof_join
from brassloom.plans import panel as P
from brassloom.plans.registry import BY, panel_sql, query, roll
from brassloom.sources.tables import event_hours, order_bars, order_panel, table

SPLITS = P.Splits()


@query("panel_dense", "date asset", "open high low close adj_close volume", panel_sql("SELECT * FROM panel"))
def panel_dense(spark, d):
    return order_panel(spark, d)


@query("panel_duplicates", "date asset count", "", "SELECT o_orderdate::DATE AS date, o_orderpriority AS asset, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def panel_duplicates(spark, d):
    return P.duplicates(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("asset")))


@query("panel_slice", "date asset", "close", panel_sql("SELECT * FROM panel WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"))
def panel_slice(spark, d):
    return order_panel(spark, d, "1997-01-01", "1998-06-30")


@query("panel_subset", "date asset", "close", panel_sql("SELECT * FROM panel WHERE asset IN ('1-URGENT', '5-LOW')"))
def panel_subset(spark, d):
    return order_panel(spark, d, assets=["1-URGENT", "5-LOW"])


@query("panel_index", "date n_assets", "", panel_sql("SELECT date, count(close) AS n_assets FROM panel GROUP BY date"))
def panel_index(spark, d):
    return order_bars(spark, d).groupBy("date").agg(F.count("close").alias("n_assets"))


@query("panel_adj_open", "date asset", "adj_open", panel_sql("SELECT date, asset, open * (adj_close / close) AS adj_open FROM panel"))
def panel_adj_open(spark, d):
    return order_panel(spark, d).withColumn("adj_open", P.adj_open())


_LABEL = "CASE WHEN date <= DATE '1998-12-31' THEN 'DEVELOPMENT' WHEN date <= DATE '2000-06-30' THEN 'VALIDATION' ELSE 'HOLDOUT' END"


@query("split_label", "split n", "", panel_sql(f"SELECT {_LABEL} AS split, count(*) AS n FROM panel GROUP BY 1"))
def split_label(spark, d):
    return order_panel(spark, d).groupBy(SPLITS.label().alias("split")).agg(F.count("*").alias("n"))


SPLIT_TABLE = "splits(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '1998-12-31'), ('VALIDATION', DATE '1999-01-01', DATE '2000-06-30'), ('DEV+VAL', DATE '1900-01-01', DATE '2000-06-30'))"


@query("split_windows", "split asset n", "mean_close", panel_sql("SELECT split, asset, count(close) AS n, avg(close) AS mean_close FROM panel JOIN splits ON date BETWEEN a AND b GROUP BY 1, 2", SPLIT_TABLE))
def split_windows(spark, d):
    return SPLITS.explode(order_panel(spark, d)).groupBy("split", "asset").agg(F.count("close").alias("n"), F.avg("close").alias("mean_close"))


@query("research_panel", "date asset", "close", panel_sql("SELECT * FROM panel WHERE date <= DATE '2000-06-30'"))
def research_panel(spark, d):
    return P.guard(order_panel(spark, d, None, SPLITS.bounds("RESEARCH")[1]), SPLITS)


_W = "w AS (SELECT date, asset, CASE WHEN volume > 2 THEN 0.3e0 WHEN volume = 1 THEN -0.1e0 ELSE 0e0 END AS weight FROM panel WHERE volume IS NOT NULL)"


@query("weight_faults", "n_short n_nonfinite n_over n_assets n_dates", "", panel_sql("""SELECT (SELECT count(*) FROM w WHERE weight < -1e-9) AS n_short, (SELECT count(*) FROM w WHERE NOT isfinite(weight)) AS n_nonfinite,
  (SELECT count(*) FROM (SELECT date, sum(abs(weight)) g FROM w GROUP BY date) WHERE g > 1e0 + 1e-6) AS n_over,
  (SELECT count(DISTINCT asset) FROM w WHERE asset NOT IN (SELECT asset FROM panel WHERE asset <> '5-LOW')) AS n_assets,
  (SELECT count(DISTINCT date) FROM w WHERE date NOT IN (SELECT date FROM panel WHERE date <= DATE '2001-01-01')) AS n_dates""", _W))
def weight_faults(spark, d):
    panel = order_panel(spark, d)
    w = panel.where("volume IS NOT NULL").select("date", "asset", F.when(F.col("volume") > 2, 0.3).when(F.col("volume") == 1, -0.1).otherwise(0.0).alias("weight"))
    known = P.between(panel.where("asset <> '5-LOW'"), None, "2001-01-01")
    # Dates and assets are checked against a panel that lacks some of both.
    return P.weight_faults(w, known)


@query("rf_monthly", "date", "rf", panel_sql("SELECT p.date, pow(1e0 + r.percent / 1e2, 1e0 / count(*) OVER (PARTITION BY date_trunc('month', p.date))) - 1e0 AS rf FROM (SELECT DISTINCT date FROM panel) p JOIN r ON r.month = date_trunc('month', p.date)::DATE",
    "r AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) / 1e6 AS percent FROM orders GROUP BY 1)"))
def rf_monthly(spark, d):
    rates = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg((F.avg("o_totalprice") / 1e6).alias("percent"))
    # The first week begins in a month without orders, so without a rate.
    return P.monthly_rf(P.between(order_panel(spark, d), "1995-01-01"), rates)


@query("rf_annual", "key date", "rf", "SELECT key, date, annual * greatest(coalesce(date - lag(date) OVER (PARTITION BY key ORDER BY date), 1), 1) / 365e0 AS rf FROM (SELECT o_orderpriority AS key, o_orderdate::DATE AS date, avg(o_totalprice) / 1e7 AS annual FROM orders GROUP BY 1, 2)")
def rf_annual(spark, d):
    daily = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e7).alias("annual"))
    return P.annual_rf(daily)


def _windowed(name: str, value, sql: str, ctes: str = ""):
    @query(name, "date asset", "x", panel_sql(f"SELECT date, asset, {sql} AS x FROM panel", ctes))
    def run(spark, d):
        return order_panel(spark, d).withColumn("x", value())

    return run


_windowed("w_shift", lambda: W.shift("close", 3), f"lag(close, 3) OVER ({BY})")
_windowed("w_diff", lambda: W.diff("close"), f"close - lag(close) OVER ({BY})")
_windowed("w_pct_change", lambda: W.pct_change("close"), f"close / lag(close) OVER ({BY}) - 1")
_windowed("w_rolling_mean", lambda: W.rolling_mean("close", 20), roll("avg", "close", 20))
_windowed("w_rolling_std", lambda: W.rolling_std("close", 12), roll("stddev_samp", "close", 12))
_windowed("w_rolling_sum", lambda: W.rolling_sum("volume", 5, least=1), roll("sum", "volume", 5, 1))
_windowed("w_lagged_mean", lambda: W.rolling_mean("close", 60, least=20, lag=2), roll("avg", "close", 60, 20, 2))
_windowed("w_cumsum", lambda: F.sum("volume").over(W.so_far()), f"sum(volume) OVER ({BY} ROWS UNBOUNDED PRECEDING)")
_windowed("w_ffill", lambda: W.ffill(F.when(F.col("volume") > 1, F.col("close"))), f"last_value(CASE WHEN volume > 1 THEN close END IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING)")
_windowed("w_equity", lambda: W.equity(0.01 * (F.col("close") - 105)), f"product(1e0 + 1e-2 * (close - 105)) OVER ({BY} ROWS UNBOUNDED PRECEDING)")


@query("w_drawdown", "date asset", "dd", panel_sql(f"SELECT date, asset, eq / greatest(max(eq) OVER ({BY} ROWS UNBOUNDED PRECEDING), 1e0) - 1 AS dd FROM e", f"e AS (SELECT date, asset, product(1e0 + 1e-2 * (close - 105)) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS eq FROM panel)"))
def w_drawdown(spark, d):
    return order_panel(spark, d).withColumn("eq", W.equity(0.01 * (F.col("close") - 105))).withColumn("dd", W.drawdown("eq"))


@query("w_month_sessions", "date asset n n_left first", "", panel_sql(f"""SELECT date, asset, row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date) AS n,
  count(*) OVER (PARTITION BY asset, date_trunc('month', date)) - row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date) AS n_left,
  coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER ({BY}), true) AS first FROM panel"""))
def w_month_sessions(spark, d):
    n, left = W.session_of_month("asset")
    return order_panel(spark, d).withColumn("n", n).withColumn("n_left", left).withColumn("first", W.first_of_month())


@query("w_cross_rank", "date asset rank", "", panel_sql("SELECT date, asset, CASE WHEN close IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY close DESC NULLS LAST, asset) END AS rank FROM panel"))
def w_cross_rank(spark, d):
    return order_panel(spark, d).withColumn("rank", W.cross_rank("close"))


@query("w_top_k", "o_orderpriority o_orderkey rank", "o_totalprice", "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def w_top_k(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    w = Window.partitionBy("o_orderpriority", "month").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("w_runs", "asset run side n_periods first last", "", panel_sql(f"SELECT asset, run, s::BIGINT AS side, count(*) AS n_periods, min(date) AS first, max(date) AS last FROM (SELECT *, sum(CASE WHEN s <> prev THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, coalesce(lag(s) OVER ({BY}), 0) AS prev FROM (SELECT date, asset, coalesce(sign(close - 105)::INT, 0) AS s FROM panel))) WHERE s <> 0 GROUP BY 1, 2, 3"))
def w_runs(spark, d):
    s = F.coalesce(F.signum(F.col("close") - 105).cast("int"), F.lit(0))
    rows = order_panel(spark, d).withColumn("side", s)
    return rows.withColumn("run", W.run_ids(F.col("side"))).where("side <> 0").groupBy("asset", "run", "side").agg(F.count("*").alias("n_periods"), F.min("date").alias("first"), F.max("date").alias("last"))


def _events(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


_E = "l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = '{0}'), r AS (SELECT user_id, ts AS at, value AS quote FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_type = '{1}') WHERE n = 1)"


@query("j_asof_tolerance", "event_id user_id", "value quote", f"WITH {_E.format('purchase', 'view')} SELECT l.event_id, l.user_id, l.value, CASE WHEN epoch(l.ts) - epoch(r.at) <= 14400 THEN r.quote END AS quote FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at")
def j_asof_tolerance(spark, d):
    right = _events(spark, d, "view").select("user_id", F.col("ts").alias("at"), F.col("value").alias("quote"), "event_id")
    return asof_join(_events(spark, d, "purchase"), right, "ts", "at", ["user_id"], ["quote"], 14_400, tie="event_id")


@query("j_asof", "event_id user_id", "value quote", f"WITH {_E.format('purchase', 'click')} SELECT l.event_id, l.user_id, l.value, r.quote FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at")
def j_asof(spark, d):
    right = _events(spark, d, "click").select("user_id", F.col("ts").alias("at"), F.col("value").alias("quote"), "event_id")
    return asof_join(_events(spark, d, "purchase"), right, "ts", "at", ["user_id"], ["quote"], tie="event_id", span=604_800)


@query("j_windowed_volume", "event_id user_id", "volume", """WITH c AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events WHERE event_type = 'view'),
 r AS (SELECT user_id, ts AS at, cum FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM c) WHERE n = 1), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
 a AS (SELECT l.*, r.cum FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at), b AS (SELECT l.event_id, r.cum AS cum6 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts - INTERVAL 6 HOUR >= r.at)
 SELECT a.event_id, a.user_id, a.cum - coalesce(b.cum6, 0) AS volume FROM a JOIN b USING (event_id)""")
def j_windowed_volume(spark, d):
    """Volume of the six hours before: the difference of two as-of lookups of a running sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = _events(spark, d, "view").withColumn("cum", F.sum("value").over(w)).select("user_id", F.col("ts").alias("at"), "cum", "event_id")
    left = _events(spark, d, "purchase").select("event_id", "user_id", "ts").withColumn("ts6", F.col("ts") - F.expr("INTERVAL 6 HOURS"))
    now = asof_join(left, cum, "ts", "at", ["user_id"], ["cum"], tie="event_id")
    before = asof_join(now, cum.withColumnRenamed("cum", "cum6"), "ts6", "at", ["user_id"], ["cum6"], tie="event_id")
    return before.withColumn("volume", F.col("cum") - F.coalesce("cum6", F.lit(0.0)))


@query("j_align_ffill", "date asset", "rate", panel_sql("SELECT p.date, p.asset, m.rate FROM panel p ASOF LEFT JOIN m ON p.asset = m.asset AND p.date >= m.date", "m AS (SELECT o_orderpriority AS asset, date_trunc('month', o_orderdate)::DATE AS date, avg(o_totalprice) AS rate FROM orders GROUP BY 1, 2)"))
def j_align_ffill(spark, d):
    monthly = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("rate"))
    return align(order_panel(spark, d).select("date", "asset"), monthly, ["asset"], "date", ["rate"], span=180)


@query("j_common_dates", "date", "a b", panel_sql("SELECT x.date, x.close AS a, y.close AS b FROM panel x JOIN panel y ON x.date = y.date AND x.asset = '1-URGENT' AND y.asset = '2-HIGH' WHERE x.close IS NOT NULL AND y.close IS NOT NULL"))
def j_common_dates(spark, d):
    bars = order_bars(spark, d)
    one, two = (bars.where(F.col("asset") == a).select("date", F.col("close").alias(n)) for a, n in (("1-URGENT", "a"), ("2-HIGH", "b")))
    return one.join(two, "date").dropna()


@query("j_calendar_union", "date n_orders n_events", "", "SELECT coalesce(o.date, e.date) AS date, coalesce(n_orders, 0) AS n_orders, coalesce(n_events, 0) AS n_events FROM (SELECT o_orderdate::DATE AS date, count(*) AS n_orders FROM orders GROUP BY 1) o FULL JOIN (SELECT ts::DATE AS date, count(*) AS n_events FROM events GROUP BY 1) e ON o.date = e.date")
def j_calendar_union(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_orders"))
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n_events"))
    return o.join(e, "date", "full").fillna(0)


@query("j_anti_fetched", "c_custkey", "c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j_anti_fetched(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").where("c_acctbal > 0").join(done, "c_custkey", "left_anti")


@query("j_left_bias", "o_orderkey", "o_totalprice c_acctbal", "SELECT o_orderkey, o_totalprice, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j_left_bias(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")


@query("u_keep_first", "o_custkey o_orderkey", "o_totalprice", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def u_keep_first(spark, d):
    """Dedupe that keeps the first row: a minimum of structs, which Spark combines before the shuffle, instead of a window."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("s")).select("o_custkey", "s.o_orderkey", "s.o_totalprice")


@query("u_union_dates", "date", "", "SELECT o_orderdate::DATE AS date FROM orders UNION SELECT l_shipdate::DATE FROM lineitem")
def u_union_dates(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return o.union(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()).distinct()


@query("u_date_difference", "date", "", "SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)")
def u_date_difference(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().join(o, "date", "left_anti")


@query("u_top_n", "o_orderkey", "o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def u_top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("u_sample", "o_orderkey", "", "SELECT o_orderkey FROM orders ORDER BY md5('0:' || o_orderkey::VARCHAR), o_orderkey LIMIT 40")
def u_sample(spark, d):
    """A seeded sample without replacement: the rows with the smallest hashes of seed and key."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("0:"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey").limit(40)


@query("t_hour_filter", "asset n", "value", "SELECT event_type AS asset, count(*) AS n, sum(value) AS value FROM events WHERE hour(ts) >= 8 AND hour(ts) < 16 GROUP BY 1")
def t_hour_filter(spark, d):
    e = table(spark, d, "events").where((F.hour("ts") >= 8) & (F.hour("ts") < 16))
    return e.groupBy(F.col("event_type").alias("asset")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


_HOURS = "h AS (SELECT date_trunc('hour', ts) AS ts, event_type AS asset, sum(value) AS value FROM events GROUP BY 1, 2), r AS (SELECT ts, asset, 1e-3 * (value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1) AS r FROM h)"


def _hourly(spark, d):
    w = Window.partitionBy("asset").orderBy("ts")
    return event_hours(spark, d).withColumn("r", 0.001 * W.pct_change("value", 1, w))


@query("t_by_hour", "asset hour n", "mean", f"WITH {_HOURS} SELECT asset, hour(ts) AS hour, count(r) AS n, avg(r) AS mean FROM r GROUP BY 1, 2")
def t_by_hour(spark, d):
    return _hourly(spark, d).groupBy("asset", F.hour("ts").alias("hour")).agg(F.count("r").alias("n"), F.avg("r").alias("mean"))


@query("t_session_returns", "asset date", "ret", f"WITH {_HOURS} SELECT asset, ts::DATE AS date, product(1e0 + r) - 1 AS ret FROM r WHERE hour(ts) >= 8 AND hour(ts) < 16 AND r IS NOT NULL GROUP BY 1, 2")
def t_session_returns(spark, d):
    rows = _hourly(spark, d).where((F.hour("ts") >= 8) & (F.hour("ts") < 16) & F.col("r").isNotNull())
    return rows.groupBy("asset", F.to_date("ts").alias("date")).agg((F.product(1 + F.col("r")) - 1).alias("ret"))
