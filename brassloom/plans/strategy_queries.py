"""Signals, simulation, metrics and statistics over the weekly order panel: the strategy-evaluation pipeline."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.functions.normal import cdf_sql, quantile_sql
from brassloom.operators import backtest as B
from brassloom.operators import folds, metrics, resample, signals, stats
from brassloom.operators.runner import Trial, score, trial_rows
from brassloom.operators.verdict import evaluate, markdown, report_lines, summary_lines
from brassloom.plans.panel import Splits, stored
from brassloom.plans.registry import BY, PANEL, panel_sql, query, roll
from brassloom.sources.tables import order_panel, supplier_panel, table

PPY = 52
SPLITS = Splits()
ASSETS = 5
_FLAG = "CASE WHEN {0} THEN 1e0 ELSE 0e0 END"


def _flag(x: str) -> str:
    return _FLAG.format(f"coalesce({x}, false)")


def _monthly(x: str) -> str:
    """A month's first decision carried on: over rows (date, asset, weight)."""
    return f"coalesce(last_value(CASE WHEN first THEN weight END IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0e0)"


_FIRST = f"coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER ({BY}), true) AS first"


def _signal(name: str, build, sql: str, ctes: str = "", source: str = "panel"):
    @query(name, "date asset", "weight", panel_sql(f"SELECT date, asset, {sql} AS weight FROM {source}", ctes))
    def run(spark, d):
        return build(order_panel(spark, d))

    return run


_signal("x_price_above_sma", lambda p: signals.price_above_sma(p, 20), _flag(f"adj_close > {roll('avg', 'adj_close', 20)}"))
_signal("x_momentum_sign", lambda p: signals.momentum_sign(p, 13), _flag(f"adj_close / lag(adj_close, 13) OVER ({BY}) - 1 > 0"))
_signal("x_sma_cross", lambda p: signals.sma_cross(p, 5, 20), _flag(f"{roll('avg', 'adj_close', 5)} > {roll('avg', 'adj_close', 20)}"))
_TREND = f"t AS (SELECT date, asset, {_FIRST}, {_flag('adj_close > ' + roll('avg', 'adj_close', 20))} / 5e0 AS weight FROM panel)"
_signal("x_equal_slot_trend", lambda p: signals.equal_slot_trend(p, 20, ASSETS), _monthly(""), _TREND, "t")
_XS = f"m AS (SELECT date, asset, lag(adj_close, 4) OVER ({BY}) / lag(adj_close, 26) OVER ({BY}) - 1 AS mom FROM panel), k AS (SELECT date, asset, mom, CASE WHEN mom IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, asset) END AS r FROM m), t AS (SELECT date, asset, {_FIRST}, {_flag('r <= 2 AND mom > 0')} / 2e0 AS weight FROM k)"
_signal("x_xs_momentum", lambda p: signals.xs_momentum(p, 26, 4, 2, True), _monthly(""), _XS, "t")
_signal("x_xs_momentum_weekly", lambda p: signals.xs_momentum(p, 26, 0, 1, False, False), "weight", f"m AS (SELECT date, asset, adj_close / lag(adj_close, 26) OVER ({BY}) - 1 AS mom FROM panel), t AS (SELECT date, asset, {_flag('CASE WHEN mom IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, asset) END <= 1')} AS weight FROM m)", "t")
_IBS = "(close - low) / nullif(high - low, 0) < 3e-1"
_signal("x_ibs_reversal", lambda p: signals.ibs_reversal(p, 0.3), _flag(_IBS))
_signal("x_ibs_trend", lambda p: signals.ibs_reversal(p, 0.3, 20), _flag(f"{_IBS} AND adj_close > {roll('avg', 'adj_close', 20)}"))
_VOL = f"r AS (SELECT *, adj_close / lag(adj_close) OVER ({BY}) - 1 AS ret FROM panel), v AS (SELECT *, {roll('stddev_samp', 'ret', 12)} AS vol FROM r)"
_VW = "CASE WHEN vol IS NULL THEN 0e0 WHEN vol = 0 THEN 1e0 ELSE least(1.5e-1 / (vol * sqrt(52e0)), 1e0) END"
_signal("x_vol_target", lambda p: signals.vol_target(p, 0.15, 12, PPY), _monthly(""), f"{_VOL}, t AS (SELECT date, asset, {_FIRST}, {_VW} AS weight FROM v)", "t")
_signal("x_trend_and_vol", lambda p: signals.trend_and_vol(p, 20, 0.15, 12, PPY), f"{_monthly('')} * up", f"{_VOL}, t AS (SELECT date, asset, {_FIRST}, {_VW} AS weight, {_flag('adj_close > ' + roll('avg', 'adj_close', 20))} AS up FROM v)", "t")
_signal("x_trend_vol_weekly", lambda p: signals.trend_and_vol(p, 20, 0.15, 12, PPY, False), f"{_VW} * {_flag('adj_close > ' + roll('avg', 'adj_close', 20))}", _VOL, "v")
_IV = f"{_VOL}, i AS (SELECT *, CASE WHEN vol > 0 THEN 1e0 / vol END AS iv FROM v), t AS (SELECT date, asset, {_FIRST}, coalesce({_flag('adj_close > ' + roll('avg', 'adj_close', 20))} * iv / sum(iv) OVER (PARTITION BY date), 0e0) AS weight FROM i)"
_signal("x_inverse_vol_slots", lambda p: signals.inverse_vol_slots(p, 20, 12), _monthly(""), _IV, "t")
_signal("x_turn_of_month", lambda p: signals.turn_of_month(p, 2), _flag("row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date DESC) = 1 OR row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date) <= 1"))


@query("x_turn_of_month_calendar", "date asset", "weight", panel_sql("SELECT p.date, p.asset, CASE WHEN c.r = 1 OR c.n <= 1 THEN 1e0 ELSE 0e0 END AS weight FROM panel p LEFT JOIN (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS n, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS r FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)) c ON c.date = p.date"))
def x_turn_of_month_calendar(spark, d):
    """Sessions counted on a calendar of its own, the ship dates."""
    calendar = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return signals.turn_of_month(order_panel(spark, d), 2, calendar)


_signal("x_always_long", lambda p: signals.always_long(p), "1e0")
_signal("x_scaled", lambda p: signals.scaled(signals.price_above_sma(p, 20), 0.5), f"5e-1 * {_flag('adj_close > ' + roll('avg', 'adj_close', 20))}")


@query("x_day_of_week", "date asset", "weight", "SELECT o_orderdate::DATE AS date, o_orderpriority AS asset, CASE WHEN isodow(o_orderdate) - 1 IN (4, 5) THEN 1e0 ELSE 0e0 END AS weight FROM orders GROUP BY 1, 2, 3")
def x_day_of_week(spark, d):
    daily = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("asset")).distinct()
    return signals.day_of_week(daily, (4, 5))


_TERM = "x AS (SELECT p.date, p.asset, p.adj_close, f.close AS front, CASE WHEN b.volume > 1 THEN b.close END AS back FROM panel p JOIN panel f ON f.date = p.date AND f.asset = '4-NOT SPECIFIED' JOIN panel b ON b.date = p.date AND b.asset = '5-LOW'), y AS (SELECT *, last_value(front IGNORE NULLS) OVER w AS ff, last_value(back IGNORE NULLS) OVER w AS bb FROM x WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING))"


def _with_terms(p: DataFrame) -> DataFrame:
    front = p.where("asset = '4-NOT SPECIFIED'").select("date", F.col("close").alias("front"))
    back = p.where("asset = '5-LOW'").select("date", F.when(F.col("volume") > 1, F.col("close")).alias("back"))
    return p.join(front, "date").join(back, "date")


_signal("x_short_vol_term", lambda p: signals.term_structure(_with_terms(p), "front", "back", 1.0, 0.25, 108.0), f"2.5e-1 * {_flag('ff / bb < 1e0 AND ff < 108e0')}", _TERM, "y")
_signal("x_contango_filter", lambda p: signals.term_structure(_with_terms(p), "front", "back", 1.01), _flag("ff / bb < 1.01e0"), _TERM, "y")


_MOVES = f"z AS (SELECT date, asset, adj_close, adj_close - lag(adj_close) OVER ({BY}) AS d, row_number() OVER ({BY}) AS n FROM panel)"
_RSI = f"""{_MOVES}, f AS (SELECT asset, date, n, CASE WHEN d IS NULL THEN NULL ELSE greatest(d, 0e0) END AS u, CASE WHEN d IS NULL THEN NULL ELSE greatest(-d, 0e0) END AS dn, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS c FROM z WHERE n = 1
  UNION ALL SELECT z.asset, z.date, z.n, CASE WHEN z.d IS NULL THEN f.u ELSE coalesce(5e-1 * greatest(z.d, 0e0) + 5e-1 * f.u, greatest(z.d, 0e0)) END, CASE WHEN z.d IS NULL THEN f.dn ELSE coalesce(5e-1 * greatest(-z.d, 0e0) + 5e-1 * f.dn, greatest(-z.d, 0e0)) END, f.c + CASE WHEN z.d IS NULL THEN 0 ELSE 1 END
  FROM f JOIN z ON z.asset = f.asset AND z.n = f.n + 1), i AS (SELECT date, asset, CASE WHEN c >= 2 AND dn <> 0 THEN 1e2 - 1e2 / (1e0 + u / dn) END AS rsi FROM f)"""


@query("f_rsi", "date asset", "rsi", f"WITH RECURSIVE {PANEL}, {_RSI} SELECT * FROM i")
def f_rsi(spark, d):
    return signals.rsi(order_panel(spark, d), 2)


_REV = f"{_RSI}, e AS (SELECT p.date, p.asset, row_number() OVER (PARTITION BY p.asset ORDER BY p.date) AS n, coalesce(rsi < 2.5e1 AND adj_close > {roll('avg', 'adj_close', 20, by='PARTITION BY p.asset ORDER BY p.date')}, false) AS go, coalesce(adj_close > {roll('avg', 'adj_close', 5, by='PARTITION BY p.asset ORDER BY p.date')}, false) AS stop FROM panel p JOIN i ON i.date = p.date AND i.asset = p.asset), h AS (SELECT date, asset, n, CASE WHEN go THEN 1e0 ELSE 0e0 END AS weight FROM e WHERE n = 1 UNION ALL SELECT e.date, e.asset, e.n, CASE WHEN h.weight = 0 THEN CASE WHEN e.go THEN 1e0 ELSE 0e0 END ELSE CASE WHEN e.stop THEN 0e0 ELSE 1e0 END END FROM h JOIN e ON e.asset = h.asset AND e.n = h.n + 1)"


@query("x_rsi_reversal", "date asset", "weight", f"WITH RECURSIVE {PANEL}, {_REV} SELECT date, asset, weight FROM h")
def x_rsi_reversal(spark, d):
    return signals.rsi_reversal(order_panel(spark, d), 2, 25.0, 5, 20)


@query("f_ema", "date asset", "x", f"WITH RECURSIVE {PANEL}, z AS (SELECT date, asset, close, row_number() OVER ({BY}) AS n FROM panel), f AS (SELECT asset, date, n, close AS x FROM z WHERE n = 1 UNION ALL SELECT z.asset, z.date, z.n, CASE WHEN z.close IS NULL THEN f.x ELSE coalesce(1e-1 * z.close + 9e-1 * f.x, z.close) END FROM f JOIN z ON z.asset = f.asset AND z.n = f.n + 1) SELECT * FROM f")
def f_ema(spark, d):
    return folds.ema(order_panel(spark, d), ["asset"], "date", "close", 0.1).withColumnRenamed("out", "x")


def _pair_sql(a: str, b: str) -> str:
    """The held side f (n, date, held, shown) of a pair's spread, as recursive CTEs over panel."""
    return f"""q AS (SELECT x.date, 'p' AS asset, ln(x.adj_close) - ln(y.adj_close) AS s FROM panel x JOIN panel y ON x.date = y.date AND x.asset = '{a}' AND y.asset = '{b}'),
 z AS (SELECT date, row_number() OVER (ORDER BY date) AS n, (s - {roll('avg', 's', 26)}) / nullif({roll('stddev_samp', 's', 26)}, 0) AS z FROM q),
 f AS (SELECT date, n, CASE WHEN z > 1e0 THEN -1e0 WHEN z < -1e0 THEN 1e0 ELSE 0e0 END AS held, CASE WHEN z IS NULL THEN 0e0 WHEN z > 1e0 THEN -1e0 WHEN z < -1e0 THEN 1e0 ELSE 0e0 END AS shown FROM z WHERE n = 1
  UNION ALL SELECT date, n, held, CASE WHEN gap THEN 0e0 ELSE held END FROM (SELECT z.date, z.n, z.z IS NULL AS gap, CASE WHEN z.z IS NULL THEN f.held WHEN f.held = 0 THEN CASE WHEN z.z > 1e0 THEN -1e0 WHEN z.z < -1e0 THEN 1e0 ELSE 0e0 END WHEN (f.held < 0 AND z.z < 5e-1) OR (f.held > 0 AND z.z > -5e-1) THEN 0e0 ELSE f.held END AS held FROM f JOIN z ON z.n = f.n + 1))"""


_PAIR = _pair_sql("1-URGENT", "2-HIGH")


@query("x_pairs_zscore", "date asset", "weight", f"WITH RECURSIVE {PANEL}, {_PAIR} SELECT date, '1-URGENT' AS asset, 5e-1 * shown AS weight FROM f UNION ALL SELECT date, '2-HIGH', -5e-1 * shown FROM f")
def x_pairs_zscore(spark, d):
    return signals.pairs_zscore(order_panel(spark, d), "1-URGENT", "2-HIGH", 26, 1.0)


# --- simulation: its steps in SQL, one text per execution mode -------------------------------------------------------

_WEIGHTS = f"wt AS (SELECT *, {_flag('adj_close > ' + roll('avg', 'adj_close', 20))} / 5e0 * CASE asset WHEN '5-LOW' THEN -1e0 ELSE 1e0 END AS weight FROM panel)"


def _trend_rows(spark, d) -> DataFrame:
    """A trend signal in equal slots, short in one asset so that borrowing is charged as well."""
    rows = signals.price_above_sma(order_panel(spark, d), 20)
    sign = F.when(F.col("asset") == "5-LOW", -1.0).otherwise(1.0)
    return rows.withColumn("weight", F.col("weight") / ASSETS * sign).withColumn("variant", F.lit("trend20")).withColumn("rf", F.lit(0.0008))


def _sim(mode: str) -> str:
    lag = lambda k: f"coalesce(lag(w, {k}) OVER ({BY}), 0e0)"
    pos, prev = ("w", lag(1)) if mode == "same_close" else (lag(1), lag(2))
    ov = f"coalesce({'open * (adj_close / close)' if mode == 'next_open' else 'adj_close'} / lag(adj_close) OVER ({BY}) - 1e0, 0e0)"
    intr = "coalesce(adj_close / (open * (adj_close / close)) - 1e0, 0e0)" if mode == "next_open" else "0e0"
    held = "(prev + pos) / 2e0" if mode == "next_open" else "prev"
    return f"""{_WEIGHTS}, s0 AS (SELECT *, CASE WHEN adj_close IS NULL THEN 0e0 ELSE weight END AS w, (date - lag(date) OVER ({BY}))::DOUBLE AS dd FROM wt),
 s1 AS (SELECT *, greatest(coalesce(dd, median(dd) OVER (PARTITION BY asset)), 1e0) AS days, {pos} AS pos, {prev} AS prev, {ov} AS ov, {intr} AS intr FROM s0),
 s2 AS (SELECT *, prev * ov AS part_prev, {held} AS held FROM s1),
 s3 AS (SELECT *, sum(part_prev) OVER d AS before, sum(greatest(prev, 0e0)) OVER d AS long_prev, sum(greatest(held, 0e0)) OVER d AS long_held FROM s2 WINDOW d AS (PARTITION BY date)),
 s4 AS (SELECT *, pos * intr * (1e0 + before) AS part_new, pos - prev * (1e0 + ov) / greatest(1e0 + before + greatest(1e0 - long_prev, 0e0) * 8e-4, 1e-6) AS trade FROM s3),
 s5 AS (SELECT *, CASE WHEN abs(trade) > 1e-9 THEN abs(trade) ELSE 0e0 END AS turnover FROM s4),
 s6 AS (SELECT *, turnover * 2e0 / 1e4 AS trading, CASE WHEN turnover > 0 THEN greatest(-trade, 0e0) ELSE 0e0 END * (2.78e1 / 1e6 + coalesce(1.66e-4 / nullif(close, 0), 0e0)) AS regulatory,
   CASE WHEN turnover > 0 THEN 1e0 / 5e3 ELSE 0e0 END AS commission, greatest(-held, 0e0) * days / 365e0 * 5e1 / 1e4 AS borrow, greatest(long_held - 1e0, 0e0) * 6e-2 * days / 365e0 AS fin,
   greatest(1e0 - long_held, 0e0) * (8e-4 - 2.5e-3 * days / 365e0) AS cash FROM s5),
 sim AS (SELECT *, trading + regulatory + commission + borrow + coalesce(greatest(held, 0e0) / nullif(long_held, 0), 0e0) * fin AS cost FROM s6)"""


_COST = B.Costs(commission_usd=1.0)
#: These queries report on the whole table, so the holdout is open; one asset is held short.
WHOLE = B.Rules(allow_short=True, opened=True)
_PERIODS = "per AS (SELECT date, sum(part_prev + part_new) + any_value(cash) AS gross, sum(trading) AS trading, sum(regulatory) AS regulatory, sum(commission) AS commission, sum(borrow) AS borrow, any_value(fin) AS financing, sum(turnover) AS turnover, sum(abs(pos)) AS exposure, sum(trading) + sum(regulatory) + sum(commission) + sum(borrow) + any_value(fin) AS costs FROM sim GROUP BY date), net AS (SELECT *, gross - costs AS net FROM per)"

for _mode in B.MODES:

    @query(f"b_{_mode}", "date", "gross net trading regulatory commission borrow financing turnover exposure", panel_sql("SELECT * FROM net", f"{_sim(_mode)}, {_PERIODS}"))
    def b_periods(spark, d, mode=_mode):
        return B.periods(B.simulate(_trend_rows(spark, d), mode, _COST, rules=WHOLE))

    @query(f"b_positions_{_mode}", "date asset", "pos trade turnover cost part_prev part_new", panel_sql("SELECT * FROM sim", _sim(_mode)))
    def b_positions(spark, d, mode=_mode):
        return B.simulate(_trend_rows(spark, d), mode, _COST, rules=WHOLE)


_EPISODES = f"""g0 AS (SELECT *, CASE WHEN abs(pos) < 1e-9 THEN 0 ELSE sign(pos)::INT END AS sg, lead(date) OVER ({BY}) AS nd FROM sim),
 g1 AS (SELECT *, coalesce(lag(sg) OVER ({BY}), 0) AS psg FROM g0), g2 AS (SELECT *, sum(CASE WHEN sg <> psg THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS run FROM g1),
 g3 AS (SELECT *, coalesce(lag(run) OVER ({BY}), 0) AS prun FROM g2),
 pn AS (SELECT asset, run, sum(v) AS pnl FROM (SELECT asset, prun AS run, part_prev AS v FROM g3 UNION ALL SELECT asset, run, part_new FROM g3 UNION ALL SELECT asset, CASE WHEN sg <> 0 THEN run ELSE prun END, -cost FROM g3) GROUP BY 1, 2),
 hd AS (SELECT asset, run, any_value(sg) AS sg, min(date) AS entry, max(date) AS last, arg_max(coalesce(nd, DATE '2999-01-01'), date) AS after, count(*) AS periods, avg(abs(pos)) AS avg_alloc FROM g3 WHERE sg <> 0 GROUP BY 1, 2),
 ep AS (SELECT hd.asset, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, entry, CASE WHEN after = DATE '2999-01-01' THEN last ELSE after END AS exit, periods, avg_alloc, pnl, pnl / avg_alloc AS ret_on_alloc, after = DATE '2999-01-01' AS still_open FROM hd JOIN pn ON hd.asset = pn.asset AND hd.run = pn.run)"""


@query("g_episodes", "asset side entry exit periods still_open", "avg_alloc pnl ret_on_alloc", panel_sql("SELECT * FROM ep", f"{_sim('next_open')}, {_EPISODES}"))
def g_episodes(spark, d):
    return B.episodes(B.simulate(_trend_rows(spark, d), "next_open", _COST, rules=WHOLE))


_SPLITS = "splits(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '1998-12-31'), ('VALIDATION', DATE '1999-01-01', DATE '2000-06-30'), ('DEV+VAL', DATE '1900-01-01', DATE '2000-06-30'))"


@query("b_result_summary", "split n_periods n_trades", "cagr sharpe max_dd ann_turnover ann_cost_drag exposure", panel_sql("SELECT rs.*, coalesce(nt.n, 0) AS n_trades FROM rs LEFT JOIN (SELECT split, count(*) AS n FROM ep JOIN splits ON entry BETWEEN a AND b GROUP BY 1) nt ON nt.split = rs.split", f"{_sim('next_open')}, {_PERIODS}, {_EPISODES}, {_SPLITS}, re AS (SELECT split, per.*, gross - costs AS r, product(1e0 + gross - costs) OVER (PARTITION BY split ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM per JOIN splits ON date BETWEEN a AND b), rs AS (SELECT split, count(*) AS n_periods, pow(product(1e0 + r), 52e0 / count(r)) - 1e0 AS cagr, CASE WHEN stddev_pop(r - 8e-4) > 1e-9 * max(abs(r - 8e-4)) THEN avg(r - 8e-4) / stddev_samp(r - 8e-4) END * sqrt(52e0) AS sharpe, min(dd) AS max_dd, avg(turnover) * 52 AS ann_turnover, avg(costs) * 52 AS ann_cost_drag, avg(exposure) AS exposure FROM (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY split ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1e0 AS dd FROM re) GROUP BY 1)"))
def b_result_summary(spark, d):
    """A result by split: metrics, trades entered in it, yearly turnover and costs, exposure."""
    sim = B.simulate(_trend_rows(spark, d), "next_open", _COST, rules=WHOLE)
    return B.summary(B.periods(sim), B.episodes(sim), SPLITS, PPY)


@query("b_sliced_trades", "asset side entry exit", "pnl", panel_sql("SELECT * FROM ep WHERE entry BETWEEN DATE '1999-01-01' AND DATE '2000-06-30'", f"{_sim('next_open')}, {_EPISODES}"))
def b_sliced_trades(spark, d):
    """The trades that were entered in validation, whenever they ended."""
    return B.sliced(B.episodes(B.simulate(_trend_rows(spark, d), "next_open", _COST, rules=WHOLE)), *SPLITS.bounds("VALIDATION"), "entry")


@query("b_buy_and_hold", "date", "gross net", panel_sql("SELECT * FROM net", f"{_sim('next_close').replace(_WEIGHTS, 'wt AS (SELECT *, CASE asset WHEN ' + chr(39) + '1-URGENT' + chr(39) + ' THEN 1e0 ELSE 0e0 END AS weight FROM panel)')}, {_PERIODS}"))
def b_buy_and_hold(spark, d):
    rows = signals.always_long(order_panel(spark, d)).withColumn("weight", F.when(F.col("asset") == "1-URGENT", 1.0).otherwise(0.0))
    return B.periods(B.simulate(rows.withColumn("variant", F.lit("hold")).withColumn("rf", F.lit(0.0008)), "next_close", _COST, rules=WHOLE))


_SESSION = f"""{_WEIGHTS}, s0 AS (SELECT *, CASE WHEN adj_close IS NULL THEN 0e0 ELSE weight END AS w FROM wt), s1 AS (SELECT *, coalesce(lag(w) OVER ({BY}), 0e0) AS pos, open * (adj_close / close) AS o, greatest(coalesce(date - lag(date) OVER ({BY}), 1), 1)::DOUBLE AS days, lag(adj_close) OVER ({BY}) AS lc FROM s0),
 s2 AS (SELECT *, pos * coalesce(__LEG__, 0e0) AS part, abs(pos) * 4e0 / 1e4 AS trading, abs(pos) * (2.78e1 / 1e6 + coalesce(1.66e-4 / nullif(close, 0), 0e0)) AS regulatory, greatest(1e0 - sum(greatest(pos, 0e0)) OVER (PARTITION BY date), 0e0) * (8e-4 - 2.5e-3 * days / 365e0) AS cash FROM s1)"""
for _session, _part in (("overnight", "o / lc - 1e0"), ("intraday", "adj_close / o - 1e0")):

    @query(f"b_session_{_session}", "date", "gross net turnover", panel_sql("SELECT date, sum(part) + any_value(cash) AS gross, sum(part) + any_value(cash) - sum(trading) - sum(regulatory) AS net, 2 * sum(abs(pos)) AS turnover FROM s2 GROUP BY date", _SESSION.replace("__LEG__", _part)))
    def b_session(spark, d, session=_session):
        return B.session_periods(B.session_only(_trend_rows(spark, d), session, rules=WHOLE))

    @query(f"b_session_trades_{_session}", "date asset side", "avg_alloc pnl", panel_sql("SELECT date, asset, CASE WHEN pos > 0 THEN 'long' ELSE 'short' END AS side, abs(pos) AS avg_alloc, part - trading - regulatory AS pnl FROM s2 WHERE abs(pos) > 1e-9", _SESSION.replace("__LEG__", _part)))
    def b_session_trades(spark, d, session=_session):
        return B.session_trades(B.session_only(_trend_rows(spark, d), session, rules=WHOLE)).withColumnRenamed("entry", "date")


def look_ahead_cuts(spark, d):
    """Fifteen cut dates, chosen by a hash of the date."""
    dates = order_panel(spark, d).select("date").distinct()
    return dates.orderBy(F.md5(F.concat(F.lit("0:"), F.col("date").cast("string")).cast("binary"))).limit(15)


@query("b_look_ahead", "date asset", "whole part", "SELECT NULL::DATE AS date, NULL::VARCHAR AS asset, 0e0 AS whole, 0e0 AS part FROM orders WHERE false")
def b_look_ahead(spark, d):
    """Weights that change when later bars are cut off: none, for a sound builder."""
    return B.look_ahead(lambda p: signals.price_above_sma(p, 20), order_panel(spark, d), look_ahead_cuts(spark, d)).withColumnRenamed("full", "whole")


@query("b_look_ahead_cheat", "date asset", "whole", panel_sql(f"SELECT n.date, n.asset, n.whole FROM (SELECT date, asset, lead(adj_close) OVER ({BY}) AS whole FROM panel) n JOIN (SELECT DISTINCT date FROM panel ORDER BY md5('0:' || date::VARCHAR) LIMIT 15) c ON n.date = c.date WHERE whole IS NOT NULL"))
def b_look_ahead_cheat(spark, d):
    """A builder that reads the next close is found out at every cut: there its weight is gone."""
    from pyspark.sql import Window

    cheat = lambda p: p.withColumn("weight", F.lead("adj_close").over(Window.partitionBy("asset").orderBy("date")))
    return B.look_ahead(cheat, order_panel(spark, d), look_ahead_cuts(spark, d)).where("part IS NULL").withColumnRenamed("full", "whole")


# --- metrics --------------------------------------------------------------------------------------------------------

_RET = f"ret AS (SELECT asset, date, 2e-1 * (adj_close / lag(adj_close) OVER ({BY}) - 1e0) AS r, 1e-4 AS rf FROM panel), ser AS (SELECT * FROM ret WHERE r IS NOT NULL)"


def _returns(spark, d) -> DataFrame:
    """A fifth of each asset's weekly returns, and a constant risk-free rate."""
    from brassloom.operators.windows import pct_change

    return order_panel(spark, d).select("asset", "date", (0.2 * pct_change("adj_close")).alias("r"), F.lit(0.0001).alias("rf")).where("r IS NOT NULL")


_SUMMARY = f"""{_RET}, spl AS (SELECT split, ser.* FROM ser JOIN splits ON date BETWEEN a AND b),
 eq AS (SELECT *, product(1e0 + r) OVER w AS eq, avg(r) OVER (PARTITION BY split, asset) AS m FROM spl WINDOW w AS (PARTITION BY split, asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
 dd AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY split, asset ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1e0 AS dd FROM eq),
 rn AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY split, asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM dd),
 ln AS (SELECT split, asset, max(n) AS max_dd_len FROM (SELECT split, asset, pk, count(*) FILTER (WHERE dd < 0) AS n FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2),
 mo AS (SELECT split, asset, min(x) AS worst_month FROM (SELECT split, asset, date_trunc('month', date), product(1e0 + r) - 1e0 AS x FROM spl GROUP BY 1, 2, 3) GROUP BY 1, 2),
 qt AS (SELECT split, asset, quantile_cont(r, 0.05) AS q FROM spl GROUP BY 1, 2),
 cv AS (SELECT s.split, s.asset, CASE WHEN count(r) >= 20 THEN avg(r) FILTER (WHERE r <= q) END AS cvar FROM spl s JOIN qt USING (split, asset) GROUP BY 1, 2),
 ag AS (SELECT split, asset, min(date) AS start, max(date) AS stop, count(r) AS n_periods, CASE WHEN product(1e0 + r) > 0 THEN pow(product(1e0 + r), 52e0 / count(r)) - 1e0 ELSE -1e0 END AS cagr, stddev_samp(r) * sqrt(52e0) AS ann_vol,
   CASE WHEN stddev_pop(r - rf) > 1e-9 * max(abs(r - rf)) THEN avg(r - rf) / stddev_samp(r - rf) END * sqrt(52e0) AS sharpe, avg(r - rf) / nullif(sqrt(avg(pow(least(r - rf, 0e0), 2e0))), 0) * sqrt(52e0) AS sortino, min(dd) AS max_dd, min(r) AS worst_period, product(1e0 + r) - 1e0 AS total_return,
   CASE WHEN stddev_pop(r) > 1e-9 * max(abs(r)) THEN avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5e0) END AS skew, CASE WHEN stddev_pop(r) > 1e-9 * max(abs(r)) THEN avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2e0) END AS kurt, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS pct_positive, CASE WHEN stddev_pop(r - rf) > 1e-9 * max(abs(r - rf)) THEN avg(r - rf) / stddev_samp(r - rf) END AS sr_period FROM dd GROUP BY 1, 2),
 summ AS (SELECT *, CASE WHEN max_dd < 0 THEN cagr / abs(max_dd) END AS calmar FROM ag JOIN ln USING (split, asset) JOIN mo USING (split, asset) JOIN cv USING (split, asset))"""
SPLIT_TABLE = "splits(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '1998-12-31'), ('VALIDATION', DATE '1999-01-01', DATE '2000-06-30'), ('DEV+VAL', DATE '1900-01-01', DATE '2000-06-30'))"
_VALUES = "cagr ann_vol sharpe sortino max_dd worst_period worst_month cvar total_return skew kurt pct_positive calmar sr_period"


@query("a_summary", "split asset start stop n_periods max_dd_len", _VALUES, panel_sql("SELECT * FROM summ", f"{SPLIT_TABLE}, {_SUMMARY}"))
def a_summary(spark, d):
    return metrics.summarize(SPLITS.explode(_returns(spark, d)), ["split", "asset"], PPY).withColumnRenamed("end", "stop")


@query("a_monthly_returns", "asset month", "ret", panel_sql("SELECT asset, date_trunc('month', date)::DATE AS month, product(1e0 + r) - 1e0 AS ret FROM ser GROUP BY 1, 2", _RET))
def a_monthly_returns(spark, d):
    return metrics.compounded(_returns(spark, d), ["asset"], "month")


@query("a_yearly_returns", "asset year", "ret", panel_sql("SELECT asset, date_trunc('year', date)::DATE AS year, product(1e0 + r) - 1e0 AS ret FROM ser GROUP BY 1, 2", _RET))
def a_yearly_returns(spark, d):
    return metrics.compounded(_returns(spark, d), ["asset"], "year")


_WORST = ", ".join(f"CASE WHEN count(r) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN sum(ln(1e0 + r)) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS w{n}" for n in (1, 5, 21, 63))


@query("a_rolling_worst", "asset", "worst_1 worst_5 worst_21 worst_63", panel_sql("SELECT asset, " + ", ".join(f"exp(min(w{n})) - 1e0 AS worst_{n}" for n in (1, 5, 21, 63)) + " FROM v GROUP BY asset", f"{_RET}, v AS (SELECT asset, {_WORST} FROM ser)"))
def a_rolling_worst(spark, d):
    return metrics.worst_windows(_returns(spark, d), ["asset"])


_STRESS = (("first", "1995-03-01", "1995-06-30"), ("crisis", "1998-07-01", "1998-10-31"), ("late", "2000-03-24", "2001-03-31"), ("outside", "1990-01-01", "1995-06-30"))


@query("a_stress_windows", "asset stress", "ret max_dd", panel_sql("""SELECT asset, stress, product(1e0 + r) - 1e0 AS ret, min(dd) AS max_dd FROM (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY asset, stress ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1e0 AS dd FROM (
  SELECT s.asset, x.nm AS stress, s.date, s.r, product(1e0 + r) OVER (PARTITION BY s.asset, x.nm ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT *, min(date) OVER (PARTITION BY asset) AS lo, max(date) OVER (PARTITION BY asset) AS hi FROM ser) s JOIN st x ON s.date BETWEEN x.a AND x.b AND s.lo <= x.a AND s.hi >= x.b)) GROUP BY 1, 2 HAVING count(*) >= 2""",
    f"{_RET}, st(nm, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _STRESS) + ")"))
def a_stress_windows(spark, d):
    return metrics.in_windows(_returns(spark, d), ["asset"], _STRESS).withColumnRenamed("window", "stress")


_BENCH = "bm AS (SELECT date, avg(r) AS r FROM ser GROUP BY date)"


def _bench(spark, d) -> DataFrame:
    """The mean return of all assets."""
    return _returns(spark, d).groupBy("date").agg(F.avg("r").alias("r")).withColumn("of", F.lit("all"))


@query("a_yearly_against", "asset year", "ret bench ahead", panel_sql("SELECT y.asset, y.year, y.ret, b.ret AS bench, y.ret - b.ret AS ahead FROM (SELECT asset, date_trunc('year', date)::DATE AS year, product(1e0 + r) - 1e0 AS ret FROM ser GROUP BY 1, 2) y LEFT JOIN (SELECT date_trunc('year', date)::DATE AS year, product(1e0 + r) - 1e0 AS ret FROM bm GROUP BY 1) b ON b.year = y.year", f"{_RET}, {_BENCH}"))
def a_yearly_against(spark, d):
    """Each asset's yearly returns beside the benchmark's."""
    return metrics.against(metrics.compounded(_returns(spark, d), ["asset"], "year"), metrics.compounded(_bench(spark, d), ["of"], "year"), ["year"])


_INSIDE = "SELECT {0}, x.nm AS stress, product(1e0 + r) - 1e0 AS ret FROM (SELECT *, min(date) OVER ({1}) AS lo, max(date) OVER ({1}) AS hi FROM {2}) s JOIN st x ON s.date BETWEEN x.a AND x.b AND s.lo <= x.a AND s.hi >= x.b GROUP BY 1, 2 HAVING count(*) >= 2"


@query("a_stress_against", "asset stress", "ret bench ahead", panel_sql(f"SELECT o.asset, o.stress, o.ret, b.ret AS bench, o.ret - b.ret AS ahead FROM ({_INSIDE.format('asset', 'PARTITION BY asset', 'ser')}) o LEFT JOIN ({_INSIDE.format(chr(39) + 'all' + chr(39) + ' AS k', '', 'bm')}) b ON b.stress = o.stress", f"{_RET}, {_BENCH}, st(nm, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _STRESS) + ")"))
def a_stress_against(spark, d):
    """Each asset's return in stress windows beside the benchmark's."""
    own = metrics.in_windows(_returns(spark, d), ["asset"], _STRESS)
    return metrics.against(own, metrics.in_windows(_bench(spark, d), ["of"], _STRESS), ["window"]).withColumnRenamed("window", "stress")


_PAIRS = f"{_RET}, bench AS (SELECT date, avg(r) AS b FROM ser GROUP BY date), pr AS (SELECT s.asset, s.date, s.r AS s, b.b, 1e-4 AS rf FROM ser s JOIN bench b USING (date))"


def _pairs(spark, d) -> DataFrame:
    r = _returns(spark, d)
    return r.join(r.groupBy("date").agg(F.avg("r").alias("b")), "date").withColumnRenamed("r", "s")


@query("a_compare", "asset n beats_on_sharpe beats_on_cagr", "sharpe_s sharpe_b sharpe_diff cagr_s cagr_b beta alpha corr", panel_sql("""SELECT *, ss AS sharpe_s, sb AS sharpe_b, ss - sb AS sharpe_diff, ss > sb AS beats_on_sharpe, cagr_s > cagr_b AS beats_on_cagr, (ms - beta * mb) * 52 AS alpha FROM (SELECT asset, count(*) AS n, avg(s - rf) / nullif(stddev_samp(s - rf), 0) * sqrt(52e0) AS ss, avg(b - rf) / nullif(stddev_samp(b - rf), 0) * sqrt(52e0) AS sb,
  pow(product(1e0 + s), 52e0 / count(s)) - 1e0 AS cagr_s, pow(product(1e0 + b), 52e0 / count(b)) - 1e0 AS cagr_b, covar_samp(s - rf, b - rf) / var_samp(b - rf) AS beta, avg(s - rf) AS ms, avg(b - rf) AS mb, corr(s, b) AS corr FROM pr GROUP BY asset)""", _PAIRS))
def a_compare(spark, d):
    return metrics.compare(_pairs(spark, d), ["asset"], PPY)


@query("a_sharpe_difference", "asset n", "z p", panel_sql(f"SELECT *, 1e0 - {cdf_sql('z')} AS p FROM (SELECT asset, n, (sa - sb) / sqrt((2 - 2 * rho + 5e-1 * (sa * sa + sb * sb - 2 * sa * sb * rho * rho)) / n) AS z FROM (SELECT asset, count(*) AS n, avg(s) / nullif(stddev_samp(s), 0) AS sa, avg(b) / nullif(stddev_samp(b), 0) AS sb, corr(s, b) AS rho FROM pr GROUP BY asset))", _PAIRS))
def a_sharpe_difference(spark, d):
    return stats.sharpe_difference(_pairs(spark, d), ["asset"], "s", "b")


# --- many trials: segments and priorities ---------------------------------------------------------------------------

_TRIALS = f"""o AS (SELECT c_mktsegment AS family, o_orderpriority AS variant, date_trunc('month', o_orderdate)::DATE AS date, avg(o_totalprice) AS px FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 r AS (SELECT family, variant, date, 5e-2 * (px / lag(px) OVER (PARTITION BY family, variant ORDER BY date) - 1e0) - 2e-3 AS r FROM o),
 rm AS (SELECT *, avg(r) OVER (PARTITION BY family, variant) AS m FROM r WHERE r IS NOT NULL),
 tr AS (SELECT family, variant, count(r) AS n_periods, avg(r) / nullif(stddev_samp(r), 0) AS sr_period, avg(pow(r - m, 3)) / nullif(pow(avg(pow(r - m, 2)), 1.5e0), 0) AS skew, avg(pow(r - m, 4)) / nullif(pow(avg(pow(r - m, 2)), 2e0), 0) AS kurt FROM rm GROUP BY 1, 2)"""


def _trials(spark, d) -> DataFrame:
    """One row per segment and priority: its monthly price changes as a strategy's returns."""
    from pyspark.sql import Window

    from brassloom.operators.windows import pct_change

    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    px = o.groupBy(F.col("c_mktsegment").alias("family"), F.col("o_orderpriority").alias("variant"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("px"))
    w = Window.partitionBy("family", "variant").orderBy("date")
    r = px.withColumn("r", 0.05 * pct_change("px", 1, w) - 0.002).where("r IS NOT NULL")
    return r.groupBy("family", "variant").agg(F.count("r").alias("n_periods"), metrics.sharpe_per_period(F.col("r")).alias("sr_period"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


@query("a_hurdle", "n", "plain robust iid used", f"WITH {_TRIALS}, md AS (SELECT median(sr_period) AS m FROM tr) SELECT n, plain, robust, iid, greatest(robust, iid) AS used FROM (SELECT count(*) AS n, var_samp(sr_period) AS plain, pow(1.4826e0 * (SELECT median(abs(sr_period - m)) FROM tr, md), 2e0) AS robust, 1e0 / greatest(100, 2) AS iid FROM tr)")
def a_hurdle(spark, d):
    return stats.hurdle_variance(_trials(spark, d).withColumn("all", F.lit(1)), ["all"], "sr_period", F.lit(100))


_E = "2.71828182845904509e+00"
_DSR = f"""{_TRIALS}, nv AS (SELECT count(*)::DOUBLE AS n_trials, var_samp(sr_period) AS variance FROM tr), h AS (SELECT *, sqrt(variance) * (4.22784335098467134e-01 * {quantile_sql('(1e0 - 1e0 / n_trials)')} + 5.77215664901532866e-01 * {quantile_sql(f'(1e0 - 1e0 / (n_trials * {_E}))')}) AS sr0 FROM nv),
 zz AS (SELECT family, variant, n_periods, sr_period, skew, kurt, sr0, sr_period * sqrt(n_periods - 1) / sqrt(1e0 - skew * sr_period + (kurt - 1e0) / 4e0 * sr_period * sr_period) AS z0, (sr_period - sr0) * sqrt(n_periods - 1) / sqrt(1e0 - skew * sr_period + (kurt - 1e0) / 4e0 * sr_period * sr_period) AS z1 FROM tr, h),
 ds AS (SELECT *, {cdf_sql('z0')} AS psr_zero, {cdf_sql('z1')} AS dsr FROM zz)"""


def _deflated(spark, d) -> DataFrame:
    t = _trials(spark, d)
    n = t.agg(F.count("*").cast("double").alias("n_trials"), F.var_samp("sr_period").alias("variance"))
    return stats.deflated(t.crossJoin(F.broadcast(n)))  # one row


@query("a_dsr", "family variant n_periods", "sr_period skew kurt sr0 psr_zero dsr", f"WITH {_DSR} SELECT * FROM ds")
def a_dsr(spark, d):
    return _deflated(spark, d)


@query("a_leaderboard", "family variant", "sr_period dsr", f"WITH {_DSR} SELECT * FROM ds ORDER BY dsr DESC, family, variant LIMIT 8")
def a_leaderboard(spark, d):
    return _deflated(spark, d).orderBy(F.col("dsr").desc(), "family", "variant").limit(8)


@query("a_family_table", "family n best_variant", "best_sr median_sr best_dsr", f"WITH {_DSR} SELECT family, count(*) AS n, max(sr_period) AS best_sr, median(sr_period) AS median_sr, arg_max(variant, dsr) AS best_variant, max(dsr) AS best_dsr FROM ds GROUP BY family")
def a_family_table(spark, d):
    return _deflated(spark, d).groupBy("family").agg(F.count("*").alias("n"), F.max("sr_period").alias("best_sr"), F.percentile("sr_period", 0.5).alias("median_sr"), F.max_by("variant", "dsr").alias("best_variant"), F.max("dsr").alias("best_dsr"))


@query("m_normal_cdf", "o_orderkey", "p", f"SELECT o_orderkey, {cdf_sql('z')} AS p FROM (SELECT o_orderkey, (o_totalprice - 2e5) / 4e4 AS z FROM orders)")
def m_normal_cdf(spark, d):
    from brassloom.functions.normal import cdf

    return table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 200_000.0) / 40_000.0).alias("z")).withColumn("p", cdf("z"))


@query("m_normal_quantile", "l_orderkey l_linenumber", "z", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {quantile_sql('p')} AS z FROM (SELECT l_orderkey, l_linenumber, l_quantity / 51e0 AS p FROM lineitem)")
def m_normal_quantile(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 51.0).alias("p")).withColumn("z", F.expr(quantile_sql("p")))


# --- taxes ----------------------------------------------------------------------------------------------------------

_TAX = f"""{_RET}, yr AS (SELECT asset, year(date) AS year, product(1e0 + r) AS growth FROM ser GROUP BY 1, 2), ra(rate) AS (VALUES (0e0), (1.2e-1), (2.2e-1), (3.2e-1)), y AS (SELECT asset, rate, year, growth, row_number() OVER (PARTITION BY asset, rate ORDER BY year) AS n FROM yr CROSS JOIN ra),
 f AS (SELECT asset, rate, year, n, 1e0 AS before, CASE WHEN growth - 1e0 > 0 THEN rate * (growth - 1e0) ELSE 0e0 END AS tax, least(growth - 1e0, 0e0) AS carry, growth - CASE WHEN growth - 1e0 > 0 THEN rate * (growth - 1e0) ELSE 0e0 END AS equity FROM y WHERE n = 1
  UNION ALL SELECT asset, rate, year, n, before, CASE WHEN gain > 0 THEN rate * gain ELSE 0e0 END, least(gain, 0e0), eq - CASE WHEN gain > 0 THEN rate * gain ELSE 0e0 END FROM (SELECT y.asset, y.rate, y.year, y.n, f.equity AS before, f.equity * y.growth AS eq, f.equity * y.growth - f.equity + f.carry AS gain FROM f JOIN y ON y.asset = f.asset AND y.rate = f.rate AND y.n = f.n + 1))"""


def _taxed(spark, d) -> DataFrame:
    yearly = _returns(spark, d).groupBy("asset", F.year("date").alias("year")).agg(F.product(1 + F.col("r")).alias("growth"))
    rates = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.12, 0.22, 0.32)]))
    out = folds.after_tax(yearly.withColumn("rate", rates).withColumn("of", F.col("rate")), ["asset", "of"], "rate")
    return out.select("asset", "rate", "year", "growth", "out.*")


@query("f_after_tax", "asset year", "rate tax equity", f"WITH RECURSIVE {PANEL}, {_TAX} SELECT * FROM f")
def f_after_tax(spark, d):
    return _taxed(spark, d)


@query("a_tax_drag", "asset", "rate cagr tax", f"WITH RECURSIVE {PANEL}, {_TAX}, ny AS (SELECT asset, count(*) / 52e0 AS years FROM ser GROUP BY asset) SELECT f.asset, rate, pow(arg_max(equity, n), 1e0 / any_value(years)) - 1e0 AS cagr, sum(tax) AS tax FROM f JOIN ny ON ny.asset = f.asset GROUP BY 1, 2")
def a_tax_drag(spark, d):
    years = _returns(spark, d).groupBy("asset").agg((F.count("*") / 52.0).alias("years"))
    out = _taxed(spark, d).groupBy("asset", "rate").agg(F.max_by("equity", "year").alias("equity"), F.sum("tax").alias("tax")).join(years, "asset")
    return out.withColumn("cagr", F.pow("equity", F.lit(1.0) / F.col("years")) - 1)


# --- Monte Carlo: draws that any engine repeats ---------------------------------------------------------------------

_PATHS = "final_p05 final_p50 final_p95 dd_p50 dd_p05 prob_loss prob_dd_25"


@query("mc_block_bootstrap", "asset n_sims", _PATHS, panel_sql(f"SELECT * FROM ({resample.resampled_sql('ser', 'asset', 'r', 'date', 21, 42)})", _RET))
def mc_block_bootstrap(spark, d):
    return resample.block_bootstrap(_returns(spark, d), ["asset"])


@query("mc_trades", "asset n_sims", _PATHS, panel_sql(f"SELECT * FROM ({resample.resampled_sql('ep', 'asset', 'pnl', 'entry', 1, 5)})", f"{_sim('next_open')}, {_EPISODES}"))
def mc_trades(spark, d):
    """Each asset's trades drawn with replacement; an asset with under five has no paths."""
    ep = B.episodes(B.simulate(_trend_rows(spark, d), "next_open", _COST, rules=WHOLE))
    return resample.resample_trades(ep, ["asset"], "pnl", ["entry"])


# --- the whole pipeline in one plan: a grid of variants, all splits ---------------------------------------------------

GRID = (5, 10, 20, 40)


def _grid(p: DataFrame) -> DataFrame:
    """Every variant's rows over a panel: a rolling frame is a literal, so each length is a column, and they are unpivoted in one scan."""
    from brassloom.operators.windows import rolling_mean

    held = F.array(*[F.struct(F.lit(f"sma{n:02d}").alias("variant"), (signals.flag(F.col("adj_close") > F.col(f"_m{n}")) / ASSETS).alias("weight")) for n in GRID])
    return reduce(lambda df, n: df.withColumn(f"_m{n}", rolling_mean("adj_close", n)), GRID, p).select(*p.columns, F.inline(held)).withColumn("rf", F.lit(0.0008))


def _grid_sql(cost: float = 1.0, out: str = "SELECT split, asset AS variant, n_periods, cagr, sharpe, max_dd, sr_period FROM summ") -> str:
    names = "variant, asset"
    weights = " UNION ALL ".join(f"SELECT 'sma{n:02d}' AS variant, *, {_flag('adj_close > ' + roll('avg', 'adj_close', n))} / 5e0 AS weight FROM panel" for n in GRID)
    sim = _sim("next_close").replace(_WEIGHTS, f"wt AS ({weights})").replace(BY, f"PARTITION BY {names} ORDER BY date").replace("PARTITION BY asset)", f"PARTITION BY {names})").replace("d AS (PARTITION BY date)", "d AS (PARTITION BY variant, date)")
    per = _PERIODS.replace("SELECT date,", "SELECT variant, date,").replace("GROUP BY date", "GROUP BY variant, date")
    if cost != 1.0:
        k = f"{cost:.17e}"
        sim = sim.replace("turnover * 2e0 / 1e4 AS", f"turnover * 2e0 / 1e4 * {k} AS").replace(", 0e0)) AS regulatory", f", 0e0)) * {k} AS regulatory").replace("THEN 1e0 / 5e3", f"THEN 1e0 / 5e3 * {k}").replace("* 5e1 / 1e4 AS borrow", f"* 5e1 / 1e4 * {k} AS borrow").replace("/ 365e0 AS fin", f"/ 365e0 * {k} AS fin")
    tail = _SUMMARY[len(_RET):].lstrip(", \n")
    ser = "ser AS (SELECT variant AS asset, date, net AS r, 8e-4 AS rf FROM net)"
    return panel_sql(out, f"{SPLIT_TABLE}, {sim}, {per}, {ser}, {tail}")


@query("flagship_grid", "split variant n_periods", "cagr sharpe max_dd sr_period", _grid_sql())
def flagship_grid(spark, d):
    """Panel, signals, simulation, net returns and metrics of all variants on all splits, as one plan."""
    return _grid_summary(spark, d, 1.0)


def _grid_net(spark, d, cost: float) -> DataFrame:
    return _net(B.simulate(_grid(order_panel(spark, d)), "next_close", _COST.scaled(cost), rules=WHOLE))


def _net(sim: DataFrame) -> DataFrame:
    return B.periods(sim).select("variant", "date", F.col("net").alias("r"), "rf")


def _grid_summary(spark, d, cost: float) -> DataFrame:
    return metrics.summarize(SPLITS.explode(_grid_net(spark, d, cost)), ["split", "variant"], PPY)


@query("flagship_double_cost", "split variant n_periods", "cagr sharpe max_dd sr_period", _grid_sql(2.0))
def flagship_double_cost(spark, d):
    """The same at twice the costs."""
    return _grid_summary(spark, d, 2.0)


# --- families of strategies: each a builder and a range of parameters, all in one plan ----------------------------------------------


def _up(n: int) -> str:
    return f"adj_close > {roll('avg', 'adj_close', n)}"


def _per_asset(condition: str) -> str:
    return f"SELECT date, asset, {_flag(condition)} / 5e0 AS weight FROM panel"


def _held(ctes: str, scale: str = "1e0") -> str:
    return f"WITH {ctes} SELECT date, asset, {_monthly('')} * {scale} AS weight FROM t"


def _vol_sql(target: float, n: int) -> tuple[str, str]:
    return f"r AS (SELECT *, adj_close / lag(adj_close) OVER ({BY}) - 1 AS ret FROM panel), v AS (SELECT *, {roll('stddev_samp', 'ret', n)} AS vol FROM r)", f"CASE WHEN vol IS NULL THEN 0e0 WHEN vol = 0 THEN 1e0 ELSE least({target:.17e} / (vol * sqrt(52e0)), 1e0) END"


def _families() -> list[tuple[Trial, str]]:
    """Every trial with the SQL of its weights (date, asset, weight over panel); what acts on single assets has a fifth of equity for each."""
    out = []

    def add(family: str, params: dict, lookback: int, build, sql: str) -> None:
        out.append((Trial(family, "_".join([family, *(f"{k}{v:g}" for k, v in params.items())]), build, params, lookback), sql))

    fifth = lambda build: lambda p: signals.scaled(build(p), 1 / ASSETS)
    for n in (10, 20, 30, 40):
        add("trend", {"n": n}, n, fifth(lambda p, n=n: signals.price_above_sma(p, n)), _per_asset(_up(n)))
        add("slots", {"n": n}, n, lambda p, n=n: signals.equal_slot_trend(p, n, ASSETS), _held(f"t AS (SELECT date, asset, {_FIRST}, {_flag(_up(n))} / 5e0 AS weight FROM panel)"))
    for n in (13, 26, 52):
        add("momentum", {"n": n}, n, fifth(lambda p, n=n: signals.momentum_sign(p, n)), _per_asset(f"adj_close / lag(adj_close, {n}) OVER ({BY}) - 1 > 0"))
    for fast, slow in ((5, 20), (10, 40), (8, 32)):
        add("cross", {"fast": fast, "slow": slow}, slow, fifth(lambda p, a=fast, b=slow: signals.sma_cross(p, a, b)), _per_asset(f"{roll('avg', 'adj_close', fast)} > {roll('avg', 'adj_close', slow)}"))
    for look, k, absolute in product((13, 26, 52), (1, 3), (False, True)):
        skip = 4 if look == 52 else 0
        past = f"lag(adj_close, {skip}) OVER ({BY})" if skip else "adj_close"
        ranked = f"m AS (SELECT date, asset, {past} / lag(adj_close, {look}) OVER ({BY}) - 1 AS mom FROM panel), k AS (SELECT date, asset, mom, CASE WHEN mom IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, asset) END AS r FROM m)"
        add("leaders", {"look": look, "skip": skip, "k": k, "abs": int(absolute)}, look, lambda p, a=look, s=skip, k=k, b=absolute: signals.xs_momentum(p, a, s, k, b), _held(f"{ranked}, t AS (SELECT date, asset, {_FIRST}, {_flag(f'r <= {k}' + (' AND mom > 0' if absolute else ''))} / {k}e0 AS weight FROM k)"))
    for days in (2, 3, 4):
        add("turn_of_month", {"days": days}, 0, fifth(lambda p, d=days: signals.turn_of_month(p, d)), _per_asset(f"row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date DESC) = 1 OR row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date) <= {days - 1}"))
    for below, n in ((0.1, None), (0.2, None), (0.3, None), (0.2, 40)):
        add("range_low", {"below": below, "n": n or 0}, n or 0, fifth(lambda p, b=below, n=n: signals.ibs_reversal(p, b, n)), _per_asset(f"(close - low) / nullif(high - low, 0) < {below:.17e}" + (f" AND {_up(n)}" if n else "")))
    for target, n in product((0.08, 0.12, 0.15), (12, 26)):
        ctes, w = _vol_sql(target, n)
        add("vol_target", {"target": target, "n": n}, n + 1, fifth(lambda p, t=target, n=n: signals.vol_target(p, t, n, PPY)), _held(f"{ctes}, t AS (SELECT date, asset, {_FIRST}, {w} AS weight FROM v)", "2e-1"))
    for target in (0.10, 0.15):
        ctes, w = _vol_sql(target, 12)
        add("trend_vol", {"n": 40, "target": target}, 40, fifth(lambda p, t=target: signals.trend_and_vol(p, 40, t, 12, PPY)), f"WITH {ctes}, t AS (SELECT date, asset, {_FIRST}, {w} AS weight, {_flag(_up(40))} AS up FROM v) SELECT date, asset, {_monthly('')} * up / 5e0 AS weight FROM t")
    for n in (20, 30, 40):
        ctes, _ = _vol_sql(0.1, 12)
        add("inverse_vol", {"n": n}, n, lambda p, n=n: signals.inverse_vol_slots(p, n, 12), _held(f"{ctes}, i AS (SELECT *, CASE WHEN vol > 0 THEN 1e0 / vol END AS iv FROM v), t AS (SELECT date, asset, {_FIRST}, coalesce({_flag(_up(n))} * iv / sum(iv) OVER (PARTITION BY date), 0e0) AS weight FROM i)"))
    return out


FAMILIES = _families()
_UNIVERSE = "priorities"


def _family_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{t.variant}' AS variant, date, asset, weight FROM ({sql})" for t, sql in FAMILIES)
    names = "variant, asset"
    sim = _sim("next_close").replace(_WEIGHTS, f"wt AS (SELECT w.variant, p.*, w.weight FROM panel p JOIN ({each}) w ON w.date = p.date AND w.asset = p.asset)")
    head, tail = sim.split(", s0 AS", 1)
    sim = head + ", s0 AS" + tail.replace(BY, f"PARTITION BY {names} ORDER BY date").replace("PARTITION BY asset)", f"PARTITION BY {names})").replace("d AS (PARTITION BY date)", "d AS (PARTITION BY variant, date)")
    per = _PERIODS.replace("SELECT date,", "SELECT variant, date,").replace("GROUP BY date", "GROUP BY variant, date")
    summ = _SUMMARY[len(_RET):].lstrip(", \n")
    start = f"(SELECT date FROM (SELECT DISTINCT date FROM panel) ORDER BY date LIMIT 1 OFFSET {max(t.lookback for t, _ in FAMILIES)})"
    trades = f"tc AS (SELECT variant, split, count(*) AS n_trades FROM (SELECT variant, date FROM (SELECT *, coalesce(lag(sg) OVER (PARTITION BY {names} ORDER BY date), 0) AS psg FROM (SELECT *, CASE WHEN abs(pos) < 1e-9 THEN 0 ELSE sign(pos)::INT END AS sg FROM sim)) WHERE sg <> 0 AND sg <> psg AND date >= {start}) JOIN splits ON date BETWEEN a AND b GROUP BY 1, 2)"
    bench = f"bn AS (SELECT split, avg(r - 8e-4) / nullif(stddev_samp(r - 8e-4), 0) * sqrt(52e0) AS bench_sharpe FROM (SELECT date, avg(r) AS r FROM (SELECT date, adj_close / lag(adj_close) OVER ({BY}) - 1e0 AS r FROM panel) GROUP BY 1) JOIN splits ON date BETWEEN a AND b WHERE r IS NOT NULL AND date >= {start} GROUP BY 1)"
    ids = ", ".join(f"('{t.variant}', '{t.family}', '{t.id(_UNIVERSE)}')" for t, _ in FAMILIES)
    ser = f"ser AS (SELECT variant AS asset, date, net AS r, 8e-4 AS rf FROM net WHERE date >= {start})"
    return panel_sql("SELECT k.family, k.variant, k.trial_id, s.split, s.n_periods, coalesce(tc.n_trades, 0) AS n_trades, s.cagr, s.sharpe AS sharpe_ann, s.sr_period, s.skew, s.kurt, s.max_dd, bn.bench_sharpe FROM summ s JOIN known k ON k.variant = s.asset JOIN bn ON bn.split = s.split LEFT JOIN tc ON tc.variant = s.asset AND tc.split = s.split", f"{SPLIT_TABLE}, {sim}, {per}, {ser}, {summ}, {trades}, {bench}, known(variant, family, trial_id) AS (VALUES {ids})")


@query("family_grid", "family variant trial_id split n_periods n_trades", "cagr sharpe_ann sr_period skew kurt max_dd bench_sharpe", _family_sql())
def family_grid(spark, d):
    """All trials of all families as rows for the ledger, scored on every split from the longest look-back on."""
    from brassloom.operators.windows import pct_change

    trials, p = [t for t, _ in FAMILIES], order_panel(spark, d)
    market = p.withColumn("r", pct_change("adj_close")).groupBy("date").agg(F.avg("r").alias("r")).withColumn("rf", F.lit(0.0008))
    scores = score(p, trials, SPLITS, PPY, _COST, "next_close", WHOLE, 0.0008, market)
    return trial_rows(scores, trials, _UNIVERSE, "orders", "2024-01-01T00:00:00Z")


# --- a panel that grows: suppliers are assets, days are bars ------------------------------------------------------------------

_SUPPLIERS = """
bars AS (SELECT l_shipdate::DATE AS date, l_suppkey::VARCHAR AS asset, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, count(*)::DOUBLE AS volume
    FROM (SELECT *, 1e2 + l_extendedprice / l_quantity / 5e1 AS px, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2),
panel AS (SELECT d.date, a.asset, b.open, b.high, b.low, b.close, b.close AS adj_close, b.volume
  FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT asset FROM bars) a LEFT JOIN bars b ON b.date = d.date AND b.asset = a.asset)
"""
_FILLED = f"fp AS (SELECT date, asset, last_value(close IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS close FROM panel), fq AS (SELECT *, close AS adj_close, close AS open FROM fp), wt AS (SELECT *, {_flag('adj_close > 1.000001e0 * ' + roll('avg', 'adj_close', 20))} / greatest(count(adj_close) OVER (PARTITION BY date), 1) AS weight FROM fq)"


def _supplier_sql() -> str:
    tail = _SUMMARY[len(_RET):].lstrip(", \n")
    return f"WITH {_SUPPLIERS}, {SPLIT_TABLE}, {_sim('next_close').replace(_WEIGHTS, _FILLED)}, {_PERIODS}, ser AS (SELECT 'suppliers' AS asset, date, net AS r, 8e-4 AS rf FROM net), {tail} SELECT * FROM summ"


@query("flagship_suppliers", "split n_periods", "cagr sharpe max_dd", _supplier_sql())
def flagship_suppliers(spark, d):
    """Trend in equal slots over every supplier's days, whose number grows with the table: panel, signal, simulation, summary."""
    return metrics.summarize(SPLITS.explode(_supplier_net(spark, d)), ["split", "variant"], PPY)


def _supplier_net(spark, d) -> DataFrame:
    from brassloom.operators.windows import rolling_mean

    p = supplier_panel(spark, d, ("close",), carried=("close",)).withColumn("adj_close", F.col("close")).withColumn("open", F.col("close"))
    held = p.groupBy("date").agg(F.greatest(F.count("adj_close"), F.lit(1)).alias("held"))  # a row for each date
    # Prices that stand still are not above their mean, however it was rounded.
    up = signals.flag(F.col("adj_close") > 1.000001 * rolling_mean("adj_close", 20))
    rows = p.join(F.broadcast(held), "date").withColumn("weight", up / F.col("held")).withColumn("variant", F.lit("suppliers")).withColumn("rf", F.lit(0.0008))
    return B.periods(B.simulate(rows, "next_close", _COST, rules=WHOLE, wide=True)).select("variant", "date", F.col("net").alias("r"), "rf")


_NEAR = ", ".join(f"('sma{a:02d}', 'sma{b:02d}')" for i, a in enumerate(GRID) for b in (*GRID[max(i - 1, 0) : i], *GRID[i + 1 : i + 2]))
_WHOLE = "SELECT split, asset AS variant, n_periods, cagr, sharpe, max_dd, sr_period, skew, kurt FROM summ"
_VSTRESS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _STRESS)


def _deflated_sql(of: str) -> str:
    sr0 = f"sqrt(variance) * (4.22784335098467134e-01 * {quantile_sql('(1e0 - 1e0 / n_trials)')} + 5.77215664901532866e-01 * {quantile_sql(f'(1e0 - 1e0 / (n_trials * {_E}))')})"
    inner = f"SELECT variant, sr_period, n_periods, skew, kurt, {sr0} AS sr0 FROM (SELECT s.*, t.n_trials, greatest(coalesce(t.robust, 0e0), 1e0 / greatest(n_periods, 2)) AS variance FROM {of} s, tri t WHERE split = 'DEV+VAL')"
    return f"SELECT variant, coalesce({cdf_sql('z')} >= 9.5e-1, false) AS ok FROM (SELECT variant, (sr_period - sr0) * sqrt(n_periods - 1) / sqrt(1e0 - skew * sr_period + (kurt - 1e0) / 4e0 * sr_period * sr_period) AS z FROM ({inner}))"


_VERDICT = f"""WITH p AS ({_grid_sql(1.0, _WHOLE)}), h AS ({_grid_sql(2.0, _WHOLE)}), nb(variant, neighbour) AS (VALUES {_NEAR}),
 n AS ({_grid_sql(1.0, f"SELECT variant, date, net AS r FROM net WHERE date <= DATE '{SPLITS.val_end}'")}),
 tc AS ({_grid_sql(1.0, f"SELECT variant, count(*) FILTER (WHERE sg <> 0 AND sg <> psg AND date > DATE '{SPLITS.dev_end}' AND date <= DATE '{SPLITS.val_end}') AS n FROM (SELECT *, coalesce(lag(sg) OVER (PARTITION BY variant, asset ORDER BY date), 0) AS psg FROM (SELECT *, CASE WHEN abs(pos) < 1e-9 THEN 0 ELSE sign(pos)::INT END AS sg FROM sim)) GROUP BY 1")}),
 bn AS ({panel_sql(f"SELECT avg(b - 8e-4) / nullif(stddev_samp(b - 8e-4), 0) * sqrt(52e0) AS sharpe FROM (SELECT date, avg(r) AS b FROM (SELECT date, adj_close / lag(adj_close) OVER ({BY}) - 1e0 AS r FROM panel) GROUP BY 1) WHERE b IS NOT NULL AND date <= DATE '{SPLITS.val_end}'")}),
 st(nm, a, b) AS (VALUES {_VSTRESS}),
 sw AS (SELECT variant, min(x) AS x FROM (SELECT variant, nm, product(1e0 + r) - 1e0 AS x, count(*) AS k FROM (SELECT *, min(date) OVER (PARTITION BY variant) AS lo, max(date) OVER (PARTITION BY variant) AS hi FROM n) s JOIN st ON date BETWEEN a AND b AND lo <= a AND hi >= b GROUP BY 1, 2) WHERE k >= 2 GROUP BY 1),
 rw AS (SELECT variant, exp(min(l)) - 1e0 AS x FROM (SELECT variant, CASE WHEN count(r) OVER w = 21 THEN sum(ln(1e0 + r)) OVER w END AS l FROM n WINDOW w AS (PARTITION BY variant ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) GROUP BY 1),
 ev AS (SELECT rw.variant, least(coalesce(sw.x, 0e0), coalesce(rw.x, 0e0)) >= -2.5e-1 AS ok FROM rw LEFT JOIN sw USING (variant)),
 sr AS (SELECT sr_period FROM p WHERE split = 'DEV+VAL' AND sr_period IS NOT NULL), tri AS (SELECT (SELECT count(*) FROM sr)::DOUBLE AS n_trials, CASE WHEN (SELECT count(*) FROM sr) > 2 THEN pow(1.4826e0 * (SELECT median(abs(sr_period - (SELECT median(sr_period) FROM sr))) FROM sr), 2e0) END AS robust),
 d1 AS ({_deflated_sql('p')}), d2 AS ({_deflated_sql('h')}),
 own AS (SELECT variant, coalesce(max(cagr) FILTER (WHERE split = 'DEVELOPMENT' AND n_periods > 10) > 0, false) AND coalesce(max(cagr) FILTER (WHERE split = 'VALIDATION' AND n_periods > 10) > 0, false) AS earns, coalesce(max(max_dd) FILTER (WHERE split = 'DEV+VAL') >= -2.5e-1, false) AS drawdown_ok, coalesce(max(sharpe) FILTER (WHERE split = 'DEV+VAL' AND n_periods > 10) > (SELECT sharpe FROM bn), false) AS beats_benchmark FROM p GROUP BY 1),
 hard AS (SELECT variant, coalesce(max(cagr) FILTER (WHERE split = 'DEVELOPMENT' AND n_periods > 10) > 0, false) AND coalesce(max(cagr) FILTER (WHERE split = 'VALIDATION' AND n_periods > 10) > 0, false) AS e FROM h GROUP BY 1),
 near AS (SELECT nb.variant, bool_and(own.earns) AS neighbours_earn FROM nb JOIN own ON own.variant = nb.neighbour GROUP BY 1),
 al AS (SELECT own.*, d1.ok AS deflated_ok, tc.n >= 100 AS enough_trades, ev.ok AS worst_event_ok, coalesce(neighbours_earn, true) AS neighbours_earn, hard.e AND d2.ok AS holds_at_double_cost FROM own JOIN d1 USING (variant) JOIN tc USING (variant) JOIN ev USING (variant) JOIN hard USING (variant) JOIN d2 USING (variant) LEFT JOIN near USING (variant))
 SELECT *, earns AND beats_benchmark AND deflated_ok AND enough_trades AND drawdown_ok AND worst_event_ok AND neighbours_earn AND holds_at_double_cost AS passes FROM al"""

_CHECKS = "earns beats_benchmark deflated_ok enough_trades drawdown_ok worst_event_ok neighbours_earn holds_at_double_cost"


def _evaluated(spark, d, **more) -> DataFrame:
    """The grid's variants judged: their own ratios are the trials, the mean of all assets is the benchmark."""
    from brassloom.operators.windows import pct_change

    pairs = [(f"sma{a:02d}", f"sma{b:02d}") for i, a in enumerate(GRID) for b in (*GRID[max(i - 1, 0) : i], *GRID[i + 1 : i + 2])]
    # The panel is built once, and each variant simulated once at plain and once at doubled costs.
    panel = stored(order_panel(spark, d))
    rows = stored(_grid(panel))
    sim = stored(B.simulate(rows, "next_close", _COST, rules=WHOLE))
    every, doubled = stored(_net(sim)), _net(B.simulate(rows, "next_close", _COST.scaled(2.0), rules=WHOLE))
    summary = lambda r: metrics.summarize(SPLITS.explode(r), ["split", "variant"], PPY)
    plain = stored(summary(every))
    ratios = plain.where("split = 'DEV+VAL'").withColumn("all", F.lit(1))
    trials = stats.hurdle_variance(ratios, ["all"], "sr_period", F.lit(2)).select(F.col("n").cast("double").alias("n_trials"), "robust")
    market = panel.withColumn("r", pct_change("adj_close")).groupBy("date").agg(F.avg("r").alias("r")).withColumn("rf", F.lit(0.0008))
    bench = metrics.summarize(SPLITS.explode(market), ["split"], PPY)
    net = every.where(F.col("date") <= F.lit(SPLITS.val_end).cast("date"))
    late = (F.col("entry") > F.lit(SPLITS.dev_end).cast("date")) & (F.col("entry") <= F.lit(SPLITS.val_end).cast("date"))
    trades = B.episodes(sim).groupBy("variant").agg(F.count(F.when(late, 1)).alias("n"))
    runs = metrics.worst_windows(net, ["variant"], (21,))
    stress = metrics.in_windows(net, ["variant"], _STRESS).groupBy("variant").agg(F.min("ret").alias("_s"))
    events = runs.join(stress, "variant", "left").select("variant", F.least(F.coalesce("_s", F.lit(0.0)), F.coalesce("worst_21", F.lit(0.0))).alias("worst"))
    if "paths" in more:
        more["paths"] = resample.block_bootstrap(net, ["variant"], block=3).select("variant", "final_p05")
    return evaluate(plain, bench, trials, trades, events, stored(summary(doubled)), spark.createDataFrame(pairs, "variant string, neighbour string"), **more)


@query("verdicts", f"variant {_CHECKS} passes", "", _VERDICT)
def verdict_table(spark, d):
    """Whether each variant of the grid passes all checks but the resampled one; its neighbours are the next shorter and longer averages."""
    return _evaluated(spark, d)


_BLOCKS = resample.resampled_sql("n", "variant", "r", "date", 3, 6)


@query("verdicts_resampled", f"variant {_CHECKS} resampled_ok passes", "", f"SELECT v.* EXCLUDE (passes), coalesce(b.final_p05 > 1, false) AS resampled_ok, v.passes AND coalesce(b.final_p05 > 1, false) AS passes FROM ({_VERDICT}) v LEFT JOIN ({_VERDICT.split(' tc AS (')[0].rstrip().rstrip(',')} SELECT * FROM ({_BLOCKS})) b USING (variant)")
def verdicts_resampled(spark, d):
    """The same with the final equity of resampled blocks."""
    return _evaluated(spark, d, paths=True)


@query("report_lines", "asset year line", "", panel_sql("SELECT asset, year, concat_ws(' ', rpad(asset, 16, ' '), rpad(year::VARCHAR, 16, ' '), lpad(printf('%.4f', round(ret * 1e4) / 1e4), 12, ' ')) AS line FROM (SELECT asset, year(date) AS year, product(1e0 + r) - 1e0 AS ret FROM ser GROUP BY 1, 2)", _RET))
def report_table(spark, d):
    """A fixed-width text line for each asset and year."""
    yearly = metrics.compounded(_returns(spark, d), ["asset"], "year").select("asset", F.year("year").cast("long").alias("year"), (F.round(F.col("ret") * 1e4) / 1e4).alias("ret"))
    return report_lines(yearly, ["asset", "year"], ["ret"])


_TABLE = ({"CAGR": "cagr", "MaxDD": "max_dd"}, {"Sharpe": "sharpe", "Calmar": "calmar"})


@query("summary_lines", "split asset line", "", panel_sql("SELECT split, asset, concat(rpad(concat(split, ' ', asset), 30, ' '), " + ", ".join([f"lpad(coalesce(printf('%.1f%%', round({c} * 1e2, 1) + 0e0), '-'), 10, ' ')" for c in ("cagr", "max_dd")] + [f"lpad(coalesce(printf('%.2f', round({c}, 2) + 0e0), '-'), 10, ' ')" for c in ("sharpe", "calmar")]) + ") AS line FROM summ", f"{SPLIT_TABLE}, {_SUMMARY}"))
def metric_lines(spark, d):
    """A line of several metrics for each split and asset."""
    rows = metrics.summarize(SPLITS.explode(_returns(spark, d)), ["split", "asset"], PPY)
    return summary_lines(rows, F.concat_ws(" ", "split", "asset"), *_TABLE)


@query("verdicts_markdown", "variant text", "", f"SELECT variant, concat_ws(chr(10), '### ' || variant, '', '| check | result |', '|---|---|', {', '.join(f'{chr(39)}| {c} | {chr(39)} || CASE WHEN {c} THEN {chr(39)}PASS{chr(39)} ELSE {chr(39)}FAIL{chr(39)} END || {chr(39)} |{chr(39)}' for c in _CHECKS.split())}, '', '**Overall: ' || CASE WHEN passes THEN 'passed all' ELSE 'did not pass' END || '**') AS text FROM ({_VERDICT})")
def verdict_texts(spark, d):
    """The verdicts as sections of Markdown."""
    return markdown(_evaluated(spark, d), _CHECKS.split())
