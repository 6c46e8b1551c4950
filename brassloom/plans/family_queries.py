"""All families of strategies in one plan: universes, calendars, costs, first dates and rules differ from desk to desk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.operators import backtest as B
from brassloom.operators import signals
from brassloom.operators.desks import Desk, score_desks
from brassloom.operators.runner import Trial
from brassloom.plans.panel import densify
from brassloom.plans.registry import BY, query, roll
from brassloom.plans.strategy_queries import _FIRST, _REV, SPLITS, _flag, _held, _monthly, _pair_sql, _up, _vol_sql
from brassloom.sources.tables import PRICE_BASE, PRICE_SCALE, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DAYS = ("DAY HIGH", "DAY LOW")
#: Costs of the desks: funds, a market with dear trades, and pairs that borrow.
PLAIN, DEAR, PAIRED = B.Costs(commission_usd=1.0), B.Costs(fee_bps=12.0, half_spread_bps=3.0, slippage_bps=2.0, cash_haircut=0.0), B.Costs(half_spread_bps=2.0, borrow_bps=100.0)
WEEKLY_RF, DAILY_RF = 0.0008, 0.0001

_BAR = "arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, count(*)::DOUBLE AS volume"
_GRID = "SELECT d.date, a.asset, b.open, b.high, b.low, b.close, b.close AS adj_close, b.volume FROM (SELECT DISTINCT date FROM {0}) d CROSS JOIN (SELECT DISTINCT asset FROM {0}) a LEFT JOIN {0} b ON b.date = d.date AND b.asset = a.asset"
_PANELS = f"""ox AS (SELECT o_orderkey AS k, o_orderdate, o_orderpriority, c_mktsegment, 1e2 + o_totalprice / 5e4 AS px FROM orders JOIN customer ON o_custkey = c_custkey),
 bw AS (SELECT date_trunc('week', o_orderdate)::DATE AS date, asset, {_BAR} FROM (SELECT *, unnest([o_orderpriority, c_mktsegment]) AS asset FROM ox) GROUP BY 1, 2),
 bd AS (SELECT o_orderdate::DATE AS date, CASE WHEN o_orderpriority < '3' THEN 'DAY HIGH' ELSE 'DAY LOW' END AS asset, {_BAR} FROM ox GROUP BY 1, 2),
 panel_week AS ({_GRID.format('bw')}), panel_day AS ({_GRID.format('bd')})"""


def _panels(spark, d) -> dict[str, DataFrame]:
    """Weekly bars of priorities and of segments, and daily bars of urgent and other orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", (F.lit(PRICE_BASE) + F.col("o_totalprice") / F.lit(PRICE_SCALE)).alias("px"))
    o = o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    bars = lambda df: df.groupBy("date", "asset").agg(F.min_by("px", "o_orderkey").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))
    week = o.select("px", "o_orderkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), F.explode(F.array("o_orderpriority", "c_mktsegment")).alias("asset"))
    day = o.select("px", "o_orderkey", F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderpriority") < "3", DAYS[0]).otherwise(DAYS[1]).alias("asset"))
    return {"week": densify(bars(week)), "day": densify(bars(day))}


#: Each variant's weights (date, asset, weight) in SQL, over its desk's panel.
_sql: dict[str, str] = {}


def _t(family: str, variant: str, build, sql: str, **params) -> Trial:
    _sql[variant] = sql
    return Trial(family, variant, build, params)


def _of_rows(weight: str) -> str:
    return f"SELECT date, asset, {weight} AS weight FROM panel"


def _trend(asset: str, n: int, family: str = "trend_sma") -> Trial:
    return _t(family, f"{asset}_sma{n}", lambda p: signals.price_above_sma(p, n), _of_rows(_flag(_up(n))), n=n)


def _momentum(asset: str, n: int, family: str = "trend_mom") -> Trial:
    return _t(family, f"{asset}_mom{n}", lambda p: signals.momentum_sign(p, n), _of_rows(_flag(f"adj_close / lag(adj_close, {n}) OVER ({BY}) - 1 > 0")), n=n)


def _cross(asset: str, fast: int, slow: int) -> Trial:
    return _t("trend_cross", f"{asset}_sma{fast}x{slow}", lambda p: signals.sma_cross(p, fast, slow), _of_rows(_flag(f"{roll('avg', 'adj_close', fast)} > {roll('avg', 'adj_close', slow)}")), fast=fast, slow=slow)


def _slots(name: str, n: int, slots: int) -> Trial:
    return _t("slots_trend", f"{name}_sma{n}", lambda p: signals.equal_slot_trend(p, n, slots), _held(f"t AS (SELECT date, asset, {_FIRST}, {_flag(_up(n))} / {slots}e0 AS weight FROM panel)"), n=n)


def _leaders(name: str, look: int, k: int, absolute: bool) -> Trial:
    ranked = f"m AS (SELECT date, asset, adj_close / lag(adj_close, {look}) OVER ({BY}) - 1 AS mom FROM panel), k AS (SELECT date, asset, mom, CASE WHEN mom IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, asset) END AS r FROM m)"
    on = _flag(f"r <= {k}" + (" AND mom > 0" if absolute else ""))
    return _t("leaders", f"{name}_L{look}_k{k}_abs{int(absolute)}", lambda p: signals.xs_momentum(p, look, 0, k, absolute), _held(f"{ranked}, t AS (SELECT date, asset, {_FIRST}, {on} / {k}e0 AS weight FROM k)"), look=look, k=k, abs=absolute)


def _turn_of_month(asset: str, days: int) -> Trial:
    month = "PARTITION BY asset, date_trunc('month', date) ORDER BY date"
    return _t("turn_of_month", f"{asset}_tom{days}", lambda p: signals.turn_of_month(p, days), _of_rows(_flag(f"row_number() OVER ({month} DESC) = 1 OR row_number() OVER ({month}) <= {days - 1}")), days_after=days)


def _weekdays(asset: str, name: str, days: tuple[int, ...], family: str = "day_of_week") -> Trial:
    return _t(family, f"{asset}_{name}", lambda p: signals.day_of_week(p, days), _of_rows(_flag(f"isodow(date) - 1 IN ({', '.join(map(str, days))})")), days=days)


def _session(asset: str, session: str) -> Trial:
    return _t(session, f"{asset}_{session}", signals.always_long, _of_rows("1e0"))


def _rsi(asset: str) -> Trial:
    return _t("rsi", f"{asset}_rsi2", lambda p: signals.rsi_reversal(p, 2, 25.0, 5, 20), f"SELECT date, asset, weight FROM (WITH RECURSIVE {_REV} SELECT date, asset, weight FROM h)", entry=25, exit_sma=5, trend_sma=20)


def _range_low(asset: str, below: float, n: int | None = None) -> Trial:
    return _t("range_low", f"{asset}_ibs{below:g}" + (f"_trend{n}" if n else ""), lambda p: signals.ibs_reversal(p, below, n), _of_rows(_flag(f"(close - low) / nullif(high - low, 0) < {below:.17e}" + (f" AND {_up(n)}" if n else ""))), below=below, n=n)


def _vol(asset: str, target: float, n: int) -> Trial:
    ctes, w = _vol_sql(target, n)
    return _t("vol_target", f"{asset}_vt{target:g}_L{n}", lambda p: signals.vol_target(p, target, n, 52), _held(f"{ctes}, t AS (SELECT date, asset, {_FIRST}, {w} AS weight FROM v)"), target=target, n=n)


def _trend_vol(asset: str, n: int, target: float, monthly: bool = True, family: str = "trend_vol") -> Trial:
    ctes, w = _vol_sql(target, 12)
    sql = f"WITH {ctes}, t AS (SELECT date, asset, {_FIRST}, {w} AS weight, {_flag(_up(n))} AS up FROM v) SELECT date, asset, {_monthly('') if monthly else 'weight'} * up AS weight FROM t"
    return _t(family, f"{asset}_sma{n}_vt{target:g}", lambda p: signals.trend_and_vol(p, n, target, 12, 52, monthly), sql, n=n, target=target)


def _terms(name: str, family: str, below: float, cap: float = 1.0, most: float | None = None) -> Trial:
    carried = "SELECT *, last_value(front IGNORE NULLS) OVER w AS ff, last_value(back IGNORE NULLS) OVER w AS bb FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"
    on = _flag(f"ff / bb < {below:.17e}" + (f" AND ff < {most:.17e}" if most else ""))
    return _t(family, f"{name}_th{below:g}_cap{cap:g}", lambda p: signals.term_structure(p, "front", "back", below, cap, most), f"SELECT date, asset, {cap:.17e} * {on} AS weight FROM ({carried})", threshold=below, cap=cap)


def _inverse_vol(name: str, n: int) -> Trial:
    ctes, _ = _vol_sql(0.1, 12)
    share = f"coalesce({_flag(_up(n))} * iv / sum(iv) OVER (PARTITION BY date), 0e0)"
    return _t("inverse_vol", f"{name}_iv_sma{n}", lambda p: signals.inverse_vol_slots(p, n, 12), _held(f"{ctes}, i AS (SELECT *, CASE WHEN vol > 0 THEN 1e0 / vol END AS iv FROM v), t AS (SELECT date, asset, {_FIRST}, {share} AS weight FROM i)"), n=n)


def _pair(a: str, b: str) -> Trial:
    sql = f"SELECT date, asset, weight FROM (WITH RECURSIVE {_pair_sql(a, b)} SELECT date, '{a}' AS asset, 5e-1 * shown AS weight FROM f UNION ALL SELECT date, '{b}', -5e-1 * shown FROM f)"
    return _t("pairs", f"{a}/{b}", lambda p: p.join(signals.pairs_zscore(p, a, b, 26, 1.0), ["date", "asset"], "left"), sql, lookback=26, entry=1.0)


def _desks() -> list[Desk]:
    one, two = PRIORITIES[:2]
    week = {"calendar": "week", "ppy": 52, "costs": PLAIN, "rf": WEEKLY_RF}
    day = {"calendar": "day", "ppy": 365, "costs": DEAR, "rf": DAILY_RF}
    front_back = {"front": (PRIORITIES[3], "close"), "back": (PRIORITIES[4], "close")}
    out = [Desk("trend", (one,), (*(_trend(one, n) for n in (10, 20, 40)), *(_momentum(one, n) for n in (13, 26)), _cross(one, 5, 20), _cross(one, 10, 40)), start="1995-10-02", bench=one, **week)]
    out += [Desk(f"related {a}", (a,), tuple(_trend(a, n, "trend_related") for n in (16, 24)), start=f"199{5 + i % 3}-0{6 + i % 4}-01", bench=one, **week) for i, a in enumerate(SEGMENTS)]
    out += [
        Desk("five", PRIORITIES, (*(_slots("five", n, 5) for n in (17, 25)), *(_inverse_vol("five", n) for n in (17, 25))), start="1996-01-01", bench=one, **week),
        Desk("ten", PRIORITIES + SEGMENTS, (_slots("ten", 21, 10), *(_leaders("ten", 26, k, a) for k in (2, 3) for a in (False, True))), start="1996-01-01", bench=one, **week),
        Desk("segments", SEGMENTS, tuple(_leaders("segments", look, k, a) for look in (13, 26) for k in (1, 3) for a in (False, True)), start="1996-06-03", bench=SEGMENTS[0], **week),
        Desk("calendar", DAYS[:1], (*(_turn_of_month(DAYS[0], n) for n in (2, 3, 4)), *(_weekdays(DAYS[0], n, (i,)) for i, n in enumerate(("mon", "tue", "wed", "thu", "fri")))), start="1995-03-01", bench=DAYS[0], **{**day, "costs": PLAIN, "ppy": 252}),
    ]
    out += [Desk(f"{s} {a}", (a,), (_session(a, s),), start="1995-03-01", bench=a, session=s, **day) for a in DAYS for s in ("overnight", "intraday")]
    out += [Desk(f"reversal {a}", (a,), (_rsi(a), _range_low(a, 0.2), _range_low(a, 0.3, 40)), start=start, bench=a, **week) for a, start in ((one, "1996-01-01"), (two, "1996-09-02"))]
    out += [
        Desk("managed", (one,), (*(_vol(one, t, n) for t in (0.08, 0.15) for n in (12, 26)), _trend_vol(one, 40, 0.10)), start="1996-01-01", bench=one, **week),
        Desk("short volatility", (SEGMENTS[1],), tuple(_terms("shortvol", "short_vol", th, cap, 108.0) for cap in (0.15, 0.25) for th in (0.98, 1.0)), start="1995-11-01", bench=SEGMENTS[1], external=front_back, **week),
        Desk("term filter", (one,), tuple(_terms("filter", "term_filter", th) for th in (0.99, 1.01)), start="1995-09-01", bench=one, external=front_back, **week),
    ]
    out += [Desk(f"dear {a}", (a,), (*(_trend(a, n, "dear_trend") for n in (20, 50)), _momentum(a, 90, "dear_trend"), _weekdays(a, "weekend", (4, 5), "dear_weekend"), _trend_vol(a, 50, 0.4, False, "dear_trend_vol")), start=f"1995-0{4 + i}-15", bench=a, **day) for i, a in enumerate(DAYS)]
    out += [Desk(f"pair {a}/{b}", (a, b), (_pair(a, b),), start=start, bench=a, allow_short=True, **{**week, "costs": PAIRED}) for a, b, start in ((one, two, "1995-12-01"), (SEGMENTS[0], SEGMENTS[4], "1996-04-01"))]
    return out


DESKS = _desks()
_VA = "PARTITION BY variant, asset ORDER BY date"


def _desk_sql(d: Desk) -> str:
    """Rows (variant, prices, weight) of a desk."""
    outer = "".join(f", x{i}.{value} AS {name}" for i, (name, (_, value)) in enumerate(d.external.items()))
    joins = "".join(f" LEFT JOIN panel_{d.calendar} x{i} ON x{i}.date = p.date AND x{i}.asset = '{asset}'" for i, (asset, _) in enumerate(d.external.values()))
    own = f"SELECT p.*{outer} FROM panel_{d.calendar} p{joins} WHERE p.asset IN ({', '.join(repr(a) for a in d.assets)})"
    each = " UNION ALL ".join(f"SELECT '{t.variant}' AS variant, date, asset, weight FROM ({_sql[t.variant]})" for t in d.trials)
    return f"SELECT w.variant, p.date, p.asset, p.open, p.close, p.adj_close, w.weight FROM (WITH panel AS ({own}) SELECT * FROM ({each})) w JOIN panel_{d.calendar} p ON p.date = w.date AND p.asset = w.asset"


def _all_sql() -> str:
    known = ", ".join(
        f"('{t.variant}', '{t.family}', '{d.name}', DATE '{d.start}', {d.ppy}e0, {f'{chr(39)}{d.session}{chr(39)}' if d.session else 'NULL'}, {d.rf:.17e}, {d.costs.half_spread_bps + d.costs.slippage_bps + d.costs.fee_bps:.17e}, {d.costs.commission_usd:.17e}, {d.costs.borrow_bps:.17e}, {d.costs.cash_haircut:.17e})"
        for d in DESKS for t in d.trials
    )
    benches = ", ".join(f"('{d.name}', '{d.bench}', '{d.calendar}', DATE '{d.start}', {d.ppy}e0, {d.rf:.17e})" for d in DESKS)
    regulatory = "(2.78e1 / 1e6 + coalesce(1.66e-4 / nullif(close, 0), 0e0))"
    sharpe = lambda x, ppy: f"CASE WHEN count({x}) >= 3 AND stddev_pop({x}) > 1e-9 * max(abs({x})) THEN avg({x}) / stddev_samp({x}) * sqrt({ppy}) END"
    return f"""WITH {_PANELS}, known(variant, family, desk, start, ppy, session, rf, bps, usd, borrow_bps, haircut) AS (VALUES {known}),
 bench(desk, asset, calendar, start, ppy, rf) AS (VALUES {benches}),
 splits(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '{SPLITS.dev_end}'), ('VALIDATION', DATE '{SPLITS.dev_end}' + 1, DATE '{SPLITS.val_end}'), ('DEV+VAL', DATE '1900-01-01', DATE '{SPLITS.val_end}')),
 wt AS (SELECT * FROM ({" UNION ALL ".join(map(_desk_sql, DESKS))}) JOIN known USING (variant)),
 s0 AS (SELECT *, CASE WHEN adj_close IS NULL THEN 0e0 ELSE coalesce(weight, 0e0) END AS w, (date - lag(date) OVER ({_VA}))::DOUBLE AS gap FROM wt),
 s1 AS (SELECT *, greatest(coalesce(gap, median(gap) OVER (PARTITION BY variant, asset), 1e0), 1e0) AS days, coalesce(lag(w) OVER ({_VA}), 0e0) AS pos, coalesce(lag(w, 2) OVER ({_VA}), 0e0) AS prev, coalesce(open / lag(adj_close) OVER ({_VA}) - 1e0, 0e0) AS ov, coalesce(adj_close / open - 1e0, 0e0) AS intr FROM s0 WHERE session IS NULL),
 s2 AS (SELECT *, prev * ov AS part_prev, (prev + pos) / 2e0 AS held FROM s1),
 s3 AS (SELECT *, sum(part_prev) OVER d AS before, sum(greatest(prev, 0e0)) OVER d AS long_prev, sum(greatest(held, 0e0)) OVER d AS long_held FROM s2 WINDOW d AS (PARTITION BY variant, date)),
 s4 AS (SELECT *, pos * intr * (1e0 + before) AS part_new, pos - prev * (1e0 + ov) / greatest(1e0 + before + greatest(1e0 - long_prev, 0e0) * rf, 1e-6) AS trade FROM s3),
 s5 AS (SELECT *, CASE WHEN abs(trade) > 1e-9 THEN abs(trade) ELSE 0e0 END AS turnover FROM s4),
 s6 AS (SELECT *, turnover * bps / 1e4 + CASE WHEN turnover > 0 THEN greatest(-trade, 0e0) * {regulatory} + usd / 5e3 ELSE 0e0 END + greatest(-held, 0e0) * days / 365e0 * borrow_bps / 1e4 AS paid, greatest(long_held - 1e0, 0e0) * 6e-2 * days / 365e0 AS financing, greatest(1e0 - long_held, 0e0) * (rf - haircut * days / 365e0) AS cash FROM s5),
 p1 AS (SELECT variant, date, sum(part_prev + part_new) + any_value(cash) - sum(paid) - any_value(financing) AS net, sum(turnover) AS turnover, sum(abs(pos)) AS exposure FROM s6 GROUP BY 1, 2),
 e1 AS (SELECT *, coalesce(lag(w) OVER ({_VA}), 0e0) AS pos, greatest(coalesce(gap, 1e0), 1e0) AS days, coalesce(CASE session WHEN 'overnight' THEN open / lag(adj_close) OVER ({_VA}) ELSE adj_close / open END - 1e0, 0e0) AS leg FROM s0 WHERE session IS NOT NULL),
 e2 AS (SELECT *, pos * leg AS part, abs(pos) * 2e0 * bps / 1e4 + abs(pos) * {regulatory} AS paid, greatest(1e0 - sum(greatest(pos, 0e0)) OVER (PARTITION BY variant, date), 0e0) * (rf - haircut * days / 365e0) AS cash FROM e1),
 p2 AS (SELECT variant, date, sum(part) + any_value(cash) - sum(paid) AS net, 2e0 * sum(abs(pos)) AS turnover, sum(abs(pos)) AS exposure FROM e2 GROUP BY 1, 2),
 per AS (SELECT variant, split, date, net AS r, net - rf AS x, turnover, exposure, ppy FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) JOIN known USING (variant) JOIN splits ON date BETWEEN a AND b WHERE date >= start),
 sg AS (SELECT variant, asset, date, CASE WHEN abs(pos) < 1e-9 THEN 0 ELSE sign(pos)::INT END AS sg FROM s1),
 tr AS (SELECT variant, date FROM (SELECT *, coalesce(lag(sg) OVER ({_VA}), 0) AS before FROM sg) WHERE sg <> 0 AND sg <> before UNION ALL SELECT variant, date FROM e1 WHERE abs(pos) > 1e-9),
 tc AS (SELECT variant, split, count(*) AS n_trades FROM tr JOIN known USING (variant) JOIN splits ON date BETWEEN a AND b WHERE date >= start GROUP BY 1, 2),
 eq AS (SELECT *, product(1e0 + r) OVER (PARTITION BY variant, split ORDER BY date) AS eq FROM per), dd AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY variant, split ORDER BY date), 1e0) - 1e0 AS dd FROM eq),
 ag AS (SELECT variant, split, count(*) AS n_periods, CASE WHEN product(1e0 + r) > 0 THEN pow(product(1e0 + r), any_value(ppy) / count(*)) - 1e0 ELSE -1e0 END AS cagr, {sharpe('x', 'any_value(ppy)')} AS sharpe, min(dd) AS max_dd, avg(turnover) * any_value(ppy) AS ann_turnover, avg(exposure) AS exposure FROM dd GROUP BY 1, 2),
 br AS (SELECT date, asset, adj_close / lag(adj_close) OVER ({BY}) - 1e0 AS r, 'week' AS calendar FROM panel_week UNION ALL SELECT date, asset, adj_close / lag(adj_close) OVER ({BY}) - 1e0, 'day' FROM panel_day),
 bn AS (SELECT desk, split, {sharpe('r - rf', 'any_value(ppy)')} AS bench_sharpe FROM bench JOIN br USING (asset, calendar) JOIN splits ON date BETWEEN a AND b WHERE r IS NOT NULL AND date >= start GROUP BY 1, 2)
 SELECT k.desk, k.family, ag.variant, ag.split, n_periods, coalesce(n_trades, 0) AS n_trades, cagr, sharpe, max_dd, ann_turnover, exposure, bench_sharpe
 FROM ag JOIN known k USING (variant) LEFT JOIN tc ON tc.variant = ag.variant AND tc.split = ag.split LEFT JOIN bn ON bn.desk = k.desk AND bn.split = ag.split"""


@query("all_families", "desk family variant split n_periods n_trades", "cagr sharpe max_dd ann_turnover exposure bench_sharpe", _all_sql())
def all_families(spark, d):
    """Every family's grid on its own universe, calendar, costs and dates, scored on all splits in one plan."""
    return score_desks(_panels(spark, d), DESKS, SPLITS, opened=True)
