"""Contracts, options, small-account rules and the prediction-market pipeline, over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brassloom.functions import instruments as I
from brassloom.functions.normal import cdf_sql
from brassloom.operators import metrics, prediction
from brassloom.plans.panel import Splits
from brassloom.plans.registry import mean_of_money, mean_of_money_sql, query
from brassloom.sources.tables import table

# --- binary contracts: one per event, its prices and side derived from the event -------------------------------------

_C = """c AS (SELECT event_id, 1 + event_id % 100 AS n, least(greatest(value / 5e2, 1e-2), 9.9e-1) AS price, event_id % 3 = 0 AS maker, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, value > 5e1 AS yes,
  least(value / 5e2, 9.5e-1) AS bid, least(value / 5e2 + 2e-2, 1e0) AS ask, (user_id % 97) / 9.7e1 AS p FROM events)"""


def _contracts(spark, d) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", (1 + i % 100).alias("n"), F.least(F.greatest(v / 500.0, F.lit(0.01)), F.lit(0.99)).alias("price"), (i % 3 == 0).alias("maker"), F.when(i % 2 == 0, "yes").otherwise("no").alias("side"),
        (v > 50).alias("yes"), F.least(v / 500.0, F.lit(0.95)).alias("bid"), F.least(v / 500.0 + 0.02, F.lit(1.0)).alias("ask"), ((F.col("user_id") % 97) / 97.0).alias("p"),
    )


_CEIL = "ceil(round(({0}) * 1e2, 9)) / 1e2"
_FEE = _CEIL.format("{rate} * n * {p} * (1e0 - {p})")
_MAKER = "(CASE WHEN maker THEN 1.75e-2 ELSE 7e-2 END)"
_REBATE = "(CASE WHEN maker THEN -1.25e-2 ELSE 6.95e-2 END) * n * price * (1e0 - price)"


@query("m_contract_fees", "event_id", "taker either other", f"WITH {_C} SELECT event_id, {_FEE.format(rate='7e-2', p='price')} AS taker, {_FEE.format(rate=_MAKER, p='price')} AS either, CASE WHEN {_REBATE} < 0 THEN -({_CEIL.format('-(' + _REBATE + ')')}) ELSE {_CEIL.format(_REBATE)} END AS other FROM c")
def m_contract_fees(spark, d):
    c = _contracts(spark, d)
    return c.select("event_id", I.contract_fee(F.col("n"), F.col("price")).alias("taker"), I.contract_fee(F.col("n"), F.col("price"), F.col("maker")).alias("either"), I.rebate_fee(F.col("n"), F.col("price"), F.col("maker")).alias("other"))


@query("m_binary_quotes", "event_id good", "buy sell", f"WITH {_C} SELECT event_id, bid >= 0 AND bid <= ask AND ask <= 1 AS good, CASE side WHEN 'yes' THEN ask ELSE 1e0 - bid END AS buy, CASE side WHEN 'yes' THEN bid ELSE 1e0 - ask END AS sell FROM c")
def m_binary_quotes(spark, d):
    b, a, s = F.col("bid"), F.col("ask"), F.col("side")
    return _contracts(spark, d).select("event_id", I.good_quote(b, a).alias("good"), I.buy_price(s, b, a).alias("buy"), I.sell_price(s, b, a).alias("sell"))


@query("m_settle", "event_id", "pnl", f"WITH {_C} SELECT event_id, CASE WHEN (side = 'yes') = yes THEN n ELSE 0e0 END - n * price - {_FEE.format(rate='7e-2', p='price')} AS pnl FROM c")
def m_settle(spark, d):
    n, p = F.col("n"), F.col("price")
    return _contracts(spark, d).select("event_id", I.settle(F.col("side"), n, p, F.col("yes"), I.contract_fee(n, p)).alias("pnl"))


@query("m_edge_and_kelly", "event_id", "expected kelly", f"WITH {_C} SELECT event_id, p - price - {_FEE.format(rate='7e-2', p='price')} / n AS expected, CASE WHEN price < 1 THEN greatest(0e0, (p - price) / (1e0 - price)) ELSE 0e0 END AS kelly FROM c")
def m_edge_and_kelly(spark, d):
    n, p = F.col("n"), F.col("price")
    return _contracts(spark, d).select("event_id", I.expected_profit(F.col("p"), p, n).alias("expected"), I.kelly(F.col("p"), p).alias("kelly"))


# --- option positions: an order's line items are the legs of one position ----------------------------------------------

_L = """lg AS (SELECT l_orderkey AS position, CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, l_quantity AS qty, CASE WHEN l_returnflag = 'A' THEN 'C' ELSE 'P' END AS opt,
  5e1 + round(l_quantity) AS strike, floor(l_extendedprice / 1e2 * (1e0 - l_discount)) / 1e2 - 5e-1 AS bid, floor(l_extendedprice / 1e2) / 1e2 AS ask FROM lineitem),
 fl AS (SELECT *, CASE WHEN (CASE side WHEN 'buy' THEN ask ELSE bid END) > 0 AND ask >= bid THEN (CASE side WHEN 'buy' THEN ask ELSE bid END) END AS px FROM lg)"""


def _legs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("position"), F.when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("qty"), F.when(F.col("l_returnflag") == "A", "C").otherwise("P").alias("opt"),
        (50.0 + F.round("l_quantity")).alias("strike"), (F.floor(F.col("l_extendedprice") / 100.0 * (1.0 - F.col("l_discount"))) / 100.0 - 0.5).alias("bid"), (F.floor(F.col("l_extendedprice") / 100.0) / 100.0).alias("ask"),
    ).withColumn("px", I.fill(F.col("side"), F.col("bid"), F.col("ask")))


PASS_THROUGH = 0.04
_PER = f"{PASS_THROUGH:.17e}"


@query("o_open_position", "position filled", "net fees cash spread_cost", f"WITH {_L} SELECT position, count(px) = count(*) AS filled, sum(CASE side WHEN 'sell' THEN px ELSE -px END * 100 * qty) AS net, sum(qty) * {_PER} AS fees, sum(CASE side WHEN 'sell' THEN px ELSE -px END * 100 * qty) - sum(qty) * {_PER} AS cash, sum(qty * 100 * (ask - bid)) AS spread_cost FROM fl GROUP BY 1")
def o_open_position(spark, d):
    signed = F.when(F.col("side") == "sell", F.col("px")).otherwise(-F.col("px")) * I.CONTRACT * F.col("qty")
    out = _legs(spark, d).groupBy("position").agg((F.count("px") == F.count("*")).alias("filled"), F.sum(signed).alias("net"), (F.sum("qty") * PASS_THROUGH).alias("fees"), F.sum(F.col("qty") * I.CONTRACT * (F.col("ask") - F.col("bid"))).alias("spread_cost"))
    return out.withColumn("cash", F.col("net") - F.col("fees"))


@query("o_quote_faults", "l_orderkey l_linenumber fault", "", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag NOT IN ('C', 'P', 'A', 'N') THEN 'right must be C or P' WHEN l_tax < l_discount THEN 'crossed quote' END AS fault FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') OR l_tax < l_discount")
def o_quote_faults(spark, d):
    """Quotes that are refused, with the reason."""
    right = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "P").otherwise(F.col("l_returnflag"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.quote_fault(right, F.col("l_discount"), F.col("l_tax")).alias("fault"))
    return li.where("fault IS NOT NULL")


_POINTS = "ff AS (SELECT * FROM fl WHERE position IN (SELECT position FROM fl GROUP BY 1 HAVING count(px) = count(*))), pt AS (SELECT position, unnest([0e0, hi, hi * 2] || ks) AS spot, hi FROM (SELECT position, list(DISTINCT strike) AS ks, max(strike) * 10 + 1000 AS hi FROM ff GROUP BY 1)), pl AS (SELECT f.position, p.spot, p.hi, sum(CASE f.side WHEN 'sell' THEN f.px ELSE -f.px END * 100 * qty) - sum(qty) * " + _PER + " + sum(CASE f.side WHEN 'buy' THEN 1 ELSE -1 END * qty * 100 * CASE opt WHEN 'C' THEN greatest(p.spot - strike, 0e0) ELSE greatest(strike - p.spot, 0e0) END) AS pnl FROM ff f JOIN pt p ON p.position = f.position GROUP BY 1, 2, 3)"


#: Line items of a task: a position's legs are sorted and its points added up in memory.
TASK_ROWS = 100_000


def _by_position(spark, d) -> DataFrame:
    """Legs shuffled once, by position, into as many tasks as the table is long; what comes after groups by position and stays there."""
    legs = _legs(spark, d)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return legs.repartition(max(few, -(-legs.count() // TASK_ROWS)), "position")


def _pnl(spark, d) -> DataFrame:
    """Profit at expiry at spot 0, at every strike and at two very high spots: enough for a piecewise linear payoff. A position with a leg that doesn't fill is none."""
    w = Window.partitionBy("position")
    legs = _by_position(spark, d).withColumn("unfilled", F.count(F.when(F.col("px").isNull(), 1)).over(w)).where("unfilled = 0")
    legs = legs.withColumn("hi", F.max("strike").over(w) * 10 + 1000).withColumn("ks", F.collect_set("strike").over(w))
    legs = legs.withColumn("spot", F.explode(F.array_union(F.array(F.lit(0.0), F.col("hi"), F.col("hi") * 2), F.col("ks"))))
    cash = F.when(F.col("side") == "sell", F.col("px")).otherwise(-F.col("px")) * I.CONTRACT * F.col("qty") - F.col("qty") * PASS_THROUGH
    value = F.when(F.col("side") == "buy", 1).otherwise(-1) * F.col("qty") * I.CONTRACT * I.intrinsic(F.col("opt"), F.col("strike"), F.col("spot"))
    return legs.groupBy("position", "spot", "hi").agg(F.sum(cash + value).alias("pnl"))


@query("o_pnl_at_expiry", "position", "spot pnl", f"WITH {_L}, {_POINTS} SELECT position, spot, pnl FROM pl")
def o_pnl_at_expiry(spark, d):
    return _pnl(spark, d)


@query("o_max_loss", "position unbounded", "loss", f"WITH {_L}, {_POINTS} SELECT position, max(CASE WHEN spot = 2 * hi THEN pnl END) < max(CASE WHEN spot = hi THEN pnl END) - 1e-6 AS unbounded, greatest(0e0, -min(pnl)) AS loss FROM pl GROUP BY 1")
def o_max_loss(spark, d):
    at = lambda k: F.max(F.when(F.col("spot") == F.col("hi") * k, F.col("pnl")))
    return _pnl(spark, d).groupBy("position").agg((at(2) < at(1) - 1e-6).alias("unbounded"), F.greatest(F.lit(0.0), -F.min("pnl")).alias("loss"))


@query("o_buying_power", "position kind", "need", f"""WITH {_L}, op AS (SELECT position, count(*) AS legs, any_value(opt) AS opt, any_value(side) AS side, any_value(strike) AS strike, any_value(qty) AS qty, sum(CASE side WHEN 'sell' THEN px ELSE -px END * 100 * qty) - sum(qty) * {_PER} AS cash FROM fl GROUP BY 1)
 SELECT position, CASE side WHEN 'buy' THEN CASE opt WHEN 'C' THEN 'long_call' ELSE 'long_put' END ELSE 'cash_secured_put' END AS kind, CASE side WHEN 'buy' THEN -cash ELSE strike * 100 * qty - cash END AS need FROM op WHERE legs = 1 AND (side = 'buy' OR opt = 'P')""")
def o_buying_power(spark, d):
    """Cash needed for single-leg positions: the debit of a long option, the strike less the premium of a secured put."""
    signed = F.when(F.col("side") == "sell", F.col("px")).otherwise(-F.col("px")) * I.CONTRACT * F.col("qty") - F.col("qty") * PASS_THROUGH
    one = _legs(spark, d).groupBy("position").agg(F.count("*").alias("legs"), *[F.any_value(c).alias(c) for c in ("opt", "side", "strike", "qty")], F.sum(signed).alias("cash")).where("legs = 1 AND (side = 'buy' OR opt = 'P')")
    kind = F.when(F.col("side") == "buy", F.when(F.col("opt") == "C", "long_call").otherwise("long_put")).otherwise("cash_secured_put")
    return one.select("position", kind.alias("kind"), F.when(F.col("side") == "buy", -F.col("cash")).otherwise(F.col("strike") * I.CONTRACT * F.col("qty") - F.col("cash")).alias("need"))


_KIND = """CASE WHEN legs = 1 THEN CASE WHEN buys = 1 THEN CASE WHEN calls = 1 THEN 'long_call' ELSE 'long_put' END WHEN calls = 0 THEN 'cash_secured_put' ELSE 'naked_call' END
 WHEN legs = 2 AND buys = 2 AND calls = 1 THEN CASE WHEN strikes = 1 THEN 'long_straddle' ELSE 'long_strangle' END WHEN legs = 2 AND buys = 1 AND calls <> 1 THEN CASE WHEN cash < 0 THEN 'debit_spread' ELSE 'credit_spread' END
 WHEN legs = 4 AND buys = 2 AND calls = 2 THEN CASE WHEN strikes = 3 THEN 'iron_butterfly' ELSE 'iron_condor' END ELSE 'other' END"""
_LEVEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.LEVELS.items()) + " END"


@query("o_required", "position kind level", "need", f"""WITH {_L}, {_POINTS}, ml AS (SELECT position, CASE WHEN max(CASE WHEN spot = 2 * hi THEN pnl END) < max(CASE WHEN spot = hi THEN pnl END) - 1e-6 THEN NULL ELSE greatest(0e0, -min(pnl)) END AS loss FROM pl GROUP BY 1),
 op AS (SELECT position, count(*) AS legs, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE opt = 'C') AS calls, count(DISTINCT strike) AS strikes, sum(strike * 100 * qty) AS secured, sum(CASE side WHEN 'sell' THEN px ELSE -px END * 100 * qty) - sum(qty) * {_PER} AS cash FROM ff GROUP BY 1),
 kd AS (SELECT op.*, ml.loss, {_KIND} AS kind FROM op JOIN ml USING (position))
 SELECT position, kind, ({_LEVEL})::BIGINT AS level, CASE WHEN kind IN {I.DEBIT} THEN -cash WHEN kind = 'cash_secured_put' THEN secured - cash ELSE loss END AS need FROM kd""")
def o_required(spark, d):
    """Each position's kind, the approval level it needs and the cash: spreads, condors and straddles as well as single legs."""
    w = Window.partitionBy("position")
    legs = _by_position(spark, d).withColumn("unfilled", F.count(F.when(F.col("px").isNull(), 1)).over(w)).where("unfilled = 0")
    signed = F.when(F.col("side") == "sell", F.col("px")).otherwise(-F.col("px")) * I.CONTRACT * F.col("qty") - F.col("qty") * PASS_THROUGH
    own = legs.groupBy("position").agg(
        F.count("*").alias("legs"), F.count(F.when(F.col("side") == "buy", 1)).alias("buys"), F.count(F.when(F.col("opt") == "C", 1)).alias("calls"), F.countDistinct("strike").alias("strikes"),
        F.sum(F.col("strike") * I.CONTRACT * F.col("qty")).alias("secured"), F.sum(signed).alias("cash"),
    )
    at = lambda k: F.max(F.when(F.col("spot") == F.col("hi") * k, F.col("pnl")))
    loss = _pnl(spark, d).groupBy("position").agg(F.when(at(2) >= at(1) - 1e-6, F.greatest(F.lit(0.0), -F.min("pnl"))).alias("loss"))
    out = own.join(loss, "position").withColumn("kind", F.expr(_KIND))
    return out.select("position", "kind", I.level(F.col("kind")).cast("long").alias("level"), I.buying_power(F.col("kind"), F.col("cash"), F.col("secured"), F.col("loss")).alias("need"))


# --- small accounts -----------------------------------------------------------------------------------------------------


@query("c_rounding", "o_orderkey", "worst cash_left", "WITH x AS (SELECT l_orderkey AS o_orderkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS w, l_extendedprice / l_quantity / 1e1 AS px FROM lineitem), y AS (SELECT *, floor(w * 5e3 / px + 1e-12) AS sh FROM x) SELECT o_orderkey, max(abs(sh * px / 5e3 - w)) AS worst, 5e3 - sum(sh * px) AS cash_left FROM y GROUP BY 1")
def c_rounding(spark, d):
    """How far whole shares push an order's items from their weights in an account of 5000."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))).alias("w"), (F.col("l_extendedprice") / F.col("l_quantity") / 10.0).alias("px"))
    y = x.withColumn("sh", I.shares(F.col("w"), F.col("px"), 5000.0))
    return y.groupBy("o_orderkey").agg(F.max(F.abs(F.col("sh") * F.col("px") / 5000.0 - F.col("w"))).alias("worst"), (F.lit(5000.0) - F.sum(F.col("sh") * F.col("px"))).alias("cash_left"))


_TRIPS = "tp AS (SELECT user_id, ts AS entry, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS exit FROM events), dt AS (SELECT user_id, entry::DATE AS day, count(*) AS n FROM tp WHERE entry::DATE = exit::DATE GROUP BY 1, 2)"


def _day_trades(spark, d) -> DataFrame:
    trips = table(spark, d, "events").select("user_id", F.col("ts").alias("entry"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("exit"))
    return trips.where(F.to_date("entry") == F.to_date("exit")).groupBy("user_id", F.to_date("entry").alias("day")).agg(F.count("*").alias("n"))


@query("c_day_trades", "user_id day n", "", f"WITH {_TRIPS} SELECT * FROM dt")
def c_day_trades(spark, d):
    return _day_trades(spark, d)


@query("c_pattern_day_trader", "user_id worst ok", "", f"WITH {_TRIPS}, cal AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT user_id, min(day)::TIMESTAMP AS lo, max(day)::TIMESTAMP AS hi FROM dt GROUP BY 1)), b AS (SELECT cal.user_id, cal.day, coalesce(n, 0) AS n FROM cal LEFT JOIN dt ON dt.user_id = cal.user_id AND dt.day = cal.day WHERE isodow(cal.day) <= 5), r AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM b) SELECT user_id, max(s)::BIGINT AS worst, max(s) <= 3 AS ok FROM r GROUP BY 1")
def c_pattern_day_trader(spark, d):
    """Most day trades in any five business days; those on weekends don't count."""
    t = _day_trades(spark, d)
    days = t.groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("day")).where(F.weekday("day") < 5)
    n = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-4, 0))
    return days.join(t, ["user_id", "day"], "left").withColumn("s", n).groupBy("user_id").agg(F.max("s").alias("worst"), (F.max("s") <= 3).alias("ok"))


@query("c_account_fit", "event_id fits event_ok", "put_min", "SELECT event_id, value * 100 <= 5e3 AS fits, value * 10 <= 2.5e-1 * 5e3 AS event_ok, value * 100 * 2 AS put_min FROM events")
def c_account_fit(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", (v * 100 <= 5000.0).alias("fits"), (v * 10 <= 0.25 * 5000.0).alias("event_ok"), (v * 100 * 2).alias("put_min"))


# --- prediction pipeline: users' days are markets, their clicks candles, their views forecasts -------------------------------

_K = f"""mk AS (SELECT 'U' || user_id::VARCHAR AS ticker, user_id % 5 AS series, ts::DATE AS D, avg(value) AS actual, CASE WHEN avg(value) > 6e1 THEN 1 ELSE 0 END AS y, CASE user_id % 3 WHEN 0 THEN 'greater' WHEN 1 THEN 'less' ELSE 'between' END AS strike_type, 6e1 AS floor_strike, 9e1 AS cap_strike FROM events GROUP BY user_id, ts::DATE),
 fc AS (SELECT date_trunc('hour', ts) AS runtime, (ts::DATE + 1 + (event_id % 2)::INT)::TIMESTAMP AS ftime, avg(value) AS txn, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE stddev_pop(value) END AS xnd FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 cd AS (SELECT 'U' || user_id::VARCHAR AS ticker, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts, least(max(value) / 5e2, 9.7e-1) AS bid_close, least(max(value) / 5e2 + 2e-2, 9.9e-1) AS ask_close, count(*)::DOUBLE * 2e1 AS volume FROM events GROUP BY 1, 2),
 cq AS (SELECT *, sum(volume) OVER (PARTITION BY ticker ORDER BY end_ts ROWS UNBOUNDED PRECEDING) AS cum FROM cd),
 dtm AS (SELECT mk.*, x.nm AS dt_name, (D + x.o)::TIMESTAMP + to_hours(x.h) AS dt, (D + x.o)::TIMESTAMP + to_hours(x.h - 3) AS avail, (D + 1)::TIMESTAMP AS ftime FROM mk CROSS JOIN (VALUES ('DT1', -1, 20), ('DT2', 0, 10)) x(nm, o, h)),
 j1 AS (SELECT d.*, CASE WHEN epoch(d.avail) - epoch(f.runtime) <= 43200 THEN f.txn END AS txn, CASE WHEN epoch(d.avail) - epoch(f.runtime) <= 43200 THEN f.xnd END AS xnd FROM dtm d ASOF LEFT JOIN fc f ON f.ftime = d.ftime AND d.avail >= f.runtime),
 j2 AS (SELECT j.*, CASE WHEN epoch(j.dt) - epoch(q.end_ts) <= 14400 THEN q.end_ts END AS end_ts, CASE WHEN epoch(j.dt) - epoch(q.end_ts) <= 14400 THEN q.bid_close END AS bid_close, CASE WHEN epoch(j.dt) - epoch(q.end_ts) <= 14400 THEN q.ask_close END AS ask_close, CASE WHEN epoch(j.dt) - epoch(q.end_ts) <= 14400 THEN q.cum END AS cum FROM j1 j ASOF LEFT JOIN cq q ON q.ticker = j.ticker AND j.dt >= q.end_ts),
 j3 AS (SELECT j.*, j.cum - coalesce(q.cum, 0e0) AS volume, (epoch(j.dt) - epoch(j.end_ts)) / 3.6e3 AS quote_age_h FROM j2 j ASOF LEFT JOIN cq q ON q.ticker = j.ticker AND j.dt - INTERVAL 6 HOUR >= q.end_ts)"""


def _exact_mean(x: str):
    """A mean that doesn't depend on the order of rows: amounts are added up as decimals, if all of them are such, so that a mean at a border stays there."""
    amount = F.expr(f"try_cast({x} AS DECIMAL(30,12))")
    return F.when(F.count(amount) == F.count(x), F.sum(amount).cast("double") / F.count(x)).otherwise(F.avg(x))


def _markets(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ticker = F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")
    mk = e.groupBy("user_id", F.to_date("ts").alias("D")).agg(_exact_mean("value").alias("actual"))
    kind = F.when(F.col("user_id") % 3 == 0, "greater").when(F.col("user_id") % 3 == 1, "less").otherwise("between")
    mk = mk.select(ticker, (F.col("user_id") % 5).alias("series"), "D", "actual", F.when(F.col("actual") > 60, 1).otherwise(0).alias("y"), kind.alias("strike_type"), F.lit(60.0).alias("floor_strike"), F.lit(90.0).alias("cap_strike"))
    ahead = F.date_add(F.to_date("ts"), 1 + (F.col("event_id") % 2).cast("int")).cast("timestamp")
    fc = e.where("event_type = 'view'").groupBy(F.date_trunc("hour", "ts").alias("runtime"), ahead.alias("ftime")).agg(_exact_mean("value").alias("txn"), F.when(F.count("*") % 3 != 0, F.stddev_pop("value")).alias("xnd"))
    end = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
    cd = e.groupBy(ticker, end.alias("end_ts")).agg(F.least(F.max("value") / 500.0, F.lit(0.97)).alias("bid_close"), F.least(F.max("value") / 500.0 + 0.02, F.lit(0.99)).alias("ask_close"), (F.count("*").cast("double") * 20.0).alias("volume"))
    return prediction.build_markets(mk, fc, cd)


@query("k_build_markets", "ticker series D dt_name y", "txn xnd bid_close ask_close volume quote_age_h", f"WITH {_K} SELECT *  REPLACE (y::BIGINT AS y) FROM j3")
def k_build_markets(spark, d):
    return _markets(spark, d)


_BIAS = f"""{_K}, ev AS (SELECT series, dt_name, D, arg_min(actual, ticker) - arg_min(coalesce(txn, -1e300), ticker) AS r0, arg_min(coalesce(txn, -1e300), ticker) AS t0 FROM j3 GROUP BY 1, 2, 3), er AS (SELECT *, CASE WHEN t0 > -1e299 THEN r0 END AS res FROM ev),
 eb AS (SELECT series, dt_name, D, CASE WHEN dt_name = 'DT1' THEN CASE WHEN count(res) OVER (w ROWS BETWEEN 61 PRECEDING AND 2 PRECEDING) >= 5 THEN avg(res) OVER (w ROWS BETWEEN 61 PRECEDING AND 2 PRECEDING) END ELSE CASE WHEN count(res) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 5 THEN avg(res) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END END AS bias FROM er WINDOW w AS (PARTITION BY series, dt_name ORDER BY D)),
 kb AS (SELECT j3.*, eb.bias FROM j3 LEFT JOIN eb USING (series, dt_name, D))"""


@query("k_rolling_bias", "ticker series D dt_name", "txn bias", f"WITH {_BIAS} SELECT * FROM kb")
def k_rolling_bias(spark, d):
    return prediction.rolling_bias(_markets(spark, d), least=5)


_SIG = "sqrt(2.25e0 + pow(5e-1 * coalesce(xnd, 2e0), 2e0))"
_PROB = f"""{_BIAS}, kz AS (SELECT *, (floor_strike + 5e-1 - txn - bias) / {_SIG} AS zg, (cap_strike - 5e-1 - txn - bias) / {_SIG} AS zl, (cap_strike + 5e-1 - txn - bias) / {_SIG} AS zh, (floor_strike - 5e-1 - txn - bias) / {_SIG} AS zf FROM kb),
 kq AS (SELECT *, CASE strike_type WHEN 'greater' THEN 1e0 - {cdf_sql('zg')} WHEN 'less' THEN {cdf_sql('zl')} ELSE {cdf_sql('zh')} - {cdf_sql('zf')} END AS p0 FROM kz), kp AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN least(greatest(p0, 1e-4), 1e0 - 1e-4) END AS p FROM kq)"""


def _with_p(spark, d) -> DataFrame:
    return prediction.with_probability(prediction.rolling_bias(_markets(spark, d), least=5), 1.5, 0.5)


@query("k_probability", "ticker series D dt_name", "p", f"WITH {_PROB} SELECT * FROM kp")
def k_probability(spark, d):
    return _with_p(spark, d)


_TRADES = f"""{_PROB}, s1 AS (SELECT *, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND ask_close < 9.9e-1 AND ask_close > 0 THEN least(ask_close + 1e-2, 9.9e-1) END AS py, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND bid_close > 1e-2 AND bid_close < 1 THEN least(1e0 - bid_close + 1e-2, 9.9e-1) END AS pn FROM kp),
 s2 AS (SELECT *, p - py - 7e-2 * py * (1 - py) AS ey, (1 - p) - pn - 7e-2 * pn * (1 - pn) AS en FROM s1), s3 AS (SELECT *, coalesce(ey, -9e0) >= coalesce(en, -9e0) AS side_yes FROM s2), s4 AS (SELECT *, CASE WHEN side_yes THEN ey ELSE en END AS edge, CASE WHEN side_yes THEN py ELSE pn END AS price FROM s3),
 s5 AS (SELECT *, row_number() OVER (PARTITION BY dt_name, D ORDER BY edge DESC, ticker) AS rk FROM s4 WHERE edge >= 5e-2), s6 AS (SELECT *, least(greatest(floor(5e1 / price), 1), greatest(1, floor(1e-1 * coalesce(volume, 0))))::BIGINT AS n, CASE WHEN side_yes THEN y = 1 ELSE y = 0 END AS win FROM s5 WHERE rk <= 8),
 s7 AS (SELECT *, ceil(round(7e-2 * n * price * (1e0 - price) * 1e2, 9)) / 1e2 AS fee FROM s6), ktr AS (SELECT *, n * (CASE WHEN win THEN 1e0 ELSE 0e0 END - price) - fee AS pnl FROM s7)"""


@query("k_simulate", "ticker D dt_name side_yes win n", "edge price fee pnl", f"WITH {_TRADES} SELECT * FROM ktr")
def k_simulate(spark, d):
    return prediction.simulate_trades(_with_p(spark, d), 0.05)


_FAVOURITE = f"""{_K}, s1 AS (SELECT *, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND ask_close < 9.9e-1 AND ask_close > 0 THEN least(ask_close + 1e-2, 9.9e-1) END AS py, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND bid_close > 1e-2 AND bid_close < 1 THEN least(1e0 - bid_close + 1e-2, 9.9e-1) END AS pn FROM j3),
 s2 AS (SELECT *, coalesce(py >= 7e-1, false) AS side_yes FROM s1 WHERE coalesce(py >= 7e-1, false) OR coalesce(pn >= 7e-1, false)), s3 AS (SELECT *, CASE WHEN side_yes THEN py ELSE pn END AS price FROM s2), s4 AS (SELECT *, least(greatest(floor(5e1 / price), 1), greatest(1, floor(1e-1 * coalesce(volume, 0))))::BIGINT AS n, CASE WHEN side_yes THEN y = 1 ELSE y = 0 END AS win FROM s3)"""


@query("k_favourites", "ticker D dt_name side_yes win n", "price pnl", f"WITH {_FAVOURITE} SELECT *, n * (CASE WHEN win THEN 1e0 ELSE 0e0 END - price) - ceil(round(7e-2 * n * price * (1e0 - price) * 1e2, 9)) / 1e2 * 2e0 AS pnl FROM s4")
def k_favourites(spark, d):
    return prediction.simulate_trades(_markets(spark, d).withColumn("p", F.lit(None).cast("double")), 0.0, fee_mult=2.0, longshot=0.3)


def _days(spark, d) -> DataFrame:
    """Every day that markets cover, per decision time."""
    day = F.to_date("ts")
    ends = table(spark, d, "events").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("date")).withColumn("dt_name", F.explode(F.array(F.lit("DT1"), F.lit("DT2"))))


@query("k_daily_returns", "dt_name date", "r", f"WITH {_TRADES}, sp AS (SELECT min(D) AS lo, max(D) AS hi FROM j3), cal AS (SELECT x.dt_name, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM sp CROSS JOIN (VALUES ('DT1'), ('DT2')) x(dt_name)), dy AS (SELECT dt_name, D AS date, sum(pnl) / 5e3 AS r FROM ktr GROUP BY 1, 2) SELECT cal.dt_name, cal.date, coalesce(dy.r, 0e0) AS r FROM cal LEFT JOIN dy ON dy.dt_name = cal.dt_name AND dy.date = cal.date")
def k_daily_returns(spark, d):
    rows = _with_p(spark, d)
    return prediction.daily_returns(prediction.simulate_trades(rows, 0.05), ["dt_name"], _days(spark, d))


@query("k_trade_summary", "dt_name n_trades", "win_rate avg_pnl", f"WITH {_TRADES} SELECT dt_name, count(*) AS n_trades, avg(CASE WHEN win THEN 1e0 ELSE 0e0 END) AS win_rate, avg(pnl) AS avg_pnl FROM ktr GROUP BY 1")
def k_trade_summary(spark, d):
    t = prediction.simulate_trades(_with_p(spark, d), 0.05)
    return t.groupBy("dt_name").agg(F.count("*").alias("n_trades"), F.avg(F.when(F.col("win"), 1.0).otherwise(0.0)).alias("win_rate"), F.avg("pnl").alias("avg_pnl"))


@query("k_forecast_errors", "series year n", "mean std mae", f"WITH {_K}, ev AS (SELECT series, D, arg_min(actual, ticker) AS a, arg_min(coalesce(txn, -1e300), ticker) AS t FROM j3 WHERE dt_name = 'DT1' GROUP BY 1, 2), er AS (SELECT series, year(D) AS year, a - t AS e FROM ev WHERE t > -1e299) SELECT series, year, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, avg(abs(e)) AS mae FROM er GROUP BY 1, 2")
def k_forecast_errors(spark, d):
    ev = _markets(spark, d).where("dt_name = 'DT1'").groupBy("series", "D").agg(F.min(F.struct("ticker", "actual", "txn")).alias("s"))
    e = F.col("s.actual") - F.col("s.txn")
    return ev.where(F.col("s.txn").isNotNull()).groupBy("series", F.year("D").alias("year")).agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.avg(F.abs(e)).alias("mae"))


@query("k_calibration", "bucket n", "mid model actual brier", f"WITH {_PROB}, cb AS (SELECT *, (bid_close + ask_close) / 2e0 AS mid FROM kp WHERE p IS NOT NULL AND ask_close IS NOT NULL) SELECT CASE WHEN mid <= 1e-1 THEN 0 WHEN mid <= 3e-1 THEN 1 WHEN mid <= 5e-1 THEN 2 WHEN mid <= 7e-1 THEN 3 ELSE 4 END::BIGINT AS bucket, count(*) AS n, avg(mid) AS mid, avg(p) AS model, avg(y) AS actual, avg(pow(p - y, 2)) AS brier FROM cb GROUP BY 1")
def k_calibration(spark, d):
    rows = _with_p(spark, d).withColumn("mid", (F.col("bid_close") + F.col("ask_close")) / 2.0).where(F.col("p").isNotNull() & F.col("mid").isNotNull())
    bucket = F.when(F.col("mid") <= 0.1, 0).when(F.col("mid") <= 0.3, 1).when(F.col("mid") <= 0.5, 2).when(F.col("mid") <= 0.7, 3).otherwise(4)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("mid").alias("mid"), F.avg("p").alias("model"), F.avg("y").alias("actual"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))


@query("k_fit_sigma", "dt_name n", "a c")
def k_fit_sigma(spark, d):
    """A fit by most likelihood; no SQL."""
    rows = prediction.rolling_bias(_markets(spark, d), least=5)
    found = [(n, prediction.fit_sigma(rows.where(F.col("dt_name") == n), "2024-01-20")) for n in prediction.DECISIONS]
    return spark.createDataFrame([(n, f["n"], f["a"], f["c"]) for n, f in found], "dt_name string, n long, a double, c double")


@query("k_event_date", "o_orderkey date", "", "SELECT o_orderkey, make_date(2000 + (year(o_orderdate) % 100)::INT, month(o_orderdate)::INT, day(o_orderdate)::INT) AS date FROM orders")
def k_event_date(spark, d):
    """Tickers have two digits for the year, which count from 2000."""
    o = table(spark, d, "orders")
    t = F.concat(F.lit("KX-"), F.upper(F.date_format("o_orderdate", "yyMMMdd")))
    return o.select("o_orderkey", prediction.event_date(t).alias("date"))


@query("k_summary", "dt_name n_periods", "cagr sharpe max_dd", f"WITH {_TRADES}, sp AS (SELECT min(D) AS lo, max(D) AS hi FROM j3), cal AS (SELECT x.dt_name, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM sp CROSS JOIN (VALUES ('DT1'), ('DT2')) x(dt_name)), dy AS (SELECT dt_name, D AS date, sum(pnl) / 5e3 AS r FROM ktr GROUP BY 1, 2), dl AS (SELECT cal.dt_name, cal.date, coalesce(dy.r, 0e0) AS r FROM cal LEFT JOIN dy ON dy.dt_name = cal.dt_name AND dy.date = cal.date), de AS (SELECT *, product(1e0 + r) OVER (PARTITION BY dt_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM dl), dd AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY dt_name ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1e0 AS dd FROM de) SELECT dt_name, count(*) AS n_periods, CASE WHEN product(1e0 + r) > 0 THEN pow(product(1e0 + r), 3.65e2 / count(r)) - 1e0 ELSE -1e0 END AS cagr, avg(r) / nullif(stddev_samp(r), 0) * sqrt(3.65e2) AS sharpe, min(dd) AS max_dd FROM dd GROUP BY 1")
def k_summary(spark, d):
    """Metrics of the simulated trades' daily returns."""
    rows = _with_p(spark, d)
    r = prediction.daily_returns(prediction.simulate_trades(rows, 0.05), ["dt_name"], _days(spark, d))
    return metrics.summarize(r.withColumn("rf", F.lit(0.0)), ["dt_name"], 365)


# --- the grid of configurations: thresholds and favourites, at plain and doubled costs, on each split ---------------------------------

PREDICTION = Splits("2024-01-15", "2024-01-25")
CONFIGS = [
    prediction.Config(f"{dt}_{name}_x{cost:.0f}", dt, theta, longshot, frac, top_k, cost)
    for dt in prediction.DECISIONS
    for name, theta, longshot, frac, top_k in [("theta3", 0.03, None, 0.01, 8), ("theta5", 0.05, None, 0.01, 8), ("theta8", 0.08, None, 0.01, 8), ("fav5", 0.0, 0.05, 0.0025, 0), ("fav10", 0.0, 0.10, 0.0025, 0)]
    for cost in (1.0, 2.0)
]
_CFG = "cfg(variant, of, theta, longshot, frac, topk, cost) AS (VALUES " + ", ".join(f"('{c.variant}', '{c.dt_name}', {c.theta:.17e}, {'NULL' if c.longshot is None else f'{c.longshot:.17e}'}, {c.frac:.17e}, {c.top_k}, {c.cost:.17e})" for c in CONFIGS) + ")"
_BOUNDS = f"bd(split, a, b) AS (VALUES ('DEVELOPMENT', DATE '1900-01-01', DATE '{PREDICTION.dev_end}'), ('VALIDATION', DATE '{PREDICTION.dev_end}' + 1, DATE '{PREDICTION.val_end}'), ('DEV+VAL', DATE '1900-01-01', DATE '{PREDICTION.val_end}'))"
_GRID = f"""{_PROB}, {_CFG}, {_BOUNDS},
 q1 AS (SELECT *, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND ask_close < 9.9e-1 AND ask_close > 0 THEN least(ask_close + 1e-2 * cost, 9.9e-1) END AS py, CASE WHEN ask_close IS NOT NULL AND bid_close IS NOT NULL AND coalesce(volume, 0) > 0 AND bid_close > 1e-2 AND bid_close < 1 THEN least(1e0 - bid_close + 1e-2 * cost, 9.9e-1) END AS pn FROM kp JOIN cfg ON cfg.of = kp.dt_name WHERE p IS NOT NULL AND D <= DATE '{PREDICTION.val_end}'),
 q2 AS (SELECT *, p - py - 7e-2 * cost * py * (1 - py) AS ey, (1 - p) - pn - 7e-2 * cost * pn * (1 - pn) AS en FROM q1),
 q3 AS (SELECT *, CASE WHEN longshot IS NULL THEN coalesce(ey, -9e0) >= coalesce(en, -9e0) ELSE coalesce(py >= 1e0 - longshot, false) END AS side_yes FROM q2),
 q4 AS (SELECT *, CASE WHEN longshot IS NULL THEN CASE WHEN side_yes THEN ey ELSE en END ELSE 1e0 END AS edge, CASE WHEN side_yes THEN py ELSE pn END AS price FROM q3),
 q5 AS (SELECT *, row_number() OVER (PARTITION BY variant, D ORDER BY edge DESC, ticker) AS rk FROM q4 WHERE CASE WHEN longshot IS NULL THEN edge >= theta ELSE side_yes OR coalesce(pn >= 1e0 - longshot, false) END),
 q6 AS (SELECT *, least(greatest(floor(frac * 5e3 / price), 1), greatest(1, floor(1e-1 * coalesce(volume, 0))))::BIGINT AS n, CASE WHEN side_yes THEN y = 1 ELSE y = 0 END AS win FROM q5 WHERE topk = 0 OR rk <= topk),
 q7 AS (SELECT *, n * (CASE WHEN win THEN 1e0 ELSE 0e0 END - price) - ceil(round(7e-2 * n * price * (1e0 - price) * 1e2, 9)) / 1e2 * cost AS pnl FROM q6),
 qs AS (SELECT variant, split, count(*) AS n_trades, avg(CASE WHEN win THEN 1e0 ELSE 0e0 END) AS win_rate, {mean_of_money_sql('pnl')} AS avg_pnl FROM q7 JOIN bd ON D BETWEEN a AND b GROUP BY 1, 2),
 sp AS (SELECT min(D) AS lo FROM kp WHERE p IS NOT NULL), days AS (SELECT unnest(generate_series(lo::TIMESTAMP, TIMESTAMP '{PREDICTION.val_end}', INTERVAL 1 DAY))::DATE AS date FROM sp),
 qd AS (SELECT variant, D, sum(pnl) / 5e3 AS r FROM q7 GROUP BY 1, 2), dl AS (SELECT cfg.variant, days.date, coalesce(r, 0e0) AS r FROM cfg CROSS JOIN days LEFT JOIN qd ON qd.variant = cfg.variant AND qd.D = days.date),
 qe AS (SELECT variant, split, date, r, product(1e0 + r) OVER (PARTITION BY variant, split ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM dl JOIN bd ON date BETWEEN a AND b),
 qm AS (SELECT variant, split, count(*) AS n_periods, CASE WHEN product(1e0 + r) > 0 THEN pow(product(1e0 + r), 3.65e2 / count(r)) - 1e0 ELSE -1e0 END AS cagr, avg(r) / nullif(stddev_samp(r), 0) * sqrt(3.65e2) AS sharpe, min(dd) AS max_dd FROM (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY variant, split ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1e0 AS dd FROM qe) GROUP BY 1, 2)"""


def _settled(spark, d) -> DataFrame:
    """Markets up to the end of validation whose probability is known."""
    return _with_p(spark, d).where(F.col("p").isNotNull() & (F.col("D") <= F.lit(PREDICTION.val_end).cast("date")))


@query("k_grid", "variant split n_trades n_periods", "win_rate avg_pnl cagr sharpe max_dd", f"WITH {_GRID} SELECT * FROM qs JOIN qm USING (variant, split)")
def k_grid(spark, d):
    """All configurations in one plan: a market is exploded into those that trade it, each day's trades into the splits that hold it."""
    trades = prediction.simulate_configs(_settled(spark, d), CONFIGS)
    counts = PREDICTION.explode(trades.withColumn("date", F.col("D"))).groupBy("variant", "split").agg(F.count("*").alias("n_trades"), F.avg(F.when(F.col("win"), 1.0).otherwise(0.0)).alias("win_rate"), mean_of_money("pnl").alias("avg_pnl"))
    first = _settled(spark, d).agg(F.min("D").alias("lo"))
    days = first.select(F.explode(F.sequence("lo", F.lit(PREDICTION.val_end).cast("date"))).alias("date")).withColumn("variant", F.explode(F.array(*[F.lit(c.variant) for c in CONFIGS])))
    daily = prediction.daily_returns(trades, ["variant"], days).withColumn("rf", F.lit(0.0))
    return metrics.summarize(PREDICTION.explode(daily), ["variant", "split"], 365).join(counts, ["variant", "split"])


@query("k_coverage", "series dt_name n n_forecast n_quote", "forecast_share quote_share", f"WITH {_K} SELECT series, dt_name, count(*) AS n, count(txn) AS n_forecast, count(ask_close) AS n_quote, count(txn) / count(*)::DOUBLE AS forecast_share, count(ask_close) / count(*)::DOUBLE AS quote_share FROM j3 GROUP BY 1, 2")
def k_coverage(spark, d):
    """How many markets have a forecast and a standing quote when they are decided on."""
    return prediction.coverage(_markets(spark, d), ["series", "dt_name"])


@query("k_calendar_returns", "date", "r rf", "WITH bar AS (SELECT ts::DATE AS date, arg_max(value, event_id) AS close FROM events WHERE isodow(ts) <= 5 GROUP BY 1), px AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1e0 AS r, close / 1e3 AS annual FROM bar), cal AS (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM bar) SELECT c.date, coalesce(p.r, 0e0) AS r, q.annual / 3.65e2 AS rf FROM cal c LEFT JOIN px p ON p.date = c.date ASOF LEFT JOIN px q ON c.date >= q.date")
def k_calendar_returns(spark, d):
    """Returns of a series that has weekdays only on every calendar day, and a yearly rate spread over 365 days."""
    e = table(spark, d, "events").where(F.weekday("ts") < 5)
    bars = e.groupBy(F.to_date("ts").alias("date")).agg(F.max_by("value", "event_id").alias("close")).withColumn("asset", F.lit("all"))
    return prediction.calendar_returns(bars.withColumn("annual", F.col("close") / 1000.0), ["asset"])
