"""Prediction-market pipeline: markets with point-in-time forecasts and quotes, probabilities, bias, simulated trades."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brassloom.functions.instruments import ceil_cent
from brassloom.functions.normal import cdf
from brassloom.operators.asof import asof_lookup
from brassloom.operators.stats import nelder_mead
from brassloom.operators.windows import rolling_mean

#: Decision times: days from the event's day, and the hour (UTC).
DECISIONS = {"DT1": (-1, 20), "DT2": (0, 10)}
LAG_HOURS, FORECAST_HOURS, QUOTE_SECONDS = 3, 12, 14_400

_MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def event_date(ticker: Column) -> Column:
    """The date at the end of a ticker such as X-24JAN05; NULL without one."""
    part = lambda k: F.regexp_extract(ticker, r"-(\d{2})([A-Z]{3})(\d{2})$", k)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), part(2)).cast("int")
    good = (part(2) != "") & (month > 0)
    return F.when(good, F.make_date(F.lit(2000) + F.when(good, part(1)).cast("int"), F.when(good, month), F.when(good, part(3)).cast("int")))


def build_markets(markets: DataFrame, forecasts: DataFrame, candles: DataFrame) -> DataFrame:
    """One row per market and decision time: the forecast known then, the standing quote, recent volume, the outcome.

    markets (ticker, D, y, actual, strike columns), forecasts (runtime, ftime, txn, xnd), candles (ticker, end_ts,
    bid_close, ask_close, volume). All lookups are as-of joins; each is one shuffle by its key.
    """
    times = F.array(*[F.struct(F.lit(n).alias("dt_name"), F.lit(off).alias("off"), F.lit(hour).alias("hour")) for n, (off, hour) in DECISIONS.items()])
    e = markets.withColumn("_s", F.explode(times))
    stamp = F.date_add("D", F.col("_s.off")).cast("timestamp") + F.make_dt_interval(hours=F.col("_s.hour"))
    e = e.withColumn("dt_name", F.col("_s.dt_name")).withColumn("dt", stamp).drop("_s")
    e = e.withColumn("avail", F.col("dt") - F.make_dt_interval(hours=F.lit(LAG_HOURS))).withColumn("ftime", F.date_add("D", 1).cast("timestamp"))
    known = forecasts.where((F.hour("ftime") == 0) & F.col("txn").isNotNull())
    # All markets of a day ask for one forecast at two times.
    e = asof_lookup(e, known, "avail", "runtime", ["ftime"], ["txn", "xnd"], FORECAST_HOURS * 3600)
    return with_quotes(e, candles).drop("end_ts")


def with_quotes(markets: DataFrame, candles: DataFrame, hours: float = 6) -> DataFrame:
    """markets (ticker, dt and others) with the quote standing at dt, its age in hours and the volume of the hours before dt.

    Markets and candles are united and shuffled once, by ticker: one frame carries the last quote on, a second one adds up
    what was traded up to dt and a third what was traded up to some hours before it.
    """
    quote = F.struct("end_ts", "bid_close", "ask_close")
    side = candles.select("ticker", F.col("end_ts").alias("_t"), quote.alias("_q"), F.col("volume").alias("_v")).withColumn("_side", F.lit(0))
    both = markets.withColumn("_t", F.col("dt")).withColumn("_side", F.lit(1)).unionByName(side, allowMissingColumns=True)
    both = both.withColumn("_at", F.unix_seconds("_t"))
    rows = Window.partitionBy("ticker").orderBy("_at", "_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("ticker").orderBy("_at").rangeBetween(Window.unboundedPreceding, -int(hours * 3600))
    both = both.withColumn("_q", F.last("_q", ignorenulls=True).over(rows)).withColumn("_now", F.sum("_v").over(rows)).withColumn("_then", F.sum("_v").over(before))
    age = F.col("dt").cast("double") - F.col("_q.end_ts").cast("double")
    good = age <= QUOTE_SECONDS
    volume = F.when(good, F.col("_now") - F.coalesce("_then", F.lit(0.0)))
    found = both.where("_side = 1")
    return found.select(*markets.columns, *[F.when(good, F.col(f"_q.{c}")).alias(c) for c in ("end_ts", "bid_close", "ask_close")], volume.alias("volume"), F.when(good, age / 3600.0).alias("quote_age_h"))


def coverage(markets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, and how many markets, and which share, have a forecast and a quote."""
    out = markets.groupBy(*keys).agg(F.count("*").alias("n"), F.count("txn").alias("n_forecast"), F.count("ask_close").alias("n_quote"))
    return out.withColumn("forecast_share", F.col("n_forecast") / F.col("n")).withColumn("quote_share", F.col("n_quote") / F.col("n"))


def calendar_returns(bars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date, r and rf on every calendar day of bars (keys, date, close, annual): no return on days without a bar, where the last yearly rate still holds."""
    w = Window.partitionBy(*keys).orderBy("date")
    known = bars.withColumn("r", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))).withColumn("_gap", F.coalesce(F.lead("date").over(w), F.date_add("date", 1)))
    days = known.withColumn("_day", F.explode(F.sequence(F.col("date"), F.date_sub("_gap", 1))))
    return days.select(*keys, F.col("_day").alias("date"), F.when(F.col("_day") == F.col("date"), F.col("r")).otherwise(0.0).alias("r"), (F.col("annual") / 365.0).alias("rf"))


def rolling_bias(rows: DataFrame, series: str = "series", window: int = 60, least: int = 20) -> DataFrame:
    """rows with the mean forecast error of earlier settled events; the evening decision knows one day less than the morning's."""
    events = rows.groupBy(series, "dt_name", "D").agg(F.min(F.struct("ticker", "actual", "txn")).alias("s"))
    events = events.withColumn("res", F.col("s.actual") - F.col("s.txn"))
    w = Window.partitionBy(series, "dt_name").orderBy("D")
    bias = F.when(F.col("dt_name") == "DT1", rolling_mean("res", window, w, least, 2)).otherwise(rolling_mean("res", window, w, least, 1))
    return rows.join(events.select(series, "dt_name", "D", bias.alias("bias")), [series, "dt_name", "D"], "left")


def with_probability(rows: DataFrame, a: float, c: float, clip: bool = True) -> DataFrame:
    """rows with p, the probability of yes for whole degrees from a normal forecast."""
    sigma = F.sqrt(F.lit(a * a) + F.pow(F.lit(c) * F.coalesce("xnd", F.lit(2.0)), F.lit(2.0)))
    mu = F.col("txn") + F.col("bias")
    df = rows.withColumn("_lo", (F.col("floor_strike") - 0.5 - mu) / sigma).withColumn("_hi", (F.col("cap_strike") + 0.5 - mu) / sigma)
    df = df.withColumn("_gt", (F.col("floor_strike") + 0.5 - mu) / sigma).withColumn("_lt", (F.col("cap_strike") - 0.5 - mu) / sigma)
    p = F.when(F.col("strike_type") == "greater", 1.0 - cdf("_gt")).when(F.col("strike_type") == "less", cdf("_lt")).otherwise(cdf("_hi") - cdf("_lo"))
    df = df.withColumn("p", p)
    if clip:
        df = df.withColumn("p", F.when(F.col("p").isNotNull(), F.least(F.greatest("p", F.lit(1e-4)), F.lit(1 - 1e-4))))
    return df.drop("_lo", "_hi", "_gt", "_lt")


def fit_sigma(rows: DataFrame, dev_end: str) -> dict[str, float]:
    """The spread sqrt(a^2 + (c xnd)^2) of most likelihood on development events.

    The likelihood needs how often each (error, xnd) occurs only; these counts, in steps of a hundredth, are what
    the driver gets, and their number depends on the ranges of both, not on the number of events.
    """
    e = F.round(F.col("actual") - F.col("txn") - F.col("bias"), 2)
    events = rows.where((F.col("D") <= F.lit(dev_end).cast("date")) & e.isNotNull())
    counts = events.groupBy(e.alias("e"), F.round(F.coalesce("xnd", F.lit(2.0)), 2).alias("x")).agg(F.count("*").alias("n")).orderBy("e", "x").toPandas()
    if not len(counts):
        return {"a": float("nan"), "c": float("nan"), "n": 0}
    err, xnd, n = (counts[k].to_numpy(float) for k in ("e", "x", "n"))
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))

    def loss(p: np.ndarray) -> float:
        s = np.sqrt((abs(p[0]) + 1e-3) ** 2 + (abs(p[1]) * xnd) ** 2)
        return float(-(n * np.log(np.clip(phi((err + 0.5) / s) - phi((err - 0.5) / s), 1e-12, None))).sum())

    best = nelder_mead(loss, [1.5, 0.5])
    return {"a": abs(float(best[0])) + 1e-3, "c": abs(float(best[1])), "n": int(n.sum())}


@dataclass(frozen=True)
class Config:
    """A way to trade: by edge over fees (theta), or favourites within ``longshot`` of certainty; cost scales fees and slippage."""

    variant: str
    dt_name: str | None
    theta: float
    longshot: float | None = None
    frac: float = 0.01
    top_k: int = 8
    cost: float = 1.0
    slip: float = 0.01


def simulate_configs(rows: DataFrame, configs: list[Config], bankroll: float = 5000.0, vol_frac: float = 0.10) -> DataFrame:
    """Trades of each configuration (variant) on rows (ticker, dt_name, D, p, bid_close, ask_close, volume, y), in one plan.

    Configurations are few: a row is exploded into those for its decision time. Yes fills at the ask and no at one less the
    bid, each with slippage. The better edge is taken, or with a longshot whichever side is a favourite; per day (and
    decision time) the top_k edges stay, or all where it is 0.
    """
    number = lambda x, kind="double": F.lit(x).cast(kind)
    given = F.array(*[F.struct(number(c.variant, "string").alias("variant"), number(c.dt_name, "string").alias("of"), number(c.theta).alias("theta"), number(c.longshot).alias("longshot"), number(c.frac).alias("frac"), number(c.top_k, "int").alias("top_k"), number(c.cost).alias("cost"), number(c.slip * c.cost).alias("slip")) for c in configs])
    df = rows.withColumn("_c", F.explode(F.filter(given, lambda c: c["of"].isNull() | (c["of"] == F.col("dt_name"))))).withColumn("variant", F.col("_c.variant"))
    ask, bid, slip, cost, longshot = F.col("ask_close"), F.col("bid_close"), F.col("_c.slip"), F.col("_c.cost"), F.col("_c.longshot")
    ok = ask.isNotNull() & bid.isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0)
    df = df.withColumn("_y", F.when(ok & (ask < 0.99) & (ask > 0), F.least(ask + slip, F.lit(0.99)))).withColumn("_n", F.when(ok & (bid > 0.01) & (bid < 1), F.least(1.0 - bid + slip, F.lit(0.99))))
    fee = lambda p: 0.07 * cost * p * (1 - p)
    y, n = F.col("_y"), F.col("_n")
    df = df.withColumn("_ey", F.col("p") - y - fee(y)).withColumn("_en", (1 - F.col("p")) - n - fee(n))
    better, by_edge = F.coalesce("_ey", F.lit(-9.0)) >= F.coalesce("_en", F.lit(-9.0)), longshot.isNull()
    yes, no = F.coalesce(y >= 1 - longshot, F.lit(False)), F.coalesce(n >= 1 - longshot, F.lit(False))
    df = df.withColumn("side_yes", F.when(by_edge, better).otherwise(yes)).withColumn("edge", F.when(by_edge, F.when(better, F.col("_ey")).otherwise(F.col("_en"))).otherwise(1.0))
    df = df.where(F.when(by_edge, F.col("edge") >= F.col("_c.theta")).otherwise(yes | no)).withColumn("price", F.when(F.col("side_yes"), y).otherwise(n))
    if any(c.top_k for c in configs):
        w = Window.partitionBy("variant", "dt_name", "D").orderBy(F.col("edge").desc(), "ticker")
        df = df.withColumn("_rank", F.row_number().over(w)).where((F.col("_c.top_k") == 0) | (F.col("_rank") <= F.col("_c.top_k"))).drop("_rank")
    size = F.greatest(F.floor(F.col("_c.frac") * bankroll / F.col("price")), F.lit(1))
    size = F.least(size, F.greatest(F.lit(1), F.floor(F.lit(vol_frac) * F.coalesce("volume", F.lit(0.0)))))
    df = df.withColumn("n", size.cast("long")).withColumn("win", F.when(F.col("side_yes"), F.col("y") == 1).otherwise(F.col("y") == 0))
    df = df.withColumn("fee", ceil_cent(0.07 * F.col("n") * F.col("price") * (1.0 - F.col("price"))) * cost)
    return df.withColumn("pnl", F.col("n") * (F.when(F.col("win"), 1.0).otherwise(0.0) - F.col("price")) - F.col("fee")).drop("_y", "_n", "_ey", "_en", "_c")


def simulate_trades(rows: DataFrame, theta: float, slip: float = 0.01, fee_mult: float = 1.0, bankroll: float = 5000.0, frac: float = 0.01, top_k: int = 8, vol_frac: float = 0.10, longshot: float | None = None) -> DataFrame:
    """Trades of one configuration at all decision times; fee_mult scales fees alone."""
    one = Config("one", None, theta, longshot, frac, 0 if longshot is not None else top_k, fee_mult, slip / fee_mult)
    return simulate_configs(rows, [one], bankroll, vol_frac).drop("variant")


def daily_returns(trades: DataFrame, keys: list[str], days: DataFrame, bankroll: float = 5000.0) -> DataFrame:
    """keys, date, r on every date of days (keys, date); a day without trades returns 0."""
    each = trades.groupBy(*keys, F.col("D").alias("date")).agg((F.sum("pnl") / bankroll).alias("_r"))
    return days.join(each, [*keys, "date"], "left").select(*keys, "date", F.coalesce("_r", F.lit(0.0)).alias("r"))
