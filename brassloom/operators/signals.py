"""Signal builders: a dense panel to rows with a target weight decided at each close from what was known then.

Every builder takes a panel (date, asset, prices) and returns it with ``weight``. Look-backs are row frames per
asset, selections windows per date; monthly decisions are carried to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brassloom.operators.folds import hysteresis, stream, three_state
from brassloom.operators.windows import cross_rank, ffill, first_of_month, pct_change, rolling_mean, rolling_std, session_of_month, shift
from brassloom.plans.panel import by_date

PX = "adj_close"


def flag(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)


def monthly_hold(rows: DataFrame) -> DataFrame:
    """Keep a month's first decision until the next month; a decision that is NULL leaves the last one."""
    held = F.when(first_of_month(), F.col("weight"))
    return rows.withColumn("_held", held).withColumn("weight", F.coalesce(ffill("_held"), F.lit(0.0))).drop("_held")


def price_above_sma(panel: DataFrame, n: int) -> DataFrame:
    return panel.withColumn("weight", flag(F.col(PX) > rolling_mean(PX, n)))


def momentum_sign(panel: DataFrame, n: int) -> DataFrame:
    return panel.withColumn("weight", flag(pct_change(PX, n) > 0))


def sma_cross(panel: DataFrame, fast: int, slow: int) -> DataFrame:
    return panel.withColumn("weight", flag(rolling_mean(PX, fast) > rolling_mean(PX, slow)))


def equal_slot_trend(panel: DataFrame, n: int, slots: int, monthly: bool = True) -> DataFrame:
    rows = price_above_sma(panel, n).withColumn("weight", F.col("weight") / slots)
    return monthly_hold(rows) if monthly else rows


def xs_momentum(panel: DataFrame, lookback: int, skip: int, top_k: int, abs_filter: bool, monthly: bool = True) -> DataFrame:
    """The top_k assets of each date by momentum, each with 1/top_k; fewer leave cash."""
    rows = panel.withColumn("_mom", F.try_divide(shift(PX, skip), shift(PX, lookback)) - 1).withColumn("_rank", cross_rank("_mom"))
    chosen = (F.col("_rank") <= top_k) & (F.col("_mom") > 0) if abs_filter else F.col("_rank") <= top_k
    rows = rows.withColumn("weight", flag(chosen) / top_k).drop("_mom", "_rank")
    return monthly_hold(rows) if monthly else rows


def rsi(panel: DataFrame, n: int) -> DataFrame:
    """panel with rsi, whose averages are recursive and need n moves."""
    moves = panel.withColumn("_d", F.col(PX) - shift(PX, 1))

    def step(s: tuple, d: float | None) -> tuple[tuple, float | None]:
        up, down, seen = s
        if d is not None:
            mix = lambda old, new: new if old is None else 1.0 / n * new + (1.0 - 1.0 / n) * old
            up, down, seen = mix(up, max(d, 0.0)), mix(down, max(-d, 0.0)), seen + 1
        ready = seen >= n and down
        return (up, down, seen), 100.0 - 100.0 / (1.0 + up / down) if ready else None

    kept = [c for c in panel.columns if c not in ("asset", "date")]
    out = stream(moves, ["asset"], "date", ["_d", *kept], (None, None, 0), lambda s, d, *_: step(s, d))
    return out.drop("_d").withColumnRenamed("out", "rsi")


def rsi_reversal(panel: DataFrame, n: int, entry: float, exit_sma: int, trend_sma: int) -> DataFrame:
    """In after a low RSI above the trend, out after a close above the short average."""
    rows = rsi(panel, n)
    rows = rows.withColumn("_in", (F.col("rsi") < entry) & (F.col(PX) > rolling_mean(PX, trend_sma))).withColumn("_out", F.col(PX) > rolling_mean(PX, exit_sma))
    return hysteresis(rows, ["asset"], "date", "_in", "_out").withColumnRenamed("out", "weight").drop("_in", "_out", "rsi")


def ibs_reversal(panel: DataFrame, below: float, trend_sma: int | None = None) -> DataFrame:
    """Long after closes in the lowest part of a bar's range; a bar without range gives no signal."""
    on = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")) < below
    return panel.withColumn("weight", flag(on & (F.col(PX) > rolling_mean(PX, trend_sma)) if trend_sma else on))


def _vol_weight(target: float, n: int, ppy: float) -> Column:
    vol = F.col("_vol") * F.sqrt(F.lit(float(ppy)))
    return F.when(F.col("_vol").isNull(), 0.0).when(F.col("_vol") == 0, 1.0).otherwise(F.least(F.try_divide(F.lit(target), vol), F.lit(1.0)))


def _with_vol(panel: DataFrame, n: int) -> DataFrame:
    return panel.withColumn("_r", pct_change(PX)).withColumn("_vol", rolling_std("_r", n))


def vol_target(panel: DataFrame, target: float, n: int, ppy: float, monthly: bool = True) -> DataFrame:
    """Weight target over realised volatility, 1 at most; no volatility at all gives 1."""
    rows = _with_vol(panel, n).withColumn("weight", _vol_weight(target, n, ppy)).drop("_r", "_vol")
    return monthly_hold(rows) if monthly else rows


def trend_and_vol(panel: DataFrame, n: int, target: float, vol_n: int, ppy: float, monthly: bool = True) -> DataFrame:
    rows = price_above_sma(vol_target(panel, target, vol_n, ppy, monthly).withColumnRenamed("weight", "_v"), n)
    return rows.withColumn("weight", F.col("weight") * F.col("_v")).drop("_v")


def term_structure(panel: DataFrame, front: str, back: str, below: float, cap: float = 1.0, front_max: float | None = None) -> DataFrame:
    """Hold while the ratio of two external series (columns front and back of panel, carried forward) is below a bound."""
    rows = panel.withColumn("_f", ffill(front)).withColumn("_b", ffill(back))
    on = F.try_divide("_f", "_b") < below
    if front_max is not None:
        on = on & (F.col("_f") < front_max)
    return rows.withColumn("weight", cap * flag(on)).drop("_f", "_b")


def turn_of_month(panel: DataFrame, days_after: int, calendar: DataFrame | None = None) -> DataFrame:
    """Hold on a month's last session and its first days_after - 1, on the panel's calendar or on a given one (date); dates that it lacks are no sessions."""
    if calendar is not None:
        n, left = session_of_month()
        days = calendar.select("date").distinct().select("date", n.alias("_n"), left.alias("_left"))
        return panel.join(days, "date", "left").withColumn("weight", flag((F.col("_left") == 0) | (F.col("_n") <= days_after - 1))).drop("_n", "_left")
    n, left = session_of_month("asset")
    return panel.withColumn("_n", n).withColumn("_left", left).withColumn("weight", flag((F.col("_left") == 0) | (F.col("_n") <= days_after - 1))).drop("_n", "_left")


def day_of_week(panel: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """Hold on given weekdays, Monday is 0."""
    return panel.withColumn("weight", flag(F.weekday("date").isin(*days)))


def always_long(panel: DataFrame) -> DataFrame:
    return panel.withColumn("weight", F.lit(1.0))


def inverse_vol_slots(panel: DataFrame, n: int, vol_n: int, monthly: bool = True) -> DataFrame:
    """Shares by inverse volatility among all assets, held where the trend is up; an asset without volatility has none."""
    rows = _with_vol(panel, vol_n).withColumn("_iv", F.when(F.col("_vol") > 0, F.try_divide(F.lit(1.0), F.col("_vol"))))
    rows = price_above_sma(rows, n).withColumn("_sum", F.sum("_iv").over(by_date()))
    rows = rows.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide("_iv", "_sum"), F.lit(0.0))).drop("_r", "_vol", "_iv", "_sum")
    return monthly_hold(rows) if monthly else rows


def pairs_zscore(panel: DataFrame, a: str, b: str, n: int, entry: float, leave: float = 0.5) -> DataFrame:
    """Half of equity long and half short on the log spread's z-score."""
    wide = panel.where(F.col("asset").isin(a, b)).groupBy("date").pivot("asset", [a, b]).agg(F.first(PX)).toDF("date", "_a", "_b")
    wide = wide.withColumn("pair", F.lit(f"{a}/{b}")).withColumn("_s", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.ln("_a") - F.ln("_b")))
    w = Window.partitionBy("pair").orderBy("date")
    wide = wide.withColumn("z", F.try_divide(F.col("_s") - rolling_mean("_s", n, w), rolling_std("_s", n, w)))
    state = three_state(wide, ["pair"], "date", "z", entry, leave)
    return state.select("date", F.explode(F.create_map(F.lit(a), 0.5 * F.col("out"), F.lit(b), -0.5 * F.col("out"))).alias("asset", "weight"))


def scaled(rows: DataFrame, k: float) -> DataFrame:
    return rows.withColumn("weight", F.col("weight") * k)


