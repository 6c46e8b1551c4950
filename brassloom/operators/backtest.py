"""Portfolio simulation of target weights over a dense panel, for any number of variants in one plan.

Input rows: variant, date, asset, open, close, adj_close, weight (decided at the close of date) and optionally rf.
Windows by (variant, asset) give what is carried from bar to bar, windows by (variant, date) what the portfolio
as a whole does on a bar. Work is spread over variants and assets; a series itself is short.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brassloom.operators.metrics import summarize
from brassloom.operators.windows import run_ids
from brassloom.plans.panel import Splits, adj_open

EPS = 1e-9
MODES = ("next_open", "next_close", "same_close")


@dataclass(frozen=True)
class Costs:
    """Frictions per side; ``multiplier`` scales all of them."""

    fee_bps: float = 0.0
    half_spread_bps: float = 1.0
    half_spread_by_asset: dict[str, float] = field(default_factory=dict)
    slippage_bps: float = 1.0
    commission_usd: float = 0.0
    sec_per_million: float = 27.80
    taf_per_share: float = 0.000166
    borrow_bps: float = 50.0
    margin_rate: float = 0.06
    cash_haircut: float = 0.0025
    multiplier: float = 1.0

    def scaled(self, k: float) -> Costs:
        return replace(self, multiplier=self.multiplier * k)

    def of(self, name: str) -> Column:
        """A friction as the plan sees it, beside the multiplier that scales it."""
        return F.lit(float(getattr(self, name)))

    def half_spread(self, asset: str = "asset") -> Column:
        out = self.of("half_spread_bps")
        for a, v in self.half_spread_by_asset.items():
            out = F.when(F.col(asset) == a, F.lit(v)).otherwise(out)
        return out


class CostColumns(Costs):
    """Frictions that differ by row: columns ``cost_`` and a friction's name."""

    def of(self, name: str) -> Column:
        return F.col(f"cost_{name}")


#: The frictions that are one number.
FRICTIONS = tuple(f for f in Costs.__dataclass_fields__ if f != "half_spread_by_asset")


def _a() -> Window:
    return Window.partitionBy("variant", "asset").orderBy("date")


def _d() -> Window:
    return Window.partitionBy("variant", "date")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


@dataclass(frozen=True)
class Rules:
    """What a simulation refuses: shorts unless allowed, more gross exposure than max_gross (both may be columns), rows after validation unless the holdout is open."""

    max_gross: float | Column | None = 1.0
    allow_short: bool | Column = False
    splits: Splits | None = Splits()
    opened: bool = False


def _too_much(gross: Column, rules: Rules) -> tuple[Column, str]:
    said = "the limit" if isinstance(rules.max_gross, Column) else rules.max_gross
    return gross > F.lit(rules.max_gross) + 1e-6, f"gross exposure is over {said}"


def _ready(rows: DataFrame, rules: Rules, opens: bool, gross: bool = True) -> DataFrame:
    """With weight 0 where there is no price, and rf. Rows that break a rule raise as they come along; no job of their own looks for them."""
    if "rf" not in rows.columns:
        rows = rows.withColumn("rf", F.lit(0.0))
    w = F.col("w")
    bad = [(F.isnan(w) | (F.abs(w) == float("inf")), "weights must be finite")]
    if rules.allow_short is not True:
        bad.append((~F.lit(rules.allow_short) & (w < -EPS), "short weights are not allowed"))
    if gross and rules.max_gross is not None:
        bad.append(_too_much(F.sum(F.abs(w)).over(_d()), rules))
    if rules.splits is not None and not rules.opened:
        bad.append((F.col("date") > F.lit(rules.splits.val_end).cast("date"), f"the holdout after {rules.splits.val_end} is not open"))
    if opens:
        bad.append((F.col("adj_close").isNotNull() & adj_open().isNull(), "an open is missing where a close exists"))
    checked = w
    for condition, message in reversed(bad):
        checked = F.when(condition, F.raise_error(F.lit(message)).cast("double")).otherwise(checked)
    rows = rows.withColumn("rf", _zero(F.col("rf"))).withColumn("w", F.when(F.col("adj_close").isNotNull(), _zero(F.col("weight"))).otherwise(0.0))
    return rows.withColumn("w", checked)


def simulate(rows: DataFrame, mode: str = "next_open", costs: Costs = Costs(), account: float | None = 5000.0, rules: Rules = Rules(), wide: bool = False) -> DataFrame:
    """One row per (variant, date, asset): position, its parts of the return, trade and costs. Rows that break the rules raise.

    wide is for assets that grow with the tables, under few variants: what the portfolio does on a bar is then summed by a partial
    aggregate of (variant, date) and broadcast, a row for each, so that rows stay with their asset. They are made twice for it.
    All assets of a variant must have all of its dates, as in a dense panel: the days between bars are taken from those.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    of, k = costs.of, costs.of("multiplier")
    c, last = F.col("adj_close"), F.lag("adj_close").over(_a())
    df = _ready(rows, rules, mode == "next_open", not wide)
    df = df if wide else _with_days(df, "variant", "asset")
    if mode == "next_open":
        o = adj_open()
        df = df.withColumn("pos", _zero(F.lag("w").over(_a()))).withColumn("prev", _zero(F.lag("w", 2).over(_a())))
        df = df.withColumn("r_pre", _zero(F.try_divide(o, last) - 1)).withColumn("r_new", _zero(F.try_divide(c, o) - 1))
        held = (F.col("prev") + F.col("pos")) / 2.0
    else:
        df = df.withColumn("pos", F.col("w") if mode == "same_close" else _zero(F.lag("w").over(_a())))
        df = df.withColumn("prev", _zero(F.lag("w").over(_a()) if mode == "same_close" else F.lag("w", 2).over(_a())))
        df = df.withColumn("r_pre", _zero(F.try_divide(c, last) - 1)).withColumn("r_new", F.lit(0.0))
        held = F.col("prev")
    plus = lambda x: F.greatest(x, F.lit(0.0))
    df = df.withColumn("part_prev", F.col("prev") * F.col("r_pre")).withColumn("held", held)
    totals = {"before": F.sum("part_prev"), "long_prev": F.sum(plus(F.col("prev"))), "long_held": F.sum(plus(F.col("held")))}
    df = df.join(F.broadcast(_with_days(_totals(df, totals, rules), "variant")), ["variant", "date"]) if wide else df.withColumns({c: x.over(_d()) for c, x in totals.items()})
    df = df.withColumn("part_new", F.col("pos") * F.col("r_new") * (1 + F.col("before")))
    r_p = F.col("before") + plus(1 - F.col("long_prev")) * F.col("rf")
    df = df.withColumn("trade", F.col("pos") - F.col("prev") * (1 + F.col("r_pre")) / F.greatest(1 + r_p, F.lit(1e-6)))
    df = df.withColumn("turnover", F.when(F.abs("trade") > EPS, F.abs("trade")).otherwise(0.0))
    sells = F.when(F.col("turnover") > 0, plus(-F.col("trade"))).otherwise(0.0)
    raw = F.when(F.col("close") != 0, F.col("close"))
    year = F.col("days") / 365.0
    df = df.withColumn("trading", F.col("turnover") * (costs.half_spread() + of("slippage_bps") + of("fee_bps")) * (k / 1e4))
    df = df.withColumn("regulatory", sells * (of("sec_per_million") / 1e6 + _zero(of("taf_per_share") / raw)) * k)
    df = df.withColumn("commission", F.when(F.col("turnover") > 0, of("commission_usd") * k / account if account else F.lit(0.0)).otherwise(0.0))
    df = df.withColumn("borrow", plus(-F.col("held")) * year * (of("borrow_bps") / 1e4 * k))
    df = df.withColumn("financing_all", plus(F.col("long_held") - 1) * (of("margin_rate") * k) * year)
    df = df.withColumn("cash", plus(1 - F.col("long_held")) * (F.col("rf") - of("cash_haircut") * year))
    share = _zero(F.try_divide(plus(F.col("held")), F.col("long_held")))
    return df.withColumn("cost", F.col("trading") + F.col("regulatory") + F.col("commission") + F.col("borrow") + share * F.col("financing_all"))


def _with_days(df: DataFrame, *keys: str) -> DataFrame:
    """df with the days since a key's date before, 1 at least; its first date has the median."""
    days = df.withColumn("days", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))))
    first = F.coalesce(F.percentile("days", 0.5).over(Window.partitionBy(*keys)), F.lit(1.0))
    return days.withColumn("days", F.greatest(F.coalesce(F.col("days").cast("double"), first), F.lit(1.0)))


def _totals(df: DataFrame, totals: dict[str, Column], rules: Rules) -> DataFrame:
    """(variant, date) and totals; a date whose gross exposure is over the limit raises."""
    if rules.max_gross is None:
        return df.groupBy("variant", "date").agg(*[x.alias(c) for c, x in totals.items()])
    out = df.withColumn("_limit", F.lit(rules.max_gross)).groupBy("variant", "date").agg(F.sum(F.abs("w")).alias("_gross"), F.min("_limit").alias("_limit"), *[x.alias(c) for c, x in totals.items()])
    over, message = _too_much(F.col("_gross"), replace(rules, max_gross=F.col("_limit")) if isinstance(rules.max_gross, Column) else rules)
    return out.withColumn("before", F.when(over, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("before"))).drop("_gross", "_limit")


COMPONENTS = ("trading", "regulatory", "commission", "borrow")


def periods(sim: DataFrame) -> DataFrame:
    """One row per (variant, date): gross and net return, turnover, exposure and costs by component."""
    one = F.any_value("cash"), F.any_value("financing_all")
    out = sim.groupBy("variant", "date").agg(
        (F.sum(F.col("part_prev") + F.col("part_new")) + one[0]).alias("gross"),
        *[F.sum(c).alias(c) for c in COMPONENTS],
        one[1].alias("financing"),
        F.sum("turnover").alias("turnover"),
        F.sum(F.abs("pos")).alias("exposure"),
        F.any_value("rf").alias("rf"),
    )
    costs = sum((F.col(c) for c in ("regulatory", "commission", "borrow", "financing")), F.col("trading"))
    return out.withColumn("costs", costs).withColumn("net", F.col("gross") - F.col("costs"))


def episodes(sim: DataFrame) -> DataFrame:
    """One row per position episode: a maximal run of positions of one sign, per variant and asset.

    A bar's carried part belongs to the run before, its new part to the run it starts, costs to the new run or,
    on the way out, to the one before. These sums and what is known of the run's own bars are one exploded aggregate.
    """
    sign = F.when(F.abs("pos") < EPS, 0).otherwise(F.signum("pos")).cast("int")
    df = sim.withColumn("sign", sign).withColumn("run", run_ids(F.col("sign"), _a()))
    df = df.withColumn("run_before", F.coalesce(F.lag("run").over(_a()), F.lit(0))).withColumn("next_date", F.lead("date").over(_a()))
    key = F.when(F.col("sign") != 0, F.col("run")).otherwise(F.col("run_before"))
    part = lambda of, v, own=F.lit(False): F.struct(of.alias("of"), v.alias("v"), own.alias("own"))
    parts = F.array(part(F.col("run_before"), F.col("part_prev")), part(F.col("run"), F.col("part_new"), F.col("sign") != 0), part(key, -F.col("cost")))
    own = lambda c: F.when(F.col("p.own"), c)
    each = df.select("variant", "asset", "date", "next_date", "sign", "pos", F.explode(parts).alias("p"))
    out = each.groupBy("variant", "asset", F.col("p.of").alias("run")).agg(
        F.sum("p.v").alias("pnl"),
        F.max(own(F.col("sign"))).alias("sign"),
        F.min(own(F.col("date"))).alias("entry"),
        F.max(own(F.struct("date", "next_date"))).alias("end"),
        F.count(own(F.lit(1))).alias("periods"),
        F.avg(own(F.abs("pos"))).alias("avg_alloc"),
    )
    out = out.where("sign IS NOT NULL").withColumn("last", F.col("end.date")).withColumn("after", F.col("end.next_date"))
    return out.select("variant", "asset", F.when(F.col("sign") > 0, "long").otherwise("short").alias("side"), "entry", F.coalesce("after", "last").alias("exit"), "periods", "avg_alloc", "pnl", F.try_divide("pnl", "avg_alloc").alias("ret_on_alloc"), F.col("after").isNull().alias("still_open"))


def sliced(frame: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Periods, or by ``entry`` trades, from start to end, both inclusive; a trade belongs where it was entered."""
    if start:
        frame = frame.where(F.col(date) >= F.lit(start).cast("date"))
    return frame.where(F.col(date) <= F.lit(end).cast("date")) if end else frame


def summary(per: DataFrame, trades: DataFrame, splits: Splits, ppy: float) -> DataFrame:
    """(variant, split) with all metrics of the net returns, trades entered, yearly turnover and cost, and mean exposure."""
    each = splits.explode(per)
    out = summarize(each.withColumn("r", F.col("net")), ["variant", "split"], ppy)
    more = each.groupBy("variant", "split").agg((F.avg("turnover") * ppy).alias("ann_turnover"), (F.avg("costs") * ppy).alias("ann_cost_drag"), F.avg("exposure").alias("exposure"))
    entered = splits.explode(trades, date="entry").groupBy("variant", "split").agg(F.count("*").alias("n_trades"))
    return out.join(more, ["variant", "split"]).join(entered, ["variant", "split"], "left").fillna(0, ["n_trades"])


def session_only(rows: DataFrame, session: str, costs: Costs = Costs(), rules: Rules = Rules()) -> DataFrame:
    """(variant, date, asset) rows of holding one part of each day only and paying for both legs every day."""
    if session not in ("overnight", "intraday"):
        raise ValueError("session must be overnight or intraday")
    of, k, o = costs.of, costs.of("multiplier"), adj_open()
    last = F.lag("adj_close").over(_a())
    part = F.try_divide(o, last) - 1 if session == "overnight" else F.try_divide(F.col("adj_close"), o) - 1
    df = _ready(rows, rules, False).withColumn("pos", _zero(F.lag("w").over(_a()))).withColumn("part", F.col("pos") * _zero(part))
    df = df.withColumn("days", F.greatest(F.coalesce(F.datediff("date", F.lag("date").over(_a())), F.lit(1)), F.lit(1)).cast("double"))
    raw = F.when(F.col("close") != 0, F.col("close"))
    df = df.withColumn("trading", F.abs("pos") * 2.0 * (costs.half_spread() + of("slippage_bps") + of("fee_bps")) * (k / 1e4))
    df = df.withColumn("regulatory", F.abs("pos") * (of("sec_per_million") / 1e6 + _zero(of("taf_per_share") / raw)) * k)
    free = F.greatest(1 - F.sum(F.greatest("pos", F.lit(0.0))).over(_d()), F.lit(0.0))
    return df.withColumn("cash", free * (F.col("rf") - of("cash_haircut") * F.col("days") / 365.0))


def session_periods(sim: DataFrame) -> DataFrame:
    out = sim.groupBy("variant", "date").agg((F.sum("part") + F.any_value("cash")).alias("gross"), F.sum("trading").alias("trading"), F.sum("regulatory").alias("regulatory"), (2 * F.sum(F.abs("pos"))).alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("trading") - F.col("regulatory"))


def session_trades(sim: DataFrame) -> DataFrame:
    pnl = F.col("part") - F.col("trading") - F.col("regulatory")
    return sim.where(F.abs("pos") > EPS).select("variant", "asset", F.when(F.col("pos") > 0, "long").otherwise("short").alias("side"), F.col("date").alias("entry"), F.col("date").alias("exit"), F.lit(1).cast("long").alias("periods"), F.abs("pos").alias("avg_alloc"), pnl.alias("pnl"), (pnl / F.abs("pos")).alias("ret_on_alloc"), F.lit(False).alias("still_open"))


def look_ahead(rows_for, panel: DataFrame, cuts: DataFrame, atol: float = 1e-9) -> DataFrame:
    """Rows where a builder's weights change when later bars are cut off; a sound builder gives none.

    rows_for(panel) builds (date, asset, weight) and takes a panel whose assets are told apart by ``asset``
    alone; all cuts (date) run in one plan, each as assets of its own.
    """
    full = rows_for(panel).select("date", "asset", F.col("weight").alias("full"))
    cut = panel.crossJoin(F.broadcast(cuts.withColumnRenamed("date", "cut"))).where("date <= cut")
    part = rows_for(cut.withColumn("asset", F.concat_ws("\x1f", "asset", F.col("cut").cast("string"))))
    part = part.select("date", F.split("asset", "\x1f")[0].alias("asset"), F.split("asset", "\x1f")[1].alias("cut"), F.col("weight").alias("part"))
    same = F.coalesce(F.abs(F.col("full") - F.col("part")) <= atol, F.col("full").isNull() & F.col("part").isNull())
    return part.join(full, ["date", "asset"], "left").where(~same)


