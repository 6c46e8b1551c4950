"""Grids over differing universes in one plan: what a variant trades, from when, at what costs and under which rules is a row of a table.

A desk is a universe with its calendar, first date, costs, rules and trials. Builders run on a desk's own assets, in
groups that share their windows; all desks' weights are one table of rows, which the table of variants is joined to. The
simulation takes costs and rules from these columns, so desks of any kind share one simulation, and the
scoring starts at each variant's own date.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.operators import backtest as B
from brassloom.operators import metrics
from brassloom.operators.runner import Trial, weights
from brassloom.operators.windows import pct_change
from brassloom.plans.panel import Splits, stored, subset


@dataclass(frozen=True)
class Desk:
    """A universe and the trials on it.

    calendar names the panel; external gives columns that are closes (or another field) of assets which the desk doesn't
    trade, by date. session: hold that part of each day only. bench is the asset whose own returns the trials are compared with.
    """

    name: str
    assets: tuple[str, ...]
    trials: tuple[Trial, ...]
    calendar: str
    start: str
    ppy: float
    bench: str
    costs: B.Costs = B.Costs()
    allow_short: bool = False
    max_gross: float = 1.0
    session: str | None = None
    rf: float = 0.0
    external: dict[str, tuple[str, str]] = field(default_factory=dict)


_FIELDS = "variant string, family string, desk string, calendar string, start string, ppy double, bench string, allow_short boolean, max_gross double, session string, rf double"


def variant_table(spark, desks: list[Desk]) -> DataFrame:
    """A row for each trial of each desk."""
    rows = [(t.variant, t.family, d.name, d.calendar, d.start, float(d.ppy), d.bench, d.allow_short, float(d.max_gross), d.session, float(d.rf), *(float(getattr(d.costs, c)) for c in B.FRICTIONS)) for d in desks for t in d.trials]
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError(f"variants occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    return spark.createDataFrame(rows, ", ".join([_FIELDS, *(f"cost_{c} double" for c in B.FRICTIONS)])).withColumn("start", F.col("start").cast("date"))


def _with_external(panel: DataFrame, whole: DataFrame, external: dict[str, tuple[str, str]]) -> DataFrame:
    for name, (asset, value) in external.items():
        panel = panel.join(whole.where(F.col("asset") == asset).select("date", F.col(value).alias(name)), "date", "left")
    return panel


def desk_rows(panels: dict[str, DataFrame], desks: list[Desk]) -> DataFrame:
    """(variant, date, asset, prices, weight) of all desks."""

    def one(d: Desk) -> DataFrame:
        whole = panels[d.calendar]
        return weights(_with_external(subset(whole, list(d.assets)), whole, d.external), list(d.trials)).select(*whole.columns, "variant", "weight")

    return reduce(DataFrame.unionByName, map(one, desks))


def _results(rows: DataFrame, sessions: set[str], mode: str, account: float, rules: B.Rules) -> tuple[DataFrame, DataFrame]:
    """Periods (variant, date, net, turnover, costs, exposure, rf) and trades (variant, entry) of all rows; those with a session pay for both legs of each day."""
    columns = ["variant", "date", "net", "turnover", "costs", "exposure", "rf"]
    costs = B.CostColumns()
    sim = B.simulate(rows.where("session IS NULL"), mode, costs, account, rules)
    per, trades = B.periods(sim).select(*columns), B.episodes(sim).select("variant", "entry")
    for s in sorted(sessions):
        part = B.session_only(rows.where(F.col("session") == s), s, costs, rules)
        legs = B.session_periods(part).withColumn("costs", F.col("trading") + F.col("regulatory")).withColumn("exposure", F.col("turnover") / 2)
        rf = part.groupBy("variant", "date").agg(F.any_value("rf").alias("rf"))
        per = per.unionByName(legs.join(rf, ["variant", "date"]).select(*columns))
        trades = trades.unionByName(B.session_trades(part).select("variant", "entry"))
    return per, trades


def score_desks(panels: dict[str, DataFrame], desks: list[Desk], splits: Splits, mode: str = "next_open", account: float = 5000.0, opened: bool = False) -> DataFrame:
    """(desk, family, variant, split) with a result's summary from the desk's first date on, and bench_sharpe."""
    spark = next(iter(panels.values())).sparkSession
    table = variant_table(spark, desks)
    known = F.broadcast(table)  # a row for each trial
    rules = B.Rules(max_gross=F.col("max_gross"), allow_short=F.col("allow_short"), splits=splits, opened=opened)
    rows = stored(desk_rows(panels, desks).join(known, "variant"))
    per, trades = _results(rows, {d.session for d in desks if d.session}, mode, account, rules)
    begun = lambda df, date: df.join(F.broadcast(table.select("variant", "start", "ppy")), "variant").where(F.col(date) >= F.col("start")).drop("start")
    per, trades = stored(begun(per, "date")), stored(begun(trades, "entry"))
    rates = sorted({float(d.ppy) for d in desks})
    each = [B.summary(per.where(F.col("ppy") == r), trades.where(F.col("ppy") == r), splits, r) for r in rates]
    out = reduce(DataFrame.unionByName, each).join(F.broadcast(table.select("variant", "family", "desk")), "variant")
    return out.join(F.broadcast(_benches(panels, desks, splits)), ["desk", "split"], "left")  # a row for each desk and split


def _benches(panels: dict[str, DataFrame], desks: list[Desk], splits: Splits) -> DataFrame:
    """desk, split, bench_sharpe: the benchmark asset's own returns from the desk's first date on."""
    spark = next(iter(panels.values())).sparkSession
    out = []
    for calendar, panel in panels.items():
        for rate in sorted({float(d.ppy) for d in desks if d.calendar == calendar}):
            some = [d for d in desks if d.calendar == calendar and d.ppy == rate]
            wanted = spark.createDataFrame([(d.name, d.bench, d.start, float(d.rf)) for d in some], "desk string, asset string, start string, rf double")
            r = subset(panel, sorted({d.bench for d in some})).withColumn("r", pct_change("adj_close")).join(F.broadcast(wanted), "asset")
            own = r.where((F.col("date") >= F.col("start").cast("date")) & F.col("r").isNotNull())
            out.append(metrics.summarize(splits.explode(own), ["desk", "split"], rate).select("desk", "split", F.col("sharpe").alias("bench_sharpe")))
    return reduce(DataFrame.unionByName, out)
