"""Runs a grid of strategies in one plan: signals, simulation, scores on each split, and rows for the ledger of trials."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brassloom.operators import backtest as B
from brassloom.operators import ledger, metrics
from brassloom.plans.panel import Splits, stored


#: Trials whose builders share a plan; a plan may not grow without bound.
GROUP = 8


@dataclass(frozen=True)
class Trial:
    """A strategy to try. build(panel) gives panel with a column weight; lookback is how many dates it needs before its first weight means anything."""

    family: str
    variant: str
    build: Callable[[DataFrame], DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    lookback: int = 0

    def id(self, universe: str) -> str:
        return ledger.trial_id(self.family, self.variant, self.params, universe)


def weights(panel: DataFrame, trials: list[Trial]) -> DataFrame:
    """panel times variants, with weight.

    The builders of a group of trials run one after the other on the same rows, each weight as a further column, so
    windows by asset share their shuffle and sort; the columns are unpivoted after them.
    """

    def group(some: list[Trial]) -> DataFrame:
        df = panel
        for i, t in enumerate(some):
            df = t.build(df).withColumnRenamed("weight", f"_w{i}")
        held = F.array(*[F.struct(F.lit(t.variant).alias("variant"), F.col(f"_w{i}").cast("double").alias("weight")) for i, t in enumerate(some)])
        return df.select(*panel.columns, F.inline(held))

    return reduce(DataFrame.unionByName, [group(trials[i : i + GROUP]) for i in range(0, len(trials), GROUP)])


def common_start(panel: DataFrame, trials: list[Trial]) -> dt.date | None:
    """The first date on which every trial has its look-back; None if there are too few dates. A date for each step back is what the driver gets."""
    longest = max(t.lookback for t in trials)
    dates = panel.select("date").distinct().orderBy("date").limit(longest + 1).collect()
    return dates[-1].date if len(dates) > longest else None


def score(panel: DataFrame, trials: list[Trial], splits: Splits, ppy: float, costs: B.Costs = B.Costs(), mode: str = "next_open", rules: B.Rules = B.Rules(), rf: float = 0.0, bench: DataFrame | None = None) -> DataFrame:
    """(variant, split) with a result's summary on the window that all trials share; bench (date, r, rf) gives bench_sharpe."""
    start = str(common_start(panel, trials))
    # Periods and trades both need the weights, which are made once.
    sim = B.simulate(stored(weights(panel, trials)).withColumn("rf", F.lit(rf)), mode, costs, rules=rules)
    out = B.summary(B.sliced(B.periods(sim), start, None), B.sliced(B.episodes(sim), start, None, "entry"), splits, ppy)
    if bench is None:
        return out.withColumn("bench_sharpe", F.lit(None).cast("double"))
    market = metrics.summarize(splits.explode(B.sliced(bench, start, None)), ["split"], ppy)
    return out.join(F.broadcast(market.select("split", F.col("sharpe").alias("bench_sharpe"))), "split", "left")  # a row for each split


def trial_rows(scores: DataFrame, trials: list[Trial], universe: str, source: str, now: str, cost_mult: float = 1.0, rationale: str = "data-mining") -> DataFrame:
    """scores as rows of the ledger of trials."""
    spark = scores.sparkSession
    known = spark.createDataFrame([(t.variant, t.family, t.id(universe), json.dumps(t.params, sort_keys=True, default=str)) for t in trials], "variant string, family string, trial_id string, params_json string")
    span = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    rows = scores.join(F.broadcast(known), "variant")  # a row for each trial
    fixed = {"timestamp_utc": now, "universe": universe, "data_source": source, "rationale": rationale, "status": "tested", "notes": ""}
    rows = rows.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "data_range": span, "cost_mult": F.lit(cost_mult), "sharpe_ann": F.col("sharpe")})
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1].replace("long", "bigint")) for c in ledger.TRIALS.split(", ")])
