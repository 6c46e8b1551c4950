"""The verdict on strategies: every check must hold. Checks whose input isn't given are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brassloom.operators import stats

# The limits of the checks, and the periods that a ratio needs more than.
MAX_LOSS, MIN_DSR, MIN_TRADES, MIN_PERIODS = 0.25, 0.95, 100, 10


def _on(split: str, c: str) -> Column:
    """The value on a split, for series of more than MIN_PERIODS periods."""
    return F.max(F.when((F.col("split") == split) & (F.col("n_periods") > MIN_PERIODS), F.col(c)))


def _earns(splits: tuple[str, ...] = ("DEVELOPMENT", "VALIDATION")) -> Column:
    return reduce(Column.__and__, [F.coalesce(_on(s, "cagr") > 0, F.lit(False)) for s in splits])


def _dsr(summary: DataFrame, trials: DataFrame, to: str) -> DataFrame:
    """variant and its deflated ratio on DEV+VAL; trials (one row): n_trials and the robust variance of their ratios."""
    own = summary.where("split = 'DEV+VAL'").crossJoin(F.broadcast(trials))
    own = own.withColumn("variance", F.greatest(F.coalesce("robust", F.lit(0.0)), F.lit(1.0) / F.greatest("n_periods", F.lit(2))))
    return stats.deflated(own).select("variant", F.col("dsr").alias(to))


def evaluate(
    plain: DataFrame, bench: DataFrame, trials: DataFrame, trades: DataFrame, events: DataFrame, doubled: DataFrame | None = None, nudged: DataFrame | None = None, related: DataFrame | None = None, paths: DataFrame | None = None, holdout: DataFrame | None = None
) -> DataFrame:
    """variant, each check and ``passes``.

    plain, doubled: summaries (variant, split, n_periods, cagr, sharpe, max_dd, sr_period, skew, kurt) at plain and at
    doubled costs. bench: summaries of the benchmark (split, sharpe). trials: one row (n_trials, robust). trades: (variant,
    n) after development. events: (variant, worst), the worst of stress windows and runs of periods. nudged: (variant,
    neighbour), variants with nudged parameters. related: (variant, cagr) on related assets over DEV+VAL. paths: (variant,
    final_p05) of resampled blocks. holdout: (variant, cagr).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = plain.groupBy("variant").agg(_earns().alias("earns"), _on("DEV+VAL", "sharpe").alias("_sharpe"), yes(F.max(F.when(F.col("split") == "DEV+VAL", F.col("max_dd"))) >= -MAX_LOSS).alias("drawdown_ok"))
    market = bench.where("split = 'DEV+VAL'").select(F.col("sharpe").alias("_bench"))  # one row
    out = own.crossJoin(F.broadcast(market)).withColumn("beats_benchmark", yes(F.col("_sharpe") > F.col("_bench"))).drop("_sharpe", "_bench")
    more = [
        _dsr(plain, trials, "_dsr").select("variant", yes(F.col("_dsr") >= MIN_DSR).alias("deflated_ok")),
        trades.select("variant", (F.col("n") >= MIN_TRADES).alias("enough_trades")),
        events.select("variant", (F.col("worst") >= -MAX_LOSS).alias("worst_event_ok")),
    ]
    checks = ["earns", "beats_benchmark", "deflated_ok", "enough_trades", "drawdown_ok", "worst_event_ok"]
    if nudged is not None:
        near = nudged.join(own.select(F.col("variant").alias("neighbour"), F.col("earns").alias("_e")), "neighbour")
        more.append(near.groupBy("variant").agg(F.min("_e").alias("neighbours_earn")))
        checks.append("neighbours_earn")
    if related is not None:
        more.append(related.groupBy("variant").agg(F.min(yes(F.col("cagr") > 0)).alias("related_earn")))
        checks.append("related_earn")
    if paths is not None:
        more.append(paths.select("variant", yes(F.col("final_p05") > 1).alias("resampled_ok")))
        checks.append("resampled_ok")
    if doubled is not None:
        hard = doubled.groupBy("variant").agg(_earns().alias("_e")).join(_dsr(doubled, trials, "_dsr"), "variant")
        more.append(hard.select("variant", (F.col("_e") & yes(F.col("_dsr") >= MIN_DSR)).alias("holds_at_double_cost")))
        checks.append("holds_at_double_cost")
    if holdout is not None:
        more.append(holdout.select("variant", yes(F.col("cagr") > 0).alias("holdout_earns")))
        checks.append("holdout_earns")
    out = reduce(lambda a, b: a.join(b, "variant", "left"), more, out)
    # A variant without neighbours or related assets passes those checks, one without any other value fails.
    out = out.select("variant", *[F.coalesce(c, F.lit(c in ("neighbours_earn", "related_earn"))).alias(c) for c in checks])
    return out.withColumn("passes", reduce(Column.__and__, [F.col(c) for c in checks]))


def report_lines(summary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One text line per row, in fixed width, for a report."""
    cells = [F.rpad(F.coalesce(F.col(k).cast("string"), F.lit("-")), 16, " ") for k in keys]
    cells += [F.lpad(F.coalesce(F.format_number(c, 4), F.lit("-")), 12, " ") for c in columns]
    return summary.select(*keys, F.concat_ws(" ", *cells).alias("line"))


def summary_lines(summary: DataFrame, label: Column, percents: dict[str, str], plain: dict[str, str]) -> DataFrame:
    """label and a line in fixed width of several metrics, by title: shares as percent with one decimal, others with two; what is missing is a dash. The titles' line is ``summary_title``."""
    cell = lambda c, by, digits, sign: F.lpad(F.coalesce(F.format_string(f"%.{digits}f{sign}", F.round(F.col(c) * by, digits) + F.lit(0.0)), F.lit("-")), 10, " ")
    cells = [cell(c, 100.0, 1, "%%") for c in percents.values()] + [cell(c, 1.0, 2, "") for c in plain.values()]
    return summary.select("*", F.concat(F.rpad(label, 30, " "), *cells).alias("line"))


def summary_title(percents: dict[str, str], plain: dict[str, str]) -> str:
    return " " * 30 + "".join(f"{t:>10}" for t in [*percents, *plain])


def markdown(verdicts: DataFrame, checks: list[str]) -> DataFrame:
    """variant and its verdict as a section of Markdown: a table of the checks, and whether all hold."""
    row = lambda c: F.concat(F.lit(f"| {c} | "), F.when(F.col(c), "PASS").otherwise("FAIL"), F.lit(" |"))
    overall = F.concat(F.lit("**Overall: "), F.when(F.col("passes"), "passed all").otherwise("did not pass"), F.lit("**"))
    lines = [F.concat(F.lit("### "), "variant"), F.lit(""), F.lit("| check | result |"), F.lit("|---|---|"), *map(row, checks), F.lit(""), overall]
    return verdicts.select("variant", F.concat_ws("\n", *lines).alias("text"))
