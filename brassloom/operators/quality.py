"""Checks of price bars: one aggregate pass, then a row per issue found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brassloom.operators.windows import pct_change


def check_bars(bars: DataFrame, keys: list[str], max_move: float = 0.25, max_gap: int = 5, tol: float = 1e-6, ordinal: str | None = None, checks: tuple[str, ...] | None = None) -> DataFrame:
    """keys, severity, check and n of each issue in bars (keys, date, open, high, low, close, volume).

    ordinal: a column with the rows' order in their source; with it, dates that don't ascend are an issue.
    checks: names of the checks to make; all of them without it.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    last = F.lag("close").over(w)
    df = bars.withColumn("_ret", pct_change("close", 1, w)).withColumn("_gap", F.datediff("date", F.lag("date").over(w)))
    df = df.withColumn("_same_date", F.when(F.col("_gap") == 0, 1).otherwise(0))
    df = df.withColumn("_stale", F.when((F.col("close") - last == 0) & (F.col("volume") == 0), 1).otherwise(0))
    df = df.withColumn("_stale5", F.sum("_stale").over(w.rowsBetween(-4, 0))).withColumn("_eq", F.when(F.abs(F.col("open") - last) < 1e-9 * last, 1.0).otherwise(0.0))
    down = F.lag("date").over(Window.partitionBy(*keys).orderBy(ordinal)) > F.col("date") if ordinal else F.lit(False)
    df = df.withColumn("_down", down)
    top = F.greatest("open", "close", "low") * (1 - tol)
    bottom = F.least("open", "close", "high") * (1 + tol)
    n = lambda c: F.count(F.when(c, 1))
    found: list[tuple[str, str, Column]] = [("error", "duplicate_dates", F.sum("_same_date")), ("error", "unsorted", n(F.col("_down")))]
    for c in ("open", "high", "low", "close"):
        found += [("warn", f"nan_{c}", n(F.col(c).isNull())), ("error", f"nonpositive_{c}", n(F.col(c) <= 0))]
    found += [
        ("error", "high_below_ohlc", n(F.col("high") < top)),
        ("error", "low_above_ohlc", n(F.col("low") > bottom)),
        ("warn", "extreme_returns", n(F.abs("_ret") > max_move)),
        ("warn", "calendar_gaps", n(F.col("_gap") > max_gap)),
        ("warn", "stale_prices", n(F.col("_stale5") >= 5)),
        ("warn", "open_equals_prev_close", F.when(F.avg("_eq") > 0.2, F.sum("_eq").cast("long")).otherwise(0)),
    ]
    if checks is not None:
        if unknown := set(checks) - {name for _, name, _ in found}:
            raise ValueError(f"unknown checks {sorted(unknown)}")
        found = [f for f in found if f[1] in checks]
    one = df.groupBy(*keys).agg(*[c.cast("long").alias(name) for _, name, c in found])
    issues = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(name).alias("check"), F.col(name).alias("n")) for s, name, _ in found])
    return one.select(*keys, F.inline(issues)).where("n > 0")


def assert_clean(issues: DataFrame) -> None:
    """Raise if any issue is an error; at most ten come to the driver."""
    errors = issues.where("severity = 'error'").limit(10).collect()
    if errors:
        raise ValueError("data quality errors: " + "; ".join(f"{r['check']}: {r['n']}" for r in errors))


def validate(datasets: dict[str, DataFrame], keys: list[str], **how) -> DataFrame:
    """dataset, rows, first, last, and how many issues of either kind its series have."""
    out = []
    for name, bars in datasets.items():
        rows = bars.agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
        found = check_bars(bars, keys, **how).agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warn", 1)).alias("warnings"))
        out.append(rows.crossJoin(found).select(F.lit(name).alias("dataset"), "*"))  # one row each
    return reduce(DataFrame.unionByName, out)


def both_returns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date and the closes and returns of two sources on the dates that both have."""
    w = Window.partitionBy(*keys).orderBy("date")
    ra = a.select(*keys, "date", F.col("close").alias("_ca"), pct_change("close", 1, w).alias("_a"))
    rb = b.select(*keys, "date", F.col("close").alias("_cb"), pct_change("close", 1, w).alias("_b"))
    return ra.join(rb, [*keys, "date"])


def top_differences(a: DataFrame, b: DataFrame, keys: list[str], n: int = 5, digits: int = 9) -> DataFrame:
    """keys, rank, date and diff: the n dates on which two sources' returns differ most, by so many digits; ties go to the earlier date, so rounding noise ranks nothing."""
    df = both_returns(a, b, keys).withColumn("diff", F.round(F.abs(F.col("_a") - F.col("_b")), digits)).where("diff IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("diff").desc(), "date"))
    return df.select(*keys, rank.alias("rank"), "date", "diff").where(F.col("rank") <= n)


def sampled_differences(a: DataFrame, b: DataFrame, keys: list[str], n: int = 40, seed: int = 0) -> DataFrame:
    """keys, sample_n and the greatest difference in a sample of n dates, chosen by a hash of the date."""
    df = both_returns(a, b, keys).withColumn("diff", F.abs(F.col("_a") - F.col("_b"))).where("diff IS NOT NULL")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("date").cast("string")).cast("binary"))
    chosen = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= n)
    return chosen.groupBy(*keys).agg(F.count("*").alias("sample_n"), F.max("diff").alias("sample_worst"))


def spot_check(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 0.002) -> DataFrame:
    """keys and how two sources' returns agree: days in common, correlation, share within tol, range of the level ratio."""
    df = both_returns(a, b, keys)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pair = lambda c: F.when(both, F.col(c))
    near = F.when(both, F.when(F.abs(F.col("_a") - F.col("_b")) <= tol, 1.0).otherwise(0.0))
    ratio = F.try_divide("_ca", "_cb")
    return df.groupBy(*keys).agg(F.count(F.when(both, 1)).alias("n"), F.corr(pair("_a"), pair("_b")).alias("corr"), F.avg(near).alias("within"), F.max(F.abs(pair("_a") - pair("_b"))).alias("worst"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"))
