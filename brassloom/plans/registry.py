"""Where queries register: a name, the function of (spark, sf_dir), and its SQL for DuckDB if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with DIGITS decimals (and no negative zero), counts as long: what the SQL side gives as well."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            out.append((F.round(F.col(f.name), DIGITS) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def mean_of_money(x: str) -> Column:
    """The mean of amounts of up to four decimals, rounded half up to DIGITS in integers: a mean of cents often lies halfway, where doubles would decide."""
    n = F.count(x)
    twice = F.sum(F.round(F.col(x) * 1e4).cast("long")) * (2 * 10 ** (DIGITS - 4)) + n
    return F.floor((twice - F.pmod(twice, 2 * n)) / (2 * n)) / float(10**DIGITS)


def mean_of_money_sql(x: str) -> str:
    twice = f"(sum(round({x} * 1e4)::BIGINT)::BIGINT * {2 * 10 ** (DIGITS - 4)} + count({x}))"
    return f"(({twice} - (({twice} % (2 * count({x}))) + 2 * count({x})) % (2 * count({x}))) // (2 * count({x}))) / 1e{DIGITS}"


def query(name: str, keys: str, values: str = "", sql: str | None = None):
    """Register a query whose result has the columns keys (as they are), and values (doubles, rounded)."""

    def register(f):
        columns = keys.split() + values.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir).select(*columns))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql:
            out = keys.split() + [f"round(CAST({v} AS DOUBLE), {DIGITS}) + 0e0 AS {v}" for v in values.split()]
            SQL[name] = f"WITH src AS ({sql}) SELECT {', '.join(out)} FROM src"
        return run

    return register


#: The dense weekly panel in SQL: bars, then every week for every priority.
PANEL = """
bars AS (SELECT date_trunc('week', o_orderdate)::DATE AS date, o_orderpriority AS asset,
    arg_min(1e2 + o_totalprice / 5e4, o_orderkey) AS open, max(1e2 + o_totalprice / 5e4) AS high, min(1e2 + o_totalprice / 5e4) AS low,
    arg_max(1e2 + o_totalprice / 5e4, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2),
panel AS (SELECT d.date, a.asset, b.open, b.high, b.low, b.close, b.close AS adj_close, b.volume
  FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT asset FROM bars) a LEFT JOIN bars b ON b.date = d.date AND b.asset = a.asset)
"""
#: Window by asset in SQL.
BY = "PARTITION BY asset ORDER BY date"


def panel_sql(select: str, ctes: str = "") -> str:
    return f"WITH {PANEL}{', ' + ctes if ctes else ''} {select}"


def roll(agg: str, x: str, n: int, least: int | None = None, lag: int = 0, by: str = BY) -> str:
    frame = f"OVER ({by} ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING)" if lag else f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END)"
