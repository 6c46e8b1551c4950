"""Recursive series: closed forms by windows where there is one, a stream per key where there is none.

``fold`` keeps one key's sorted rows in an array inside the JVM, for short series (a row a year). ``stream`` reads rows that
Spark has dealt by key and sorted, batch by batch, and keeps one state: time is linear and memory constant in the
length of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

def fold(df: DataFrame, keys: list[str], order: str, values: list[str], start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column], Column]) -> DataFrame:
    """keys, order, values and ``out``: the state after each row, as out(state) sees it.

    step(state, row) gives the next state; states are kept in an array beside the rows.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    state = lambda acc: F.element_at(acc, -1)
    states = F.aggregate("_rows", F.array(start), lambda acc, x: F.concat(acc, F.array(step(state(acc), x))), lambda acc: F.slice(acc, 2, F.size(acc)))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows")).withColumn("_states", states)
    return grouped.select(*keys, F.inline(F.zip_with("_rows", "_states", lambda r, s: F.struct(r[order].alias(order), *[r[v].alias(v) for v in values], out(s).alias("out")))))


def fold_last(df: DataFrame, keys: list[str], order: str, values: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys and the final state only."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.aggregate("_rows", start, step).alias("state"))


def stream(df: DataFrame, keys: list[str], order: str, values: list[str], start: Any, step: Callable[..., tuple[Any, float | None]]) -> DataFrame:
    """keys, order, values and ``out`` (double): step(state, *values of a row) gives the next state and what to put out."""
    names = [*keys, order, *values]
    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, order)
    types = [to_arrow_type(rows.schema[c].dataType) for c in names]
    first, n = len(keys) + 1, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:n]), zip(*columns[first:])):
                if key != at:
                    at, state = key, start
                state, shown = step(state, *row)
                out.append(shown)
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(batch.columns, types)), pa.array(out, pa.float64())], names=[*names, "out"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, out double")


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """Recursive average that the first value seeds; NULLs leave it as it is."""

    def step(s: float | None, x: float | None) -> tuple[float | None, float | None]:
        s = s if x is None else x if s is None else alpha * x + (1.0 - alpha) * s
        return s, s

    return stream(df, keys, order, [value], None, step)


def after_tax(yearly: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """keys, year, growth and ``out``: struct(equity, carry, tax, before) after each year.

    Gains and what is carried over are taxed at year end; losses are carried forward.
    """
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(0.0).alias("carry"), F.lit(0.0).alias("tax"), F.lit(1.0).alias("before"))

    def step(s: Column, x: Column) -> Column:
        gain = s["equity"] * x["growth"] - s["equity"] + s["carry"]
        tax = F.when(gain > 0, x[rate] * gain).otherwise(0.0)
        return F.struct((s["equity"] * x["growth"] - tax).alias("equity"), F.when(gain < 0, gain).otherwise(0.0).alias("carry"), tax.alias("tax"), s["equity"].alias("before"))

    return fold(yearly, keys, "year", ["growth", rate], start, step, lambda s: s)


def hysteresis(df: DataFrame, keys: list[str], order: str, enter: str, leave: str) -> DataFrame:
    """df with ``out``: 1 from a row where ``enter`` holds to the one before ``leave`` holds, else 0; a row where both hold changes the state.

    So the state is that of the last row where one of both holds, changed once for each row since then where both do.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    go, stop = (F.coalesce(F.col(c), F.lit(False)) for c in (enter, leave))
    turns = F.sum(F.when(go & stop, 1).otherwise(0)).over(w)
    rows = df.withColumn("_turns", turns).withColumn("_set", F.when(go & ~stop, 1).when(stop & ~go, 0))
    last = F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), ignorenulls=True).over(w)
    rows = rows.withColumn("_last", last)
    state = (F.coalesce("_last._set", F.lit(0)) + F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2
    return rows.withColumn("out", state.cast("double")).drop("_turns", "_set", "_last")


def three_state(df: DataFrame, keys: list[str], order: str, z: str, entry: float, leave: float) -> DataFrame:
    """``out`` is -1 after z rose over entry until it falls under leave, 1 the other way round, else 0; 0 where z is NULL, with the state kept."""

    def step(held: float, v: float | None) -> tuple[float, float]:
        if v is None:
            return held, 0.0
        if held == 0:
            held = -1.0 if v > entry else 1.0 if v < -entry else 0.0
        elif (held < 0 and v < leave) or (held > 0 and v > -leave):
            held = 0.0
        return held, held

    return stream(df, keys, order, [z], 0.0, step)
