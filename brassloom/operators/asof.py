"""As-of joins: for each left row the last right row at or before its time, in n log n and with one shuffle of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(of: DataFrame, name: str) -> Column:
    """A time as a number: days of a date, seconds of a timestamp, others as they are."""
    kind, t = of.schema[name].dataType.simpleString(), F.col("_t")
    if kind == "date":
        return F.unix_date(t).cast("double")
    return t.cast("timestamp").cast("double") if kind.startswith("timestamp") else t.cast("double")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], take: list[str], tolerance: float | None = None, tie: str | None = None, span: float | None = None) -> DataFrame:
    """left with the columns ``take`` of the last right row of the same key whose time is not after the left one's.

    Times compare as they are; with a tolerance (seconds for timestamps, days for dates, inclusive) an older row counts
    as none. Rows of both sides are united and a window per key carries the last right row on, so neither side is
    multiplied. ``tie``: of right rows at the same time the one with the largest value is taken.

    ``span`` (in the unit of the tolerance) cuts the time of each key into ranges, which are windows of their own, so a key
    that holds a third of all rows is many groups. What a range hands on to later ones is its last right row: one row
    for each key and range that has any, carried on by a window of its own and joined back.
    """
    right = right.select(*by, F.col(right_on).alias("_t"), F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in take]).alias("_r"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    tagged = left.withColumn("_t", F.col(left_on)).withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    groups = list(by)
    if span is not None:
        tagged = tagged.withColumn("_span", F.floor(_number(left, left_on) / span))
        groups.append("_span")
    w = Window.partitionBy(*groups).orderBy(F.col("_t"), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tagged.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if span is not None:
        ends = tagged.where("_side = 0 AND _span IS NOT NULL").groupBy(*groups).agg(F.max(F.struct("_t", "_tie", "_r"))["_r"].alias("_end"))
        along = Window.partitionBy(*by).orderBy("_span")
        # A range starts with the last right row of the nearest range before it that has one.
        spans = found.where("_span IS NOT NULL").select(*groups).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).withColumn("_of", F.lit(0))
        both = spans.unionByName(ends.withColumn("_of", F.lit(1)))
        before = F.last("_end", ignorenulls=True).over(along.orderBy("_span", "_of").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        starts = both.withColumn("_start", before).where("_of = 0").select(*groups, "_start")
        found = found.join(starts, groups, "left").withColumn("_r", F.coalesce("_r", "_start"))
    if tolerance is not None:
        t, at = F.col("_t"), F.col("_r._at")
        kind = left.schema[left_on].dataType.simpleString()
        seconds = (lambda x: x.cast("timestamp").cast("double")) if kind.startswith("timestamp") else (lambda x: x.cast("double"))
        age = F.datediff(t, at).cast("double") if kind == "date" else seconds(t) - seconds(at)
        found = found.withColumn("_r", F.when(age <= tolerance, F.col("_r")))
    return found.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in take])


def asof_lookup(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], take: list[str], tolerance: float | None = None, tie: str | None = None, span: float | None = None) -> DataFrame:
    """What asof_join gives, for left rows many of which share key and time: each distinct (key, time) is looked up once.

    The distinct pairs come from a partial aggregate and are joined back by equality, where Spark splits a hot key, so a
    million rows of one key and time are one row in the window.
    """
    on = [*by, left_on]
    pairs = asof_join(left.select(*on).distinct(), right, left_on, right_on, by, take, tolerance, tie, span)
    found = pairs.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[F.col(c).alias(f"_take_{c}") for c in take])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(found, same, "left").select(*left.columns, *[F.col(f"_take_{c}").alias(c) for c in take])


def align(grid: DataFrame, values: DataFrame, by: list[str], on: str, take: list[str], span: float | None = None) -> DataFrame:
    """grid with the slower values carried forward to its times: an as-of join without tolerance."""
    return asof_join(grid, values, on, on, by, take, span=span)
