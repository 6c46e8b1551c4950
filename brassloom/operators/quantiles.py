"""Exact quantiles of groups of any size: a sketch narrows each quantile to a small range of values, in which ranks are counted.

``percentile`` keeps a group's distinct values in one task's memory. Here a group of more than ``LEAF`` values is
sketched, which gives for each quantile two values that surely enclose it; how many values lie below is counted,
and the values between go on to the next round, a two-hundredth of the group. The last few are counted by value and
added up in order, as soon as they are few, however many rows have them. Results are those of linear interpolation between neighbouring values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brassloom.plans.panel import stored

#: Values of a group that one window adds up; steps of a sketch, whose error is a tenth of a step.
LEAF, STEPS = 1_000_000, 1000


def exact(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys and a column for each name in qs: the group's quantile at that share. Nulls and NaN are no values; a group without values has NULLs."""
    rows = df.select(*keys, F.when(~F.isnan(value), F.col(value)).cast("double").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("v").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= LEAF:
        return rows.groupBy(*keys).agg(*[F.percentile("v", q).alias(name) for name, q in qs.items()])
    sizes = stored(sizes)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.lit(q).alias("share")) for name, q in qs.items()]))
    at = sizes.where("n > 0").withColumn("_w", wanted).select(*keys, "_w.q", (F.col("_w.share") * (F.col("n") - 1)).alias("rank"))
    targets = stored(at.select(*keys, "q", F.floor("rank").alias("rank"), (F.col("rank") - F.floor("rank")).alias("part")))
    held, by, first = rows.where("v IS NOT NULL"), [*keys, "q"], True
    while True:
        ids = keys if first else by
        cuts = held.groupBy(*ids).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("cuts"))
        step = F.floor(F.col("rank") / F.col("n") * STEPS).cast("int")
        a = F.when((F.col("n") <= LEAF) | (step < 2), F.col("low")).otherwise(F.element_at("cuts", F.greatest(step - 1, F.lit(1))))
        b = F.when((F.col("n") <= LEAF) | (step > STEPS - 4), F.col("high")).otherwise(F.element_at("cuts", F.least(step + 5, F.lit(STEPS + 1))))
        bounds = stored(targets.join(cuts, ids).select(*by, a.alias("a"), b.alias("b")))
        placed = held.join(F.broadcast(bounds), ids)  # a row for each group of more than LEAF values, and each quantile
        below = placed.groupBy(*by).agg(F.count(F.when(F.col("v") < F.col("a"), 1)).alias("below"))
        held = stored(placed.where("v >= a AND v <= b").select(*by, "v"))
        targets = stored(targets.join(below, by).select(*by, (F.col("rank") - F.col("below")).alias("rank"), "part"))
        # Few values that many rows share need no further round; nor does a round help that leaves most rows, as one value next to the rank has them.
        most, several = held.groupBy(*by).agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("d")).agg(F.max("n"), F.max(F.when(F.col("n") > LEAF, F.col("d")))).first()
        if not several or several <= LEAF or (not first and most > last / 2):
            break
        first, last = False, most
    each = held.groupBy(*by, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = each.withColumn("_upto", upto).join(targets, by)
    over = lambda k: F.min(F.when(F.col("_upto") > F.col("rank") + k, F.col("v")))
    ends = ranked.groupBy(*by).agg(over(0).alias("x"), over(1).alias("y"), F.max("part").alias("part"))
    value_at = F.when(F.col("part") > 0, F.col("x") + F.col("part") * (F.col("y") - F.col("x"))).otherwise(F.col("x"))
    out = ends.groupBy(*keys).pivot("q", list(qs)).agg(F.max(value_at))
    return sizes.select(*keys).join(out, keys, "left")
