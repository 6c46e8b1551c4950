"""Resampled paths: the distribution of final equity and deepest drawdown when a series is drawn anew, trade by trade or in blocks.

A block is summarized once by four numbers of its log returns: their sum, the highest and the lowest prefix, and the
deepest fall inside. Summaries compose, so a path of T returns is a walk over T / block summaries, whatever the block
holds. For a short series the summaries go to each task of paths, which walks bounded matrices of them; for a long one
paths are rows (path, step) that are joined to the summaries by the block drawn, where a path is a window. Draws are integers
from (seed, path, step), so both ways and any other engine repeat them, and no task has a generator of its own.

Series are numbered by a prefix scan and cut into ranges before blocks are made, each with the rows that the blocks at
its end need from the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brassloom.operators import scan
from brassloom.plans.panel import stored

PRIME = 2147483647
#: Log return that stands for the loss of everything.
RUIN = -800.0
#: Blocks of a key up to which their summaries (eight numbers each) go to each task of paths as arrays; beyond, steps are joined to them by a shuffle.
FEW = 100_000
#: Steps of paths that a task walks at a time.
CELLS = 1_000_000
QUANTILES = ("final_p05", "final_p50", "final_p95", "dd_p50", "dd_p05")
RESULTS = (*QUANTILES, "prob_loss", "prob_dd_25")


def _mixed(x, xor, right):
    """Two rounds of a product modulo a prime and a shift, for whatever knows +, *, %, xor and shifts of 64-bit integers."""
    for a, by in ((1583458089, 16), (784588716, 13)):
        x = (x * a + 1) % PRIME
        x = xor(x, right(x, by))
    return x


def _drawn(path, step, n, seed: int, xor, right):
    of_path = _mixed((path + (1 + 40692 * seed)) % PRIME, xor, right)
    return right(_mixed((of_path + step * 69621) % PRIME, xor, right) * n, 31)


def drawn(path: Column, step: Column, n: Column, seed: int = 0) -> Column:
    """A number from 0 to n - 1 for each path and step; n is below 2**31."""
    return _drawn(path.cast("long"), step.cast("long"), n.cast("long"), seed, lambda a, b: a.bitwiseXOR(b), F.shiftright)


class _Sql(str):
    """Text of an integer expression."""

    def __add__(self, other) -> _Sql:
        return _Sql(f"({self} + {str(other)})")

    def __mul__(self, other) -> _Sql:
        return _Sql(f"({self} * {str(other)}::BIGINT)")

    def __mod__(self, other) -> _Sql:
        return _Sql(f"({self} % {other})")


def drawn_sql(path: str, step: str, n: str, seed: int = 0) -> str:
    return _drawn(_Sql(path), _Sql(step), _Sql(n), seed, lambda a, b: _Sql(f"xor({a}, {b})"), lambda a, by: _Sql(f"({a} >> {by})"))


def _walk(values: Column) -> Column:
    """Sum, highest and lowest prefix, and deepest fall of an array of log returns."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("high"), F.lit(float("inf")).alias("low"), F.lit(0.0).alias("fall"))

    def step(s: Column, x: Column) -> Column:
        level = s["sum"] + x
        high = F.greatest(s["high"], level)
        return F.struct(level.alias("sum"), high.alias("high"), F.least(s["low"], level).alias("low"), F.least(s["fall"], level - high).alias("fall"))

    return F.aggregate(values, start, step)


def blocks(rows: DataFrame, keys: list[str], block: int, tail: Column) -> DataFrame:
    """rows (keys, pos, n, x) to (keys, pos, full, last): what the block from pos on, and its first ``tail`` returns, come to; blocks wrap around at the end."""
    size = scan.SEGMENT
    at = F.explode(F.when(F.col("pos") < block - 1, F.array(F.col("pos"), F.col("pos") + F.col("n"))).otherwise(F.array("pos")))
    placed = rows.withColumn("_at", at)
    # Every range of starts that needs the row.
    first, last = F.floor(F.greatest(F.col("_at") - (block - 1), F.lit(0)) / size), F.floor(F.least(F.col("_at"), F.col("n") - 1) / size)
    placed = placed.withColumn("_seg", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_seg").orderBy("_at").rowsBetween(0, block - 1)
    held = placed.withColumn("_x", F.collect_list("x").over(w)).where((F.col("_at") < F.col("n")) & (F.floor(F.col("_at") / size) == F.col("_seg")))
    return held.select(*keys, F.col("_at").alias("pos"), _walk(F.col("_x")).alias("full"), _walk(F.slice("_x", F.lit(1), tail)).alias("last"))


def _walked(known: DataFrame, summaries: DataFrame, keys: list[str], n_sims: int, seed: int) -> DataFrame:
    """keys, final and dd of each path, from arrays of a key's summaries."""
    names = [f"{b}_{c}" for b in ("full", "last") for c in ("sum", "high", "low", "fall")]
    held = summaries.join(F.broadcast(known.select(*keys)), keys, "left_semi")
    held = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[F.col(n.replace("_", ".")).alias(n) for n in names]))).alias("b"))
    tasks = known.withColumn("_many", F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("_steps"))).cast("int"))
    tasks = tasks.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.col("_many"))))
    tasks = held.select(*keys, *[F.col("b")[n].alias(n) for n in names]).join(tasks.select(*keys, "_from", "_many", "_steps"), keys)
    k, types = len(keys), [to_arrow_type(tasks.schema[c].dataType) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                full, last = (np.array([batch.column(k + j)[i].values.to_numpy() for j in part]) for part in (range(4), range(4, 8)))
                first, many, steps = (batch.column(k + 8 + j)[i].as_py() for j in range(3))
                final, dd = _ends(full, last, np.arange(first, min(first + many, n_sims)), steps, seed)
                same = [pa.array([batch.column(j)[i].as_py()] * len(final), t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(final), pa.array(dd)], names=[*keys, "final", "dd"])

    fields = ", ".join(f"`{c}` {tasks.schema[c].dataType.simpleString()}" for c in keys)
    return tasks.repartition(*keys, "_from").select(*keys, *names, "_from", "_many", "_steps").mapInArrow(run, f"{fields}, final double, dd double")


def _ends(full: np.ndarray, last: np.ndarray, paths: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Final equity and deepest drawdown of paths; full and last: sum, high, low and fall of whole blocks and of those that a path ends with."""
    at = _drawn(paths[:, None].astype(np.int64), np.arange(steps, dtype=np.int64)[None], full.shape[1], seed, np.bitwise_xor, np.right_shift)
    total, high, low, fall = full[:, at]
    for x, of in zip((total, high, low, fall), last):
        x[:, -1] = of[at[:, -1]]
    level = np.cumsum(total, axis=1) - total
    peak = np.zeros_like(level)
    np.maximum(np.maximum.accumulate(level + high, axis=1)[:, :-1], 0.0, out=peak[:, 1:])
    deepest = np.minimum(np.minimum(level + low - peak, fall).min(axis=1), 0.0)
    return np.exp(total.sum(axis=1)), np.expm1(deepest)


def _joined(known: DataFrame, summaries: DataFrame, keys: list[str], n_sims: int, seed: int) -> DataFrame:
    """The same by a row for each step."""
    paths = known.withColumn("_path", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).repartition(*keys, "_path")
    steps = paths.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_steps") - 1)))
    steps = steps.withColumn("pos", drawn(F.col("_path"), F.col("_step"), F.col("n"), seed))
    taken = steps.join(summaries, [*keys, "pos"])
    b = F.when(F.col("_step") == F.col("_steps") - 1, F.col("last")).otherwise(F.col("full"))
    taken = taken.select(*keys, "_path", "_step", b.alias("b"))
    before = Window.partitionBy(*keys, "_path").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("_level", F.coalesce(F.sum("b.sum").over(before), F.lit(0.0)))
    peak = F.greatest(F.coalesce(F.max(F.col("_level") + F.col("b.high")).over(before), F.lit(0.0)), F.lit(0.0))
    taken = taken.withColumn("_fall", F.least(F.col("_level") + F.col("b.low") - peak, F.col("b.fall"), F.lit(0.0)))
    return taken.groupBy(*keys, "_path").agg(F.exp(F.sum("b.sum")).alias("final"), F.expm1(F.min("_fall")).alias("dd")).drop("_path")


def resampled(series: DataFrame, keys: list[str], value: str, order: list[str], n_sims: int, block: int, horizon: int | None, least: int, seed: int) -> DataFrame:
    """keys, n_sims and RESULTS; a key with fewer than ``least`` values has n_sims 0 and NULLs."""
    x = F.when(F.col(value) > -1, F.log1p(value)).otherwise(RUIN)
    # Both the lengths and the blocks need the series, which may be costly to make.
    given = stored(series.select(*keys, *order, F.when(F.col(value).isNotNull() & ~F.isnan(value), x).alias("x")))
    lengths = given.groupBy(*keys).agg(F.count("x").alias("n")).withColumn("_h", F.lit(horizon).cast("long") if horizon else F.col("n"))
    lengths = stored(lengths.withColumn("_steps", F.ceil(F.col("_h") / block)))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    rows = scan.numbered(given.where("x IS NOT NULL"), keys, order[0], tuple(order[1:]), longest=longest)
    known = lengths.where(F.col("n") >= least)
    tail = (F.col("_h") - (F.col("_steps") - 1) * block).cast("int")
    summaries = blocks(rows.join(F.broadcast(known.withColumn("_tail", tail)), keys), keys, block, F.col("_tail"))
    if longest > FEW:
        summaries = stored(summaries)
    ends = _walked(known.where(F.col("n") <= FEW), summaries, keys, n_sims, seed)
    if longest > FEW:
        ends = ends.unionByName(_joined(known.where(F.col("n") > FEW), summaries, keys, n_sims, seed))
    out = ends.groupBy(*keys).agg(
        F.count("*").alias("n_sims"), *[F.percentile(q.split("_")[0], int(q[-2:]) / 100).alias(q) for q in QUANTILES],
        F.avg(F.when(F.col("final") < 1, 1.0).otherwise(0.0)).alias("prob_loss"), F.avg(F.when(F.col("dd") < -0.25, 1.0).otherwise(0.0)).alias("prob_dd_25"),
    )
    return lengths.select(*keys).join(out, keys, "left").withColumn("n_sims", F.coalesce("n_sims", F.lit(0)))


def resample_trades(trades: DataFrame, keys: list[str], value: str, order: list[str], n_sims: int = 10_000, n_trades: int | None = None, seed: int = 0) -> DataFrame:
    """Distribution of final equity and drawdown when each key's trades are drawn with replacement; keys with under five trades have none."""
    return resampled(trades, keys, value, order, n_sims, 1, n_trades, 5, seed)


def block_bootstrap(series: DataFrame, keys: list[str], value: str = "r", horizon: int | None = None, block: int = 21, n_sims: int = 10_000, seed: int = 0) -> DataFrame:
    """The same for blocks of consecutive returns, which wrap around at the end; keys with under two blocks have none."""
    return resampled(series, keys, value, ["date"], n_sims, block, horizon, 2 * block, seed)


def resampled_sql(src: str, key: str, value: str, order: str, block: int, least: int, n_sims: int = 10_000, seed: int = 0) -> str:
    """The same in SQL, over a table src whose results have the column key."""
    last = f"t - ((t + {block - 1}) // {block} - 1) * {block}"
    walk = lambda to, of: f"list_sum({of}) AS {to}_sum, list_transform(range(1, len({of}) + 1), lambda i: list_sum({of}[1:i])) AS {to}_p"
    shape = lambda to: f"list_max({to}_p) AS {to}_high, list_min({to}_p) AS {to}_low, list_min(list_transform(range(1, len({to}_p) + 1), lambda i: {to}_p[i] - list_max({to}_p[1:i]))) AS {to}_fall"
    pick = lambda c: f"CASE WHEN step = (t + {block - 1}) // {block} - 1 THEN l_{c} ELSE f_{c} END AS b_{c}"
    w = f"PARTITION BY {key}, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    quantiles = ", ".join(f"quantile_cont({q.split('_')[0]}, {int(q[-2:]) / 100}) AS {q}" for q in QUANTILES)
    return f"""WITH rs_a AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS t, CASE WHEN {value} > -1 THEN ln(1e0 + CASE WHEN {value} > -1 THEN {value} ELSE 0e0 END) ELSE {RUIN} END AS x FROM {src} WHERE {value} IS NOT NULL),
 rs_b AS (SELECT {key}, t, pos, x FROM rs_a UNION ALL SELECT {key}, t, pos + t, x FROM rs_a WHERE pos < {block - 1}),
 rs_c AS (SELECT * FROM (SELECT {key}, t, pos, list(x) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS a FROM rs_b) WHERE pos < t AND t >= {least}),
 rs_d AS (SELECT {key}, t, pos, {walk("f", "a")}, {walk("l", f"a[1:{last}]")} FROM rs_c), rs_e AS (SELECT *, {shape("f")}, {shape("l")} FROM rs_d),
 rs_f AS (SELECT {key}, t, path, step, {drawn_sql("path", "step", "t", seed)} AS pos FROM (SELECT {key}, t, path, unnest(range((t + {block - 1}) // {block})) AS step FROM (SELECT DISTINCT {key}, t FROM rs_c), range({n_sims}) p(path))),
 rs_g AS (SELECT {key}, path, step, {", ".join(map(pick, ("sum", "high", "low", "fall")))} FROM (SELECT f.{key}, f.t, f.path, f.step, e.* EXCLUDE ({key}, t, pos) FROM rs_f f JOIN rs_e e ON e.{key} = f.{key} AND e.pos = f.pos)),
 rs_h AS (SELECT *, coalesce(sum(b_sum) OVER ({w}), 0e0) AS level FROM rs_g),
 rs_i AS (SELECT *, greatest(coalesce(max(level + b_high) OVER ({w}), 0e0), 0e0) AS peak FROM rs_h),
 rs_j AS (SELECT {key}, path, exp(sum(b_sum)) AS final, exp(min(least(level + b_low - peak, b_fall, 0e0))) - 1e0 AS dd FROM rs_i GROUP BY 1, 2),
 rs_k AS (SELECT {key}, count(*) AS n, {quantiles}, avg(CASE WHEN final < 1 THEN 1e0 ELSE 0e0 END) AS prob_loss, avg(CASE WHEN dd < -2.5e-1 THEN 1e0 ELSE 0e0 END) AS prob_dd_25 FROM rs_j GROUP BY 1)
 SELECT {key}, coalesce(n, 0) AS n_sims, {", ".join(RESULTS)} FROM (SELECT DISTINCT {key} FROM {src}) LEFT JOIN rs_k USING ({key})"""
