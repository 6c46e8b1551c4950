"""Prefix scans over series of any length: a long key is cut into ranges of its order, which are reduced, scanned and applied.

A window or a stream by key puts a whole series into one task. Here a key with more than ``SEGMENT`` rows is cut into
Spark's range partitions of its order; each range is reduced to an element of a monoid (a product and its peaks, an affine map, a
table of states to states), the elements are scanned - one row for each range - and what came before a range is
applied to its rows. Keys of ordinary length are one range, and cost what they cost by windows.

Rows of one key with equal order stay in one range; they come in the order of ``ties``. The rows of a range are
written once to the shared folder between reducing and applying, so that both see the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brassloom.plans.panel import stored

SEGMENT = 1_000_000
#: Ranges of one key that a smaller number of rows makes at most; beyond them ranges grow, up to SEGMENT rows.
SPREAD = 256
#: Ranges of all long keys at most; beyond them ranges grow, with 4096 times SEGMENT rows.
MOST = 4096
#: Keys longer than a segment that are broadcast; beyond, they are joined by a shuffle. Tenfold, for what a range carries.
FEW = 10_000


def _long(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """keys and _n of those with more than so many rows; None if there is none."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    return stored(sizes.where(F.col("_n") > rows)) if most > rows else None


def segmented(df: DataFrame, keys: list[str], order: str, rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with ``_seg``, which grows with a row's range within its key (0 throughout for keys of up to so many rows); where a key is cut, rows are stored."""
    rows = rows or SEGMENT
    long = _long(df, keys, rows)
    return df.withColumn("_seg", F.lit(0)) if long is None else stored(_cut(df, long, keys, order, rows, ties))


def _cut(df: DataFrame, long: DataFrame, keys: list[str], order: str, rows: int, ties: tuple[str, ...]) -> DataFrame:
    """df with _seg, each range in one partition and in order: Spark's range partitions cut the long keys, so no row carries their borders."""
    parts = F.greatest(F.least(F.ceil(F.col("_n") / rows), F.lit(SPREAD)), F.ceil(F.col("_n") / SEGMENT))
    few, total, held = long.agg(F.count("*"), F.sum(parts), F.sum("_n")).first()
    small = F.broadcast(long) if few <= FEW else long
    of_long = df if held == df.count() else df.join(small, keys, "left_semi")
    cut = of_long.repartitionByRange(min(MOST, total), *keys, order).sortWithinPartitions(*keys, order, *ties).withColumn("_seg", F.spark_partition_id())
    return cut if of_long is df else cut.unionByName(_whole(df.join(small, keys, "left_anti"), keys, order, ties))


def _whole(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...]) -> DataFrame:
    return df.withColumn("_seg", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys, order, *ties)


def _within(keys: list[str], order: str, ties: tuple[str, ...]):
    return Window.partitionBy(*keys, "_seg").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of elements (a row for each key and range)."""
    n = elements.count()
    return rows.join(F.broadcast(elements) if n <= FEW * 10 else elements, [*keys, "_seg"])


def numbered(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = (), rows: int | None = None, to: str = "pos", longest: int | None = None) -> DataFrame:
    """df with the number of a row within its key, from 0; longest: how many rows a key has at most, if that is known."""
    if (longest is not None and longest <= (rows or SEGMENT)) or _long(df, keys, rows or SEGMENT) is None:
        return df.withColumn(to, (F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)) - 1).cast("long"))
    cut = segmented(df, keys, order, rows, ties)
    local = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(order, *ties))
    sizes = stored(cut.groupBy(*keys, "_seg").agg(F.count("*").alias("_n")))
    starts = stored(sizes.select(*keys, "_seg", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_start")))
    return _carried(cut, starts, keys).withColumn(to, (F.col("_start") + local - 1).cast("long")).drop("_seg", "_start")


def drawdown(df: DataFrame, keys: list[str], order: str, r: str = "r", ties: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """df with ``equity`` (compounded from 1), ``dd`` (equity over its peak so far, 1 at least, less 1) and ``under``: how many rows in a row it has been below a peak.

    A range's element is its product, the highest and lowest prefix product (the lowest for the case that a loss of more than
    all turns signs), and the length of what it ends with.
    """
    w = _within(keys, order, ties)
    # A return that is missing compounds nothing.
    local = segmented(df, keys, order, rows, ties).withColumn("_p", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(w))
    local = stored(local.withColumn("_hi", F.max("_p").over(w)).withColumn("_lo", F.min("_p").over(w)).withColumn("_k", F.count(F.lit(1)).over(w)))
    # The last row of a range has its product; the greatest count tells it.
    last = local.groupBy(*keys, "_seg").agg(F.max_by("_p", "_k").alias("p"), F.max("_hi").alias("hi"), F.min("_lo").alias("lo"))
    before = _before(keys)
    carry = last.withColumn("_c", F.coalesce(F.product("p").over(before), F.lit(1.0)))
    top = F.greatest(F.col("_c") * F.col("hi"), F.col("_c") * F.col("lo"))
    carry = stored(carry.withColumn("_top", F.greatest(F.coalesce(F.max(top).over(before), F.lit(1.0)), F.lit(1.0))).select(*keys, "_seg", "_c", "_top"))
    equity = F.col("_c") * F.col("_p")
    peak = F.greatest(F.col("_top"), F.col("_c") * F.when(F.col("_c") >= 0, F.col("_hi")).otherwise(F.col("_lo")))
    out = _carried(local, carry, keys).withColumn("equity", equity).withColumn("dd", F.col("equity") / peak - 1)
    # Rows since the last peak: the row's own number less that of the last row without a drawdown, in this range or before.
    at_peak = F.max(F.when(F.col("dd") >= 0, F.col("_k"))).over(w)
    out = stored(out.withColumn("_peak", at_peak).drop("_hi", "_lo", "_p", "_c", "_top"))
    ends = out.groupBy(*keys, "_seg").agg(F.max("_k").alias("n"), F.max("_peak").alias("peak"))
    total = F.coalesce(F.sum("n").over(before), F.lit(0))
    ends = ends.withColumn("_n", total)
    ends = stored(ends.select(*keys, "_seg", "_n", F.coalesce(F.max(F.col("_n") + F.col("peak")).over(before), F.lit(0)).alias("_last")))
    under = F.col("_n") + F.col("_k") - F.greatest(F.col("_last"), F.coalesce(F.col("_n") + F.col("_peak"), F.lit(0)))
    return _carried(out, ends, keys).withColumn("under", under.cast("long")).drop("_seg", "_k", "_peak", "_n", "_last")


def runs(df: DataFrame, keys: list[str], order: str, value: str, ties: tuple[str, ...] = (), rows: int | None = None, to: str = "run", pos: str | None = None) -> DataFrame:
    """df with the number of a row's maximal run of one value, from 1; nulls are a value. pos: a column for the row's own number within its key, from 0, if it is wanted."""
    w = Window.partitionBy(*keys, "_seg").orderBy(order, *ties)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    local = segmented(df, keys, order, rows, ties).withColumn("_r", F.sum(F.when(new, 1).otherwise(0)).over(_within(keys, order, ties))).withColumn("_k", F.count(F.lit(1)).over(_within(keys, order, ties)))
    local = stored(local)
    ends = local.groupBy(*keys, "_seg").agg(F.max("_k").alias("rows"), F.max("_r").alias("n"), F.min_by(F.struct(F.col(value).alias("v")), "_k").alias("first"), F.max_by(F.struct(F.col(value).alias("v")), "_k").alias("last"))
    along = Window.partitionBy(*keys).orderBy("_seg")
    # A range that goes on with the value of the one before shares a run with it.
    joined = F.when(F.col("first").eqNullSafe(F.lag("last").over(along)), 1).otherwise(0)
    ends = ends.withColumn("_j", joined)
    shift = F.coalesce(F.sum("n").over(_before(keys)), F.lit(0)) - F.sum("_j").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = stored(ends.select(*keys, "_seg", shift.alias("_shift"), F.coalesce(F.sum("rows").over(_before(keys)), F.lit(0)).alias("_start")))
    out = _carried(local, carry, keys).withColumn(to, (F.col("_r") + F.col("_shift")).cast("long"))
    if pos:
        out = out.withColumn(pos, (F.col("_start") + F.col("_k") - 1).cast("long"))
    return out.drop("_seg", "_r", "_k", "_shift", "_start")


class Machine:
    """A recursion with one state. ``element`` starts what a range is reduced to, ``absorb`` adds a row to it, ``then`` is the state after a range, ``step`` the state after a row and what is put out. Elements are lists of doubles."""

    def start(self) -> float | None:
        return None

    def element(self) -> list[float | None]:
        raise NotImplementedError

    def absorb(self, element: list[float | None], *row) -> list[float | None]:
        raise NotImplementedError

    def then(self, state: float | None, element: list[float | None]) -> float | None:
        raise NotImplementedError

    def step(self, state: float | None, *row) -> tuple[float | None, float | None]:
        raise NotImplementedError


class Ema(Machine):
    """Recursive average that the first value seeds. A range is the affine map s -> a s + b, and what it gives where nothing was before."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def element(self) -> list[float | None]:
        return [1.0, 0.0, None]

    def absorb(self, element, x):
        if x is None:
            return element
        a, b, own = element
        keep = 1.0 - self.alpha
        return [a * keep, b * keep + self.alpha * x, x if own is None else keep * own + self.alpha * x]

    def then(self, state, element):
        return element[2] if state is None else element[0] * state + element[1]

    def step(self, state, x):
        state = state if x is None else x if state is None else self.alpha * x + (1.0 - self.alpha) * state
        return state, state


class ThreeState(Machine):
    """-1 after z rose over entry until it falls under leave, 1 the other way round, else 0; 0 where z is missing, with the state kept. A range is the table of where it leads from each state."""

    def __init__(self, entry: float, leave: float):
        self.entry, self.leave = entry, leave

    def start(self) -> float:
        return 0.0

    def element(self) -> list[float]:
        return [-1.0, 0.0, 1.0]

    def absorb(self, element, z):
        return [self.step(s, z)[0] for s in element]

    def then(self, state, element):
        return element[int(state) + 1]

    def step(self, state, z):
        if z is None:
            return state, 0.0
        if state == 0:
            state = -1.0 if z > self.entry else 1.0 if z < -self.entry else 0.0
        elif (state < 0 and z < self.leave) or (state > 0 and z > -self.leave):
            state = 0.0
        return state, state


def machine(df: DataFrame, keys: list[str], order: str, values: list[str], how: Machine, ties: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """df with ``out``, what the machine puts out at each row. Two streams over the rows of a range: one reduces, one applies."""
    by = [*keys, "_seg"]
    long = _long(df, keys, rows or SEGMENT)
    cut = stored(_whole(df, keys, order, ties) if long is None else _cut(df, long, keys, order, rows or SEGMENT, ties))
    elements = stored(_reduced(cut, by, values, how))
    states = stored(_scanned(elements, keys, how))
    placed = _carried(cut, states, keys)
    if states.count() > FEW * 10:  # joined by a shuffle, not by a broadcast that leaves rows where they are
        placed = placed.repartition(*by).sortWithinPartitions(*by, order, *ties)
    return _applied(placed, by, values, how).drop("_seg", "_state")


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _types(df: DataFrame, names: list[str]) -> list[pa.DataType]:
    return [to_arrow_type(df.schema[c].dataType) for c in names]


def _reduced(rows: DataFrame, by: list[str], values: list[str], how: Machine) -> DataFrame:
    n, types = len(by), _types(rows, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, element = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:n]), zip(*columns[n:])):
                if key != at:
                    if at is not None:
                        yield out(at, element)
                    at, element = key, how.element()
                element = how.absorb(element, *row)
        if at is not None:
            yield out(at, element)

    def out(key: tuple, element: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([element], pa.list_(pa.float64()))], names=[*by, "element"])

    return rows.select(*by, *values).mapInArrow(run, f"{_fields(rows, by)}, element array<double>")


def _scanned(elements: DataFrame, keys: list[str], how: Machine) -> DataFrame:
    """The state before each range: a stream over one row for each range."""
    by = [*keys, "_seg"]
    n, types = len(keys), _types(elements, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for key, element in zip(zip(*columns[:n]), columns[-1]):
                if key != at:
                    at, state = key, how.start()
                out.append(state)
                state = how.then(state, element)
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(batch.columns, types)), pa.array(out, pa.float64())], names=[*by, "_state"])

    return elements.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, f"{_fields(elements, by)}, _state double")


def _applied(rows: DataFrame, by: list[str], values: list[str], how: Machine) -> DataFrame:
    names, n = rows.columns, len(by)
    types, first = _types(rows, names), [names.index(c) for c in [*by, "_state", *values]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            columns, out = [batch.column(i).to_pylist() for i in first], []
            for key, begin, row in zip(zip(*columns[:n]), columns[n], zip(*columns[n + 1 :])):
                if key != at:
                    at, state = key, begin
                state, shown = how.step(state, *row)
                out.append(shown)
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(batch.columns, types)), pa.array(out, pa.float64())], names=[*names, "out"])

    return rows.mapInArrow(run, f"{_fields(rows, names)}, out double")
