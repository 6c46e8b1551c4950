"""Mixing sources to target weights: weighted fair queueing of shuffled documents.

Every source gets a target: its share by weight of the total budget, at most
``max_epochs`` times its own size, with what that leaves over shared again by
weight. The documents of a source are shuffled (by the md5 of their id and text) and
queued once per epoch. A queued copy's virtual finish time is the number of
tokens of its source up to its end divided by the source's target; all copies
are ranged by it, and the mix takes them in that order until the budget is full.

A source with a third of all rows is no bottleneck: running sums are made within
buckets of about ``BUCKET`` documents, on top of the sums of the buckets before,
per source and again along virtual time. Null or equal ids are shuffled apart by
their texts. Only sizes go through shuffles, never texts; sources are counted before
their table is broadcast. Two windows have no key: one over bucket sums of running
sums, with a row for four million documents, and one over the partitions that rank
the sources, with a row for each.

Edge cases: null text has size 0; a document of size 0 is never taken. Null
sources are one source, which comes last. Rows equal in id and text are
interchangeable. Null ids are shuffled as the empty text, followed by their text.
Other columns are ignored by the query and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import save, table

WEIGHTS = (5, 2, 1)
#: Budget as a share of all sizes, and how often a document may be taken.
BUDGET, EPOCHS = 1.5, 2
BUCKET = 4096
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
FEW = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def running_before(sums: DataFrame, by: list[str], bucket: str, value: str, to: str) -> DataFrame:
    """sums (one row per by and bucket) with the sum of value in all buckets before, in two levels so that no window is long."""
    coarse = sums.withColumn("_coarse", F.floor(F.col(bucket) / 1024))
    over = coarse.groupBy(*by, "_coarse").agg(F.sum(value).alias("_sum"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    high = over.select(*by, "_coarse", F.coalesce(F.sum("_sum").over(before.partitionBy(*by).orderBy("_coarse")), F.lit(0)).alias("_high"))
    low = F.coalesce(F.sum(value).over(before.partitionBy(*by, "_coarse").orderBy(bucket)), F.lit(0))
    return coarse.withColumn("_low", low).join(high, [*by, "_coarse"]).select(*by, bucket, (F.col("_low") + F.col("_high")).alias(to))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size, n) with sid (their order, from 1), weight, budget and target.

    All sources start at the level that the budget allows. Those that are full below it leave some, which lifts the
    level of the others, until no further source is full; each round is one sum over the sources.
    """
    order = F.col("source").asc_nulls_last()
    ranked = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranked = save(ranked.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), "mix-ranked")
    # One row for each partition.
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranked.groupBy("_part").agg(F.count("*").alias("_rows")).select(F.col("_part").alias("_p"), before.alias("_before"))
    ranked = ranked.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn("sid", F.col("_before") + F.col("_nth") + 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    of = save(ranked.select("source", "source_size", "n", "sid", weight.alias("weight"), (F.col("source_size") * F.lit(float(epochs))).alias("full")), "mix-weights")
    total = float(of.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level, below = 0.0, -1
    while True:
        is_full = F.col("full") < level * F.col("weight")
        full, free, n = of.agg(F.sum(F.when(is_full, F.col("full"))), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if n == below or not free:
            level = level if free else float("inf")
            break
        level, below = (total - (full or 0.0)) / free, n
    share = F.lit(level) * F.col("weight")
    return of.select("source", "source_size", "n", "sid", "weight", F.lit(total).alias("budget"), F.least(F.col("full"), share).alias("target"))


def mix_sizes(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """rows (row, doc_id, source, size, key; row unique) with source_size, target, copies and taken."""
    sources = save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, budget, epochs), "mix-sources")
    few = sources.count() <= FEW
    known = rows.withColumnRenamed("source", "of")
    known = known.join(F.broadcast(sources) if few else sources, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    idle = (F.col("size") == 0) | (F.col("target") <= 0)
    queue = known.where(~idle)
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    queue = queue.withColumn("bucket", F.floor(part * F.ceil(F.col("n") / BUCKET)))
    before = running_before(queue.groupBy("sid", "bucket").agg(F.sum("size").alias("tokens")), ["sid"], "bucket", "tokens", "before")
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queue = queue.withColumn("inside", inside).join(before, ["sid", "bucket"])
    end = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("inside")
    copies = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("finish", end.cast("double") / F.col("target")).drop("before", "inside", "bucket", "n", "weight")
    # Tokens come evenly along virtual time, and the budget is full at about 1.
    each = F.ceil(F.lit(budget) * F.lit(rows.count()) / BUCKET)
    copies = save(copies.withColumn("slot", F.floor(F.col("finish") * each)), "mix-copies")
    earlier = running_before(copies.groupBy("slot").agg(F.sum("size").alias("tokens")), [], "slot", "tokens", "earlier")
    so_far = F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "sid", "key", "size", "row", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Whole slots before the one where the budget ends need no order, nor do those after it.
    cut = copies.join(earlier.where(F.col("earlier") <= _budget(sources)), "slot")
    taken = F.when(F.col("so_far") + F.col("earlier") <= F.col("budget"), 1).otherwise(0)
    chosen = cut.withColumn("so_far", so_far).withColumn("take", taken).groupBy("row").agg(F.sum("take").alias("copies")).where("copies > 0")
    out = known.join(chosen, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _budget(sources: DataFrame) -> float:
    found = sources.agg(F.max("budget")).first()[0]
    return float(found or 0.0)


def sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size and key of each document, written once, so that its row numbers stay."""
    return save(docs.select("doc_id", "source", _size().alias("size"), shuffle_key().alias("key")).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    """Orders the documents of a source."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: a row of docs for each copy that the mix takes."""
    chosen = mix_sizes(sizes(docs), **how)
    # Documents with equal id, text and source are equal to the mix: their copies are added up and dealt out evenly.
    chosen = chosen.groupBy("source", "key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")).where("_copies > 0")
    chosen = save(chosen.withColumnsRenamed({"source": "_s", "key": "_k"}), "mix-chosen")
    out = docs.withColumn("_key", shuffle_key()).join(chosen, (F.col("_key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")))
    often = lambda df, n: df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*docs.columns)
    once = often(out.where("_n = 1"), F.col("_copies"))
    if not chosen.where("_n > 1").limit(1).count():
        return once
    nth = F.row_number().over(Window.partitionBy("_k", "_s").orderBy(F.xxhash64(*docs.columns)))
    each = F.floor(F.col("_copies") / F.col("_n")) + F.when(nth <= F.col("_copies") % F.col("_n"), 1).otherwise(0)
    return once.unionByName(often(out.where("_n > 1").withColumn("_each", each).where("_each > 0"), F.col("_each")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))) AS k FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS full_size, (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, full_size / weight AS at_level,
    (budget - COALESCE(SUM(full_size) OVER (ORDER BY full_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY full_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
v AS (SELECT lev FROM l WHERE lev <= at_level ORDER BY at_level, sid LIMIT 1),
t AS (SELECT l.source, l.sid, l.source_size, l.budget, LEAST(l.full_size, v.lev * l.weight) AS target FROM l, v),
q AS (SELECT d.doc_id, d.size, d.k, t.sid, t.source_size, t.target, t.budget,
    SUM(d.size) OVER (PARTITION BY t.sid ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS ends
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.doc_id, q.size, q.sid, q.k, q.budget, e.epoch, (e.epoch * q.source_size + q.ends)::DOUBLE / q.target AS finish
  FROM q, (VALUES (0), (1)) e(epoch) WHERE q.size > 0 AND q.target > 0),
g AS (SELECT doc_id, size, budget, SUM(size) OVER (ORDER BY finish, sid, k, size, epoch ROWS UNBOUNDED PRECEDING) AS so_far FROM c),
m AS (SELECT doc_id, SUM(size) AS taken FROM g WHERE so_far <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(m.taken, 0)::BIGINT AS taken FROM q LEFT JOIN m ON q.doc_id = m.doc_id
"""
