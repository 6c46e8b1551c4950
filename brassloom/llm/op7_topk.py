"""Exact top-k search by inner product: norm buckets with local pruning.

Vectors become integers (floor of ``SCALE`` times each component, in double
precision). Candidates are ranged by falling length and cut into blocks of up to
``BLOCK`` vectors, each with its greatest length; queries into blocks of up to
``QUERIES``. Every query first meets the ``SEEDS`` blocks of the longest vectors,
which give it a first k-th best score. From then on a block has, for a query, a local
cosine threshold: k-th best score / (query's length * block's greatest length).

* Above 1, nothing in the block can matter: the block is left out.
* From ``STEEP`` on, coordinate pruning: a vector with that cosine must have each
  of the query's largest coordinates in a range around the query's own.
* Below, length pruning: the block's vectors are sorted by length, and only
  those that are long enough are looked at.

Whatever passes is verified with exact integer products; pruning has a margin for
rounding and keeps equal scores, so results are exact. Query blocks meet
candidate blocks by an equi-join on groups of blocks; a query block is sent to those
groups only whose longest vector is long enough for one of its queries, and each
query is pruned by its own floor in every block that it meets. The query set is the stated one (every ``EVERY``-th id).

Blocks hold the smallest kind of integer that their values fit in.

Edge cases: a vector that is null, empty, or holds a null, NaN or infinite
component takes no part. Vectors of different length are compared on the
components both have. Rows with the query's own vec_id are not its candidates;
other repeated rows are candidates each, in rank order. A query row that is repeated,
vector and all, is one query; rows of one vec_id with other vectors are queries of their
own, ranked each. Null vec_ids are neither queries nor candidates. With too few
candidates there are fewer ranks. Products beyond 64 bits wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import FEW_IDS, save, ship, small_batches, table
from brassloom.llm.op8_jaccard import groups

SCALE, K, EVERY = 1024, 10, 100
BLOCK, QUERIES, SEEDS = 4096, 512, 4
STEEP, COORDINATES = 0.5, 4
#: Candidate blocks that share a join key.
GROUP = 16
_BLOCKS = "part int, block int, low double, high double, dims int, ids binary, values binary"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) and its length, of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each partition as blocks: ids and a matrix (int64, row by row, shorter vectors filled up with 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block = 0
        for batch in small_batches(batches):
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            while len(held) >= size:
                yield out(held[:size], block)
                held, block = held[size:], block + 1
        if held:
            yield out(held, block)

    def out(rows: list[tuple], block: int) -> pa.RecordBatch:
        dims = max(len(r[2]) for r in rows)
        m = np.zeros((len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            m[i, : len(r[2])] = r[2]
        ids = np.array([r[1] for r in rows], np.int64)
        lengths = [r[3] for r in rows]
        low, high = int(m.min()), int(m.max())
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        columns = [[rows[0][0]], [block], [min(lengths)], [max(lengths)], [dims], [ids.tobytes()], [m.astype(kind).tobytes()]]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "block", "low", "high", "dims", "ids", "values"])

    return rows.select(F.spark_partition_id().alias("part"), "vec_id", "v", "length").mapInArrow(run, _BLOCKS)


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Written blocks, by falling length, with a number of their own."""
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // (size * 4))), F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id")
    packed = save(_pack(ranged, size), name)
    # Only a few bytes a block are numbered in one window; the vectors stay where they were written.
    along = Window.partitionBy(F.lit(0)).orderBy(F.col("high").desc(), "part", "block")
    numbers = save(packed.select("part", "block", (F.row_number().over(along) - 1).alias("no")), f"{name}-numbers")
    few = numbers.count() <= FEW_IDS
    return packed.join(F.broadcast(numbers) if few else numbers, ["part", "block"])


def _unpack(ids: bytes, values: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(values) // (len(rows) * dims)]
    return rows, np.frombuffer(values, kind).astype(np.int64).reshape(-1, dims)


def best_of(q_ids, q, c_ids, c, floor: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query's row, vec_id, score) of the up to k best candidates of each query that reach its floor."""
    dims = min(q.shape[1], c.shape[1])
    q, c = q[:, :dims], c[:, :dims]
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    q_len, c_len = np.sqrt((qf**2).sum(1)), np.sqrt((cf**2).sum(1))
    exact = bool(len(c)) and bool(len(q)) and float(np.abs(qf).max()) * float(np.abs(cf).max()) * max(dims, 1) < 2.0**53
    order = np.argsort(-c_len, kind="stable")
    c, cf, c_ids, c_len = c[order], cf[order], c_ids[order], c_len[order]
    unit = cf / np.maximum(c_len, 1e-300)[:, None]
    out = []
    for i in range(len(q)):
        need = floor[i] * (1 - 1e-9) - 1e-6 if floor[i] > 0 else floor[i] * (1 + 1e-9) - 1e-6
        at = np.arange(len(c))
        if need > 0 and len(c):
            if q_len[i] == 0:
                continue
            local = need / (q_len[i] * c_len[0]) if c_len[0] > 0 else np.inf
            if local > 1 + 1e-9:
                continue
            if local >= STEEP:
                u = qf[i] / q_len[i]
                good = np.ones(len(c), bool)
                for f in np.argsort(-np.abs(u))[:COORDINATES]:
                    spread = np.sqrt(max(0.0, (1 - local**2) * (1 - u[f] ** 2))) + 1e-9
                    good &= (unit[:, f] >= u[f] * local - spread) if u[f] >= 0 else (unit[:, f] <= u[f] * local + spread)
                at = np.flatnonzero(good)
            else:
                at = at[: np.searchsorted(-c_len, -(need / q_len[i]) + 1e-6 * c_len[0], side="right")]
        score = (cf[at] @ qf[i]).astype(np.int64) if exact else c[at] @ q[i]
        keep = (c_ids[at] != q_ids[i]) & (score >= floor[i])
        at, score = at[keep], score[keep]
        if len(at) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
        ranks = np.lexsort((c_ids[at], -score))[:k]
        out += [(i, int(c_ids[at[r]]), int(score[r])) for r in ranks]
    return out


def _scores(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, q_no and q_row (the query's block and row), vec_id and score of the best of each pair of blocks (q_no, q_dims, q_ids, q_values, floors, dims, ids, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                q_ids, q = _unpack(row["q_ids"], row["q_values"], row["q_dims"])
                c_ids, c = _unpack(row["ids"], row["values"], row["dims"])
                floor = np.frombuffer(row["floors"], np.float64)
                found = best_of(q_ids, q, c_ids, c, floor, k)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(q_ids[i]) for i, _, _ in found], pa.int64()), pa.array([row["q_no"]] * len(found), pa.int32()), pa.array([i for i, _, _ in found], pa.int32()), pa.array([v for _, v, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())],
                        names=["query_id", "q_no", "q_row", "vec_id", "score"],
                    )

    return pairs.select("q_no", "q_dims", "q_ids", "q_values", "floors", "dims", "ids", "values").mapInArrow(run, "query_id long, q_no int, q_row int, vec_id long, score long")


def _with_floors(queries: DataFrame, scored: DataFrame, k: int, highs: np.ndarray) -> DataFrame:
    """Query blocks with each query's k-th best score so far, the least length at which a vector may reach one of them, and how many groups (highs: their greatest lengths, falling) may hold one."""
    kept = queries.select("q_no", F.lit(1).alias("side"), F.lit(None).cast("int").alias("q_row"), F.lit(None).cast("long").alias("score"), "q_dims", "q_ids", "q_values")
    found = scored.select("q_no", F.lit(0).alias("side"), "q_row", "score", F.lit(None).cast("int").alias("q_dims"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 1):
            best: dict[int, list[int]] = {}
            for r in rows:
                if r[1] == 0:
                    best.setdefault(r[2], []).append(r[3])
            for r in rows:
                if r[1]:
                    ids, q = _unpack(r[5], r[6], r[4])
                    floors = np.array([sorted(best[i])[-k] if len(best.get(i, ())) >= k else -np.inf for i in range(len(ids))], np.float64)
                    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                    least = float(np.min(np.where(floors > 0, floors / np.maximum(length, 1e-300), 0.0))) * (1 - 1e-6)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), pa.array([r[4]], pa.int32()), pa.array([r[5]], pa.binary()), pa.array([r[6]], pa.binary()), pa.array([floors.tobytes()], pa.binary()), pa.array([least]), pa.array([np.searchsorted(-highs, -least, side="right")], pa.int32())], names=["q_no", "q_dims", "q_ids", "q_values", "floors", "least", "groups"])

    rows = kept.unionByName(found).repartition("q_no").sortWithinPartitions("q_no", "side")
    return rows.mapInArrow(run, "q_no int, q_dims int, q_ids binary, q_values binary, floors binary, least double, groups int")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each query."""
    ship(vectors.sparkSession)
    rows = quantized(vectors, scale)
    candidates = save(blocks(rows, BLOCK, "topk-packed"), "topk-candidates")
    queries = blocks(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), QUERIES, "topk-queries")
    queries = save(queries.select(F.col("no").alias("q_no"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")), "topk-query-blocks")
    # SEEDS blocks of at most BLOCK vectors, whatever the input.
    longest = candidates.where(F.col("no") < SEEDS).select("no", "dims", "ids", "values")
    first = F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))
    none = _with_floors(queries, queries.limit(0).select("q_no", F.lit(0).alias("q_row"), F.lit(0).cast("long").alias("score")), k, np.empty(0))
    seeds = save(_scores(none.withColumn("no", first).join(F.broadcast(longest), "no"), k), "topk-seeds")
    of = candidates.where(F.col("no") >= SEEDS).withColumn("group", F.floor((F.col("no") - SEEDS) / GROUP).cast("int"))
    # A number for each GROUP * BLOCK vectors.
    highs = np.array([r.high for r in of.groupBy("group").agg(F.max("high").alias("high")).orderBy("group").collect()])
    scored = seeds
    if len(highs):
        ready = _with_floors(queries, seeds, k, highs).where("groups > 0")
        meets = ready.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).join(of, "group").where("high >= least")
        scored = seeds.unionByName(_scores(meets, k))
    rank = F.row_number().over(Window.partitionBy("q_no", "q_row").orderBy(F.col("score").desc(), "vec_id"))
    return scored.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM f),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
p AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
