r"""Ranked lexical search: exact top-k by dual-tree search.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``, A-Z lower-cased. N
counts the documents with a term, L all terms, n a document's; df and tf as usual. A term
weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and with m = 75 + (25 n N) div L a
document's coordinate for it is (1000000000 tf) div (1000 tf + 12 m). The score of a document for
an item is the sum over the item's terms, repeats included, of w times the coordinate.

1. One pass over the texts keeps, for each document, n and how often it has the terms
   of the items. Documents are packed into chunks (``ROWS`` and ``CELLS`` bound one), which are
   written; N, L and df are sums over them.
2. Items form a tree: they are ordered by their most common terms, and each inner node holds the
   greatest weight of each term in its items. The documents of a chunk form another: they are
   ordered by the item node that they fit best, and each inner node holds the maximum of each
   coordinate.
3. Both trees are searched together from their roots. The product of two nodes' maxima is a
   bound on all their pairs' scores; if it is below the weakest k-th score of the
   node's items, the whole batch goes. Leaves give exact 64-bit integer scores.
4. For each item, the chunk with the greatest bound at its root is searched first. The k-th scores
   which that gives are where the search of every other chunk begins, so few rows are left to
   rank at the end, however many documents there are.

Texts aren't shuffled and no document is left out but by a bound. The items' terms go to all
tasks: items are taken in slices of at most about ``ENTRIES`` (item, term) pairs, and each slice is
a search of its own, so a large set of items takes more passes, not more memory.

Edge cases: null and empty texts have no term; they count in no statistic and match nothing. Scores of 0
match nothing. Items equal in item_id and text are one item; other rows with the same item_id are items of
their own, ranked each. Documents with equal or null doc_id are documents each; null ids come last
among equal scores. Without documents or items there are no rows. Other columns are ignored.
m is exact for any size of table; scores wrap beyond 64 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import discard, save, ship, small_batches, table

K = 20
#: Documents of a chunk at most, and cells of its matrix (documents times distinct terms) unless one document has more.
ROWS, CELLS = 1024, 2_000_000
#: (item, term) pairs of a slice of items.
ENTRIES = 500_000
#: Children of a node of the document tree and of the item tree; item nodes that order a chunk's documents.
DOC_FAN, ITEM_FAN, GUIDES = 8, 4, 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in UTF-8. Every separator is one byte, which becomes a space; bytes.split() knows no others beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest kind that holds them, which the length tells."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(x) // n]).astype(np.int64) if n else np.empty(0, np.int64)


_CHUNK = "part int, no int, ids array<long>, entries long, totals binary, counts binary, terms binary, tfs binary, n long, docs long"


def chunks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Written chunks of documents (doc_id, text): ids, number of terms of each, and (term, tf) of the terms in the vocabulary.

    n and docs are sums over all documents of a chunk; those without a term of the vocabulary are in these sums only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, no = sent.value, 0
        held, seen, n, docs = [], set(), 0, 0
        for batch in small_batches(batches):
            for part, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms(text)
                found = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                if found and held:
                    distinct = len(seen) + sum(t not in seen for t, _ in found)
                    if len(held) == ROWS or (len(held) + 1) * distinct > CELLS:
                        yield out(held, n, docs, no)
                        held, seen, n, docs, no = [], set(), 0, 0, no + 1
                n, docs = n + len(words), docs + bool(words)
                if found:
                    seen.update(t for t, _ in found)
                    held.append((part, doc_id, len(words), found))
        if docs:
            yield out(held, n, docs, no)

    def out(held: list[tuple], n: int, docs: int, no: int) -> pa.RecordBatch:
        numbers = [np.array(x, np.int64) for x in ([h[2] for h in held], [len(h[3]) for h in held], [t for h in held for t, _ in h[3]], [c for h in held for _, c in h[3]])]
        columns = [[held[0][0] if held else -1], [no], [[h[1] for h in held]], [len(numbers[2])], *([_narrow(x)] for x in numbers), [n], [docs]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "no", "ids", "entries", "totals", "counts", "terms", "tfs", "n", "docs"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), "text")
    return save(rows.mapInArrow(run, _CHUNK), "ranked-chunks")


def statistics(packed: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L, and df of each term of the vocabulary: partial sums in the tasks, a row for each term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in small_batches(batches):
            for entries, found in zip(*(c.to_pylist() for c in batch.columns)):
                df += np.bincount(_wide(found, entries), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    n, docs = packed.agg(F.sum("n"), F.sum("docs")).first()
    found = packed.where("entries > 0").select("entries", "terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return docs or 0, n or 0, df


class Items:
    """The tree of a slice's items. A node is its terms (sorted) and their weights; node j of level d covers leaves j * ITEM_FAN**d onwards."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._join(below[i : i + ITEM_FAN]) for i in range(0, len(below), ITEM_FAN)])
        self.starts = np.cumsum([0, *(len(t) for t, _ in leaves)])[:-1]
        self.terms, self.weights = (np.concatenate(x) for x in zip(*leaves))

    @staticmethod
    def _join(nodes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in nodes]), return_inverse=True)
        most = np.zeros(len(terms), np.int64)
        np.maximum.at(most, at, np.concatenate([w for _, w in nodes]))
        return terms, most

    def leaves_of(self, level: int, node: int) -> slice:
        return slice(node * ITEM_FAN**level, (node + 1) * ITEM_FAN**level)

    def guides(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return next(level for level in self.levels if len(level) <= GUIDES)

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """A bound on each item's score over documents whose coordinates reach these maxima."""
        dense = np.zeros(max(int(self.terms.max()), int(terms.max(initial=0))) + 1, np.int64)
        dense[terms] = most
        return np.add.reduceat(self.weights * dense[self.terms], self.starts)


def weigh(n: int, df: np.ndarray) -> np.ndarray:
    """w of each term. math.log, as vectorized logarithms may round otherwise."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Documents:
    """The tree of a chunk: the distinct terms, and a matrix of coordinates (terms by documents) with its maxima level by level."""

    def __init__(self, row: dict, n: int, length: int, items: Items):
        totals, counts = _wide(row["totals"], len(row["ids"])), _wide(row["counts"], len(row["ids"]))
        at, tf = _wide(row["terms"], row["entries"]), _wide(row["tfs"], row["entries"])
        m = np.array([75 + 25 * t * n // length for t in totals.tolist()], np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        self.terms, of = np.unique(at, return_inverse=True)
        leaves = np.zeros((len(self.terms), len(counts)), np.int64)
        leaves[of, doc] = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        self.null = np.array([i is None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        fits = np.zeros((1, len(counts)), np.int64)
        for terms, weights in items.guides():
            rows, weights = self.rows(terms, weights)
            fits = np.concatenate([fits, (weights @ leaves[rows])[None]])
        order = np.lexsort((-fits.max(0), fits.argmax(0)))
        self.ids, self.null, leaves = self.ids[order], self.null[order], leaves[:, order]
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], DOC_FAN), axis=1))

    def rows(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix rows of those of the terms that the chunk has, and their weights."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = self.terms[at] == terms
        return at[has], weights[has]


class Best:
    """Each item's k best documents so far: (null, id, score) by falling score, then id, null ids last."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors, self.found = k, np.maximum(floors, 1), {}

    def add(self, item: int, null: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if item in self.found:
            null, ids, scores = (np.concatenate(x) for x in zip(self.found[item], (null, ids, scores)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.found[item] = null[order], ids[order], scores[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], scores[order[-1]])

    def batch(self) -> pa.RecordBatch:
        items = np.repeat(np.array(list(self.found), np.int64), [len(x[2]) for x in self.found.values()])
        null, ids, scores = (np.concatenate(x) for x in zip(*self.found.values()))
        return pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], names=["item", "doc_id", "score"])


def search(items: Items, docs: Documents, best: Best) -> None:
    """Both trees together, from the roots; a batch of node pairs goes when its bound is below the item node's weakest k-th score."""
    stack = [(len(items.levels) - 1, 0, len(docs.levels) - 1, np.arange(1))]
    while stack:
        level, node, height, columns = stack.pop()
        rows, weights = docs.rows(*items.levels[level][node])
        if not len(rows):
            continue
        bound = weights @ docs.levels[height][np.ix_(rows, columns)]
        keep = bound >= best.floors[items.leaves_of(level, node)].min()
        columns = columns[keep]
        if not len(columns):
            continue
        if level == height == 0:
            best.add(node, docs.null[columns], docs.ids[columns], bound[keep])
            continue
        if height:
            columns = (columns[:, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
            columns = columns[columns < docs.levels[height - 1].shape[1]]
        below = range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, len(items.levels[level - 1]))) if level else [node]
        stack += [(max(level - 1, 0), child, max(height - 1, 0), columns) for child in below]


_FOUND = "item long, doc_id long, score long"


def _found(packed: DataFrame, items: Items, floors: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """Each task's k best documents of each item, if they reach the item's floor."""
    sent = packed.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = sent.value
        best = Best(floors, k)
        for batch in small_batches(batches):
            for i in range(batch.num_rows):
                search(items, Documents(batch.slice(i, 1).to_pylist()[0], n, length, items), best)
        if best.found:
            yield best.batch()

    return packed.mapInArrow(run, _FOUND)


def _first_chunks(packed: DataFrame, items: Items, n: int, length: int) -> DataFrame:
    """part and no of the chunk with the greatest bound for each item: a row for each item at most."""
    sent = packed.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        most = np.zeros(len(items.starts), np.int64)
        at = np.zeros((len(most), 2), np.int32)
        for batch in small_batches(batches):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = Documents(row, n, length, items)
                bound = items.bounds(docs.terms, docs.levels[-1][:, 0])
                better = bound > most
                most[better], at[better] = bound[better], (row["part"], row["no"])
        have = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(most[have]), pa.array(at[have, 0]), pa.array(at[have, 1])], names=["item", "bound", "part", "no"])

    best = packed.mapInArrow(run, "item long, bound long, part int, no int").groupBy("item").agg(F.max(F.struct("bound", "part", "no")).alias("b"))
    return best.select("b.part", "b.no").distinct()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _slices(items: DataFrame) -> tuple[DataFrame, int]:
    """Written (item_id, terms, counts, slice) of the items that have terms, and the number of slices."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [Counter(terms(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "key", "terms", "counts"])

    once = items.select("item_id", "text").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    out = save(once.mapInArrow(run, f"item_id {kind}, key long, terms array<binary>, counts array<long>").where("size(terms) > 0"), "ranked-items")
    pairs = out.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-pairs // ENTRIES)
    return out.withColumn("slice", F.pmod("key", F.lit(max(1, n)))), n


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best of docs (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    every, n = _slices(items)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(n):
        part = every.where(F.col("slice") == number).orderBy("key", "item_id").collect()  # some ENTRIES pairs
        if part:
            out = out.unionByName(_of_slice(docs, part, kind, k))
    discard(every)
    return out


def _of_slice(docs: DataFrame, part: list, kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in part for w in r.terms}))}
    packed = chunks(docs, vocabulary)
    n, length, df = statistics(packed, len(vocabulary))
    weights = weigh(n, df)
    leaves = []
    for r in part:
        t = np.array([vocabulary[bytes(w)] for w in r.terms], np.int64)
        order = np.argsort(t)
        t, w = t[order], (np.array(r["counts"], np.int64) * weights[t])[order]
        leaves.append((t[w > 0], w[w > 0], r.item_id))
    leaves = sorted((x for x in leaves if len(x[0])), key=lambda x: sorted((-int(df[t]), int(t)) for t in x[0])[:4])
    have = packed.where("entries > 0")
    if not leaves or not have.limit(1).count():
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    items = Items([x[:2] for x in leaves])
    first = save(_first_chunks(have, items, n, length), "ranked-first")
    seeds = _found(have.join(F.broadcast(first), ["part", "no"], "left_semi"), items, np.zeros(len(leaves), np.int64), n, length, k)
    seeds = save(_ranked(seeds, k), "ranked-seeds")
    floors = np.zeros(len(leaves), np.int64)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():
        floors[r.item] = r.score
    rest = _found(have.join(F.broadcast(first), ["part", "no"], "left_anti"), items, floors, n, length, k)
    best = save(_ranked(seeds.drop("rank").unionByName(rest), k), "ranked-best")
    discard(packed, first, seeds)
    names = spark.createDataFrame([(i, x[2]) for i, x in enumerate(leaves)], f"item long, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (SELECT row_id, doc_id, term, COUNT(*)::BIGINT AS tf FROM (
    SELECT row_number() OVER () AS row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents)
  GROUP BY row_id, doc_id, term),
d AS (SELECT row_id, doc_id, SUM(tf)::BIGINT AS n FROM t GROUP BY row_id, doc_id),
s AS (SELECT COUNT(*)::BIGINT AS docs, SUM(n)::BIGINT AS total FROM d),
m AS (SELECT row_id, doc_id, 75 + ((25 * n * docs) // total) AS m FROM d, s),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, COUNT(*)::BIGINT AS df FROM t GROUP BY term), s),
c AS (SELECT q.item_id, q.text, t.row_id, t.doc_id, SUM(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY q.item_id, q.text, t.row_id, t.doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
