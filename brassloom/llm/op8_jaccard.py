r"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct 3-word shingles. Two documents
link when their sets' Jaccard similarity reaches the threshold (``PERCENT``).

1. Equal sets are one set from here on; a document joins through its set.
2. The tree's upper levels are size range, slice number and slice content. Two
   sets of up to m elements link only if they differ in at most 2 m (1-t)/(1+t)
   elements. Cut into more slices than that by their elements' hashes, they
   agree in a whole slice at least: sets that share no (size range, slice,
   content) key can't link. Each size range overlaps the next by what sizes of
   linked sets may differ. Some slices more than needed let empty slices go
   without a key.
   Shingles that a sample of documents, which grows with them, finds in several of them (a
   passage that many documents quote) would make slices agree by themselves.
   Slices leave them out, which takes nothing from the argument, unless they are
   over half of a set; such sets are sliced whole. Sets that may link with sets
   of either kind are sliced both ways, so the sample bears on speed alone.
3. Sets that share a key, directly or over others, form a cluster.
4. A cluster of up to ``CHUNK`` sets is one signature tree. Each node holds the
   OR of its sets' token bitmaps and the range of their sizes. The tree is
   traversed against itself, level by level; a pair of nodes goes when its sizes
   can't fit or the greatest possible overlap - common bits, plus what elements
   may share a bit - is too small. What is left of pairs is verified exactly.
5. Larger clusters (a third of all documents may be near copies of one) are cut
   into chunks. Each set is first verified against the smallest set with which
   it shares a key; what this links needs no further look. Then trees of chunks
   are traversed against one another, but for chunks that are linked already.
6. Texts that quote the same passages chain into clusters that grow with the input,
   where chunks that all meet would move every set as often as there are chunks. A
   cluster of more than ``WIDE`` chunks is taken apart before: sets that link share
   one of their few rarest elements (so many that the others are too few for a
   link), and sets that share one are joined if their bitmaps differ by little
   enough. A bitmap goes along with each of these elements, so what is moved grows
   with the sets.

Only components are asked for, so a pair inside one component isn't verified.
The result is exact up to collisions of 64-bit hashes.

Edge cases: null and empty texts, and those of white space only, have no shingle
and link with nothing; texts of one or two words have one shingle, the whole
sequence. Null doc_ids count in no component's minimum, but links run through them as
through any other document; a component without any other has a null component_id.
Rows with the same doc_id are separate documents and repeated rows are copies of one
another. Extra columns are ignored, whatever their names. Tables written on the way
are deleted when nothing reads them any more.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.llm.common import FEW_IDS, cached, discard, save, ship, small_batches, table, text_or_empty
from brassloom.llm.components import components

WORDS, PERCENT = 3, 90
#: The sample that finds common shingles: documents at least, and their share of all; in how many of them a shingle is common, and how many are kept.
SAMPLE, SHARE, COMMON, KEPT = 20_000, 0.01, 3, 1_000_000
#: Sets, and elements of their sets, that one tree may hold.
CHUNK, ELEMENTS = 512, 1_000_000
#: Chunks of a cluster beyond which it is taken apart first, and bits of a set's bitmap there at most.
WIDE, BITS = 8, 8192
REMEMBER = 200_000
#: Keys that a task gathers before it hands them on.
FLUSH = 1_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """A 64-bit hash of each word that this worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_words = _Words()
cached("words", _words.clear)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles. bytes.lower() changes A-Z and bytes.split() cuts at ``[\\x20\\x09-\\x0D]``, neither more."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _scramble((out ^ h[k : len(h) - n + 1 + k]) * _MIX[k % 3])
    return np.unique(out)


def size_ranges(percent: int) -> list[int]:
    """Where size ranges begin: each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] + max(1, out[-1] // 2))
    return out


def slice_keys(s: np.ndarray, percent: int, ranges: list[int], common: np.ndarray) -> np.ndarray:
    """The keys of a set: in its own size range, and in the next if a set of that size may link with it."""
    n, out = len(s), []
    at = bisect_right(ranges, n) - 1
    rare = s
    if len(common):
        rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    # A set of which a greater part than this is rare links with sets only of which half is.
    sure = (50 + (100 - percent)) / percent
    ways = ([rare] if 2 * len(rare) >= n else []) + ([s] if len(rare) <= sure * n and len(rare) < n else [])
    for j in (at, at + 1):
        if j > at and 100 * n < percent * ranges[j]:
            continue
        most = ranges[j + 1] - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only equal sets can link
        spare = 2 + differ * (100 - percent) // 80
        k = differ + 1 + spare
        for way in ways or [s]:
            part = ((way >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, mixed = part[order], _scramble(way[order] ^ _MIX[0])
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            content, slices = np.add.reduceat(mixed, starts), part[starts]
            if k - len(starts) > spare:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), slices)
                content, slices = np.r_[content, np.zeros(len(empty), np.uint64)], np.r_[slices, empty]
            out.append(_scramble(content ^ _scramble(slices * _MIX[1] + np.uint64(2 * j + (way is s and len(rare) < n)))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of several documents in a sample of different texts, the KEPT most frequent of them, sorted."""
    part = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            found = [shingles(x, size).view(np.int64) for x in batch.column(0).to_pylist()]
            flat = np.concatenate([*found, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["h"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(part * (1 << 30))).select("text")
    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.col("n").desc(), "h").limit(KEPT).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (a hash of id and text), n and sid (a hash of the whole set; null if empty) of each document, written."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            found = [shingles(x, size) for x in batch.column(2).to_pylist()]
            sid = [_sid(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array(sid, pa.int64())], names=["doc_id", "key", "n", "sid"])

    return save(docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n long, sid long"), "jaccard-sets")


def row_key() -> Column:
    """Never null; equal for rows that are equal in id and text."""
    return F.xxhash64("doc_id", text_or_empty())


#: What stands for a set where keys meet: its hash's last 40 bits. Sets that share them are one more pair to verify.
SHORT = (1 << 40) - 1


def key_rows(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """Keys of many sets by bucket, packed (five bytes of a key, five of its set); pairs of sets that met on the way have no bucket.

    A key that many sets of one task share goes on once only, so a hot key is as good as gone before the shuffle.
    """
    buckets = max(1024, docs.count() // 32_768)
    sent = docs.sparkSession.sparkContext.broadcast(common)  # KEPT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, held, many = size_ranges(percent), [], 0
        for batch in small_batches(batches, "words"):
            for text in batch.column(0).to_pylist():
                s = shingles(text, size)
                if len(s):
                    held.append((slice_keys(s, percent, ranges, sent.value), _sid(s) & SHORT))
                    many += len(held[-1][0])
                if many >= FLUSH:
                    yield out(packed(held, buckets))
                    held, many = [], 0
        if many:
            yield out(packed(held, buckets))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary()])], names=["bucket", "x", "y"])

    return docs.select("text").mapInArrow(run, "bucket long, x binary, y binary")


def _five(x: np.ndarray) -> bytes:
    """The last five bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def packed(held: list[tuple[np.ndarray, int]], buckets: int) -> list[tuple]:
    """(bucket, x, y): the keys by bucket, and in a row without one the pairs found on the way."""
    keys = np.concatenate([k for k, _ in held])
    sids = np.repeat(np.array([s for _, s in held], np.int64), [len(k) for k, _ in held])
    keys, sids, pairs = hubs(keys, sids)
    out: list[tuple] = [(None, _five(pairs[0]), _five(pairs[1]))] if len(pairs[0]) else []
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    # A bucket's keys share their first bits, so the last five bytes tell them apart.
    return out + [(int(at[i]), _five(keys[i:j]), _five(sids[i:j])) for i, j in zip(cuts, cuts[1:]) if j > i]


def hubs(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys in order with their smallest set, and the distinct pairs of that set and the others."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    hub = np.repeat(sids[first], np.diff(np.r_[first, len(keys)]))
    other = hub != sids
    pairs = np.unique(np.stack([hub[other], sids[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return keys[first], sids[first], (pairs[:, 0], pairs[:, 1])


def key_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of short set numbers that share a key, each set with the smallest of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            x, y = (np.concatenate([_numbers(r[k]) for r in group]) for k in (1, 2))
            a, b = (x.view(np.int64), y.view(np.int64)) if group[0][0] is None else hubs(x, y.view(np.int64))[2]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # Pairs that have met already are spread over all tasks, one row at a time.
    spread = F.coalesce("bucket", F.xxhash64("x"))
    return rows.repartition(spread).sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def _full(pairs: DataFrame, once: DataFrame) -> DataFrame:
    """Pairs of short numbers as pairs (a, b) of sets."""
    short = once.select("sid", F.col("sid").bitwiseAND(SHORT).alias("k"))
    p = pairs.join(short.select(F.col("sid").alias("a_"), F.col("k").alias("a")), "a").join(short.select(F.col("sid").alias("b_"), F.col("k").alias("b")), "b")
    return p.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).where("a <> b")


def _sid(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= FEW_IDS else df


class Tree:
    """A signature tree over sets: levels of nodes, each with OR-combined bitmaps, size range, slack and component."""

    FAN = 4

    def __init__(self, sets: list[np.ndarray], comp: np.ndarray, width: int):
        self.sets = sets
        n = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for row, s in zip(bits, sets):
            flags = np.zeros(width, np.uint8)
            flags[(s & np.uint64(width - 1)).astype(np.int64)] = 1
            row[:] = np.packbits(flags)
        bits = bits.view(np.uint64)
        # slack: elements that fell on a bit another one has set already
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1).astype(np.int64), comp)]
        while len(self.levels[-1][1]) > self.FAN:
            bits, low, high, slack, comp = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            one, other = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.where(one == other, one, -1)))


def width_for(*groups: list[np.ndarray]) -> int:
    most = max((len(s) for g in groups for s in g), default=1)
    return max(64, 1 << int(2 * most - 1).bit_length())


def traverse(a: Tree, b: Tree, percent: int, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the trees' nodes don't exclude, in parts of bounded size."""
    depth = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    i, j = np.meshgrid(np.arange(len(level(a, depth)[1])), np.arange(len(level(b, depth)[1])), indexing="ij")
    stack = [(depth, i.ravel(), j.ravel())]
    while stack:
        d, i, j = stack.pop()
        (bits, low, high, slack, comp), (bits2, low2, high2, slack2, comp2) = level(a, d), level(b, d)
        most = max(1, (1 << 22) // bits.shape[1])
        if len(i) > most:
            stack += [(d, i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)]
            continue
        fits = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i]) & ((comp[i] != comp2[j]) | (comp[i] < 0))
        if itself:
            fits &= (i < j) if d == 0 else (i <= j)
        i, j = i[fits], j[fits]
        overlap = np.bitwise_count(bits[i] & bits2[j]).sum(1).astype(np.int64) + np.minimum(slack[i], slack2[j])
        overlap = np.minimum(overlap, np.minimum(high[i], high2[j]))
        fits = (100 + percent) * overlap >= percent * (low[i] + low2[j])
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if d == 0:
            yield i, j
            continue
        i, j = _children(i, len(level(a, d - 1)[1]), d < len(a.levels)), _children(j, len(level(b, d - 1)[1]), d < len(b.levels))
        x, y = np.repeat(i, j.shape[1], axis=1), np.tile(j, (1, i.shape[1]))
        real = (x >= 0) & (y >= 0)
        stack.append((d - 1, x[real], y[real]))


def _children(nodes: np.ndarray, below: int, inner: bool) -> np.ndarray:
    """A row of children for each node, -1 where there is none; a tree without a level there has the node itself."""
    if not inner:
        return nodes[:, None]
    out = nodes[:, None] * Tree.FAN + np.arange(Tree.FAN)
    return np.where(out < below, out, -1)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def links_of(sets: list[np.ndarray], other: list[np.ndarray], comp: np.ndarray, comp2: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning set of links between sets (and other; their numbers follow), as far as components don't join them already."""
    itself = not other
    width = width_for(sets, other)
    a = Tree(sets, comp, width)
    b = a if itself else Tree(other, comp2, width)
    every = sets + other
    of, out = _Union(len(every)), []
    known: dict[int, int] = {}
    for k, c in enumerate([*comp.tolist(), *comp2.tolist()]):
        if c >= 0 and known.setdefault(c, k) != k:
            of.up[k] = of.find(known[c])
    shift = 0 if itself else len(sets)
    for i, j in traverse(a, b, percent, itself):
        for x, y in zip(i.tolist(), (j + shift).tolist()):
            p, q = of.find(x), of.find(y)
            if p != q and linked(every[x], every[y], percent):
                of.up[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of batches that are sorted by their first columns, by equal keys."""
    held, at = [], None
    for batch in small_batches(batches, "words"):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield held
                held, at = [], row[:keys]
            held.append(row)
    if held:
        yield held


def _order(rows: list[tuple], at: int) -> list[tuple]:
    """Similar sets side by side: by size, then by least element."""
    return sorted(rows, key=lambda r: (len(r[at]), r[at][:8]))


def _links_in(grouped: DataFrame, by: list[str], percent: int, labels: bool = False) -> DataFrame:
    """Links (a, b) in each group of rows (by..., side, sid, comp, elements); sides 0 and 1 are compared, or side 0 with itself.

    labels: a row (a: the smallest set linked, b: the set) for each set of the group instead, where groups are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by)
        for rows in groups(batches, k):
            sides = [_order([r for r in rows if r[k] == side], k + 3) for side in (0, 1)]
            sets = [[np.frombuffer(r[k + 3], np.uint64) for r in side] for side in sides]
            sids = [r[k + 1] for side in sides for r in side]
            # Components go by numbers from 0, as -1 stands for none in common.
            names = {c: i for i, c in enumerate(sorted({r[k + 2] for r in rows}))}
            comp = [np.array([names[r[k + 2]] for r in side], np.int64) for side in sides]
            found = links_of(sets[0], sets[1], comp[0], comp[1], percent)
            if labels:
                of = _Union(len(sids))
                for x, y in found:
                    of.up[of.find(x)] = of.find(y)
                least: dict[int, int] = {}
                for x, sid in enumerate(sids):
                    least[of.find(x)] = min(sid, least.get(of.find(x), sid))
                a, b = [least[of.find(x)] for x in range(len(sids))], sids
            else:
                a, b = [sids[x] for x, _ in found], [sids[y] for _, y in found]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = grouped.select(*by, "side", "sid", "comp", "elements").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, "a long, b long")


def _elements(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sid, cluster, n and elements (sorted hashes as bytes) of the wanted sets (key: a document that has the set, named: whether it has a doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            found = [shingles(x, size) for x in batch.column(0).to_pylist()]
            sid = batch.column(1).to_pylist()
            same = pa.array([_sid(s) == k for s, k in zip(found, sid)])
            out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "cluster", "n", "elements"])
            yield out.filter(same)

    texts = docs.select("text", row_key().alias("of"))
    pick = lambda of, some: of.join(_small(some.select("sid", "cluster", "key")), F.col("of") == F.col("key")).select("text", "sid", "cluster")
    nameless = wanted.where("NOT named")
    if not nameless.limit(1).count():
        rows = pick(texts, wanted)
    else:
        # Of the copies of a text without a doc_id, one will do.
        found = texts.join(_small(nameless.select(F.col("key").alias("of")).distinct()), "of", "left_semi").dropDuplicates(["of"])
        rows = pick(texts, wanted.where("named")).unionByName(pick(found, nameless))
    return rows.mapInArrow(run, "sid long, cluster long, n long, elements binary")


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id long, text string)."""
    sets = shingle_sets(docs, size)
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.col("key")))
    once = save(sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first"), F.coalesce(named, F.min("key")).alias("key"), F.count("*").alias("copies")), "jaccard-once")
    short = save(key_pairs(key_rows(docs, size, percent, common_shingles(docs, size))), "jaccard-short")
    pairs = save(_full(short, once), "jaccard-pairs")
    cluster = components(pairs, "jaccard-cluster").select(F.col("node").alias("sid"), F.col("label").alias("cluster"))
    wanted = save(cluster.join(once, "sid").select("sid", "cluster", "key", F.col("first").isNotNull().alias("named")), "jaccard-wanted")
    members = save(_elements(docs, wanted, size), "jaccard-elements")
    labels = save(_cluster_labels(members, pairs, percent), "jaccard-labels")
    discard(short, pairs, wanted, members)
    # Only sets that have copies or links need to be looked up; any other document is its own component.
    joined = once.join(labels, "sid", "left").where("copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "sid"))
    least = joined.groupBy("label").agg(F.min("first").alias("component"))
    found = save(joined.join(least, "label").select(F.col("sid").alias("_sid"), "component").distinct(), "jaccard-components")
    discard(once, labels)
    out = sets.join(_small(found), F.col("sid") == F.col("_sid"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _cluster_labels(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """sid, label: the smallest set of each linked set's component."""
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / ELEMENTS))
    over = save(members.groupBy("cluster").agg(chunks.alias("chunks")).where("chunks > 1"), "jaccard-large")
    rows = members.withColumn("side", F.lit(0)).withColumn("comp", F.col("sid"))
    named = lambda df, a, b: df.select(F.col(b).alias("sid"), F.col(a).alias("label"))
    if not over.limit(1).count():
        return named(save(_links_in(rows, ["cluster"], percent, True), "jaccard-found"), "a", "b").distinct()
    small = save(_links_in(rows.join(_small(over), "cluster", "left_anti"), ["cluster"], percent, True), "jaccard-found")
    inside = members.join(_small(over), "cluster")
    large = components(_large_links(inside, pairs, percent), "jaccard-links")
    return named(small, "a", "b").unionByName(named(large, "label", "node")).distinct()


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(good)

    one = members.select(F.col("sid").alias("a"), F.col("elements").alias("x"))
    other = members.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
    return pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _large_links(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links of clusters of several chunks; members have how many."""
    members = save(members, "jaccard-members")
    wide = members.where(F.col("chunks") > WIDE)
    if wide.limit(1).count():
        apart = components(_candidates(wide, percent), "jaccard-apart").select(F.col("node").alias("sid"), F.col("label").alias("part_of"))
        # A set without a candidate links with nothing.
        parts = wide.join(apart, "sid").withColumn("cluster", F.col("part_of")).select(*members.columns)
        whole, members = members, save(members.where(F.col("chunks") <= WIDE).unionByName(parts), "jaccard-known")
        discard(whole)
        one, other = (members.select(F.col("sid").alias(k), F.col("cluster").alias(f"of_{k}")) for k in "ab")
        pairs = save(pairs.join(one, "a").join(other, "b").where("of_a = of_b").select("a", "b"), "jaccard-pairs")
    members = members.drop("chunks")
    star = save(_verified(pairs, members, percent), "jaccard-star")
    comps = components(star, "jaccard-star").select(F.col("node").alias("sid"), F.col("label").alias("comp"))
    known = members.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    placed, meets = _meetings(known)
    columns = ["cluster", "c1", "c2", "side", "sid", "comp", "elements"]
    first = placed.join(meets, (F.col("cluster") == F.col("of")) & (F.col("chunk") == F.col("c1"))).withColumn("side", F.lit(0)).select(*columns)
    second = placed.join(meets.where("c1 <> c2"), (F.col("cluster") == F.col("of")) & (F.col("chunk") == F.col("c2"))).withColumn("side", F.lit(1)).select(*columns)
    found = save(_links_in(first.unionByName(second), ["cluster", "c1", "c2"], percent), "jaccard-chunks")
    return star.unionByName(found)


def _meetings(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets with their chunk, and which chunks (c1, c2) of a cluster (of) are to be compared."""
    each = known.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
    # A large component has chunks of its own; small ones share theirs with others.
    solo = F.col("m") >= CHUNK // 4
    own = each.select("cluster", "comp", "m", "e", solo.alias("solo"), F.when(solo, F.col("comp")).otherwise(F.lit(0)).alias("pool"))
    parts = own.groupBy("cluster", "solo", "pool").agg(F.greatest(F.ceil(F.sum("m") / CHUNK), F.ceil(F.sum("e") / ELEMENTS)).alias("parts"))
    own = save(own.join(parts, ["cluster", "solo", "pool"]).select("cluster", "comp", "solo", "pool", "parts"), "jaccard-pools")
    placed = known.join(own, ["cluster", "comp"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    placed = save(placed.withColumn("chunk", F.xxhash64("solo", "pool", "part")), "jaccard-placed")
    chunks = save(placed.select("cluster", "chunk", "solo", "pool").distinct(), "jaccard-chunk-list")
    left, right = chunks.toDF("cluster", "c1", "s1", "p1"), chunks.toDF("cluster", "c2", "s2", "p2")
    # Chunks of one component need no comparison. What is left grows with the chunks that hold other components.
    meets = left.join(right, "cluster").where("c1 <= c2 AND NOT (s1 AND s2 AND p1 = p2)").select(F.col("cluster").alias("of"), "c1", "c2")
    return placed, save(meets, "jaccard-meets")


def _frequent(members: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Elements of several sets, sorted, their ranks by frequency from 1, and whether these are all; the KEPT most frequent, as ranks bear on speed only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            held, many = [], 0
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, np.int64))
                many += len(held[-1])
                if many >= FLUSH:
                    yield out(held)
                    held, many = [], 0
            if held:
                yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = members.select("elements").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counts.orderBy(F.col("n").desc(), "h").limit(KEPT).toArrow()
    h, n = (rows.column(c).to_numpy() for c in ("h", "n"))
    h, rank = h.view(np.uint64), np.empty(len(h), np.int32)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order], len(h) < KEPT


def bitmap(s: np.ndarray, width: int) -> bytes:
    flags = np.zeros(width, np.uint8)
    flags[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def bitmap_widths(n: int, percent: int) -> list[int]:
    """Some two bits an element, for a set of n elements and for the larger ones that it may link with: the larger one's width is where two sets meet."""
    fit = lambda m: min(BITS, max(64, 1 << int(2 * m - 1).bit_length()))
    out = [fit(n)]
    while out[-1] < fit(100 * n // percent):
        out.append(2 * out[-1])
    return out


def rarest(s: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """So many of a set's rarest elements that any set that links with it has one of them among its own rarest, and their ranks (0 if not frequent)."""
    of = np.zeros(len(s), np.int32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        of = np.where(frequent[at] == s, rank[at], 0)
    first = np.lexsort((s, of))[: len(s) + -percent * len(s) // 100 + 1]
    return s[first], of[first]


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) over which any two sets of one cluster that link are joined, and few others; fewer pairs than sets have rarest elements."""
    frequent, rank, every = _frequent(members)
    sent = members.sparkSession.sparkContext.broadcast((frequent, rank))  # KEPT of each at most

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches, "words"):
            for sid, cluster, x in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(x, np.uint64)
                few, of = rarest(s, percent, *sent.value)
                if every:
                    few = few[of > 0]  # no other set has the rest
                few = _scramble(few ^ _scramble(np.array([cluster], np.int64).view(np.uint64))).view(np.int64)
                for width in bitmap_widths(len(s), percent) if len(few) else []:
                    bits = bitmap(s, width)
                    for k in range(0, len(few), 4096):
                        held.append((few[k : k + 4096], width, sid, len(s), bits))
                        size += len(held[-1][0]) * (len(bits) + 28)
                        if size >= 4 * FLUSH:
                            yield out(held)
                            held, size = [], 0
        if held:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        times = [len(x[0]) for x in held]
        each = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in held], kind), times))
        bits = pa.array([x[4] for x, m in zip(held, times) for _ in range(m)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in held])), each(1, np.int32), each(2, np.int64), each(3, np.int64), bits], names=["key", "width", "sid", "n", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 2):
            if len(rows) > 1 and (found := joined(rows, percent)):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = members.select("sid", "cluster", "elements").mapInArrow(keys, "key long, width int, sid long, n long, bits binary")
    return rows.repartition("key", "width").sortWithinPartitions("key", "width").mapInArrow(run, "a long, b long").distinct()


def joined(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """A spanning set of pairs among rows (key, width, sid, n, bits) that bitmaps don't keep from linking: a bit in one of two only is an element in one of them only."""
    rows = sorted(rows, key=lambda r: r[3])
    sid, n = [r[2] for r in rows], np.array([r[3] for r in rows])
    bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
    label, out = np.arange(len(rows)), []
    for x in range(len(rows) - 1):
        last = np.searchsorted(n, 100 * n[x] // percent, "right")
        y = x + 1 + np.flatnonzero(label[x + 1 : last] != label[x])
        if not len(y):
            continue
        cuts = np.array_split(y, 1 + len(y) * bits.shape[1] // (1 << 22))
        differ = np.concatenate([np.bitwise_count(bits[k] ^ bits[x]).sum(1).astype(np.int64) for k in cuts])
        both = n[y] + n[x]
        y = y[(100 + percent) * ((both - differ) // 2) >= percent * both]
        if len(y):
            labels, first = np.unique(label[y], return_index=True)
            out += [(sid[x], sid[k]) for k in y[first].tolist()]
            label[np.isin(label, labels)] = label[x]
    return out


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
