"""Line dedup over levelled sorted runs of line hashes.

Lines are known by two 64-bit hashes of their key (the line with white space
stripped at both ends and A-Z lower-cased). Documents come in batches of
descending doc_id. Each batch's keys are counted, anti-joined with the runs
written before - what is left is new, and the batch's largest document holds
it - and written as a run of its own, sorted by key: (key, documents, holder).
When a level has ``FANOUT`` runs they are compacted into one of the next level,
so each key is rewritten a number of times that grows with the logarithm of the
number of batches (``BATCHES``, and one more for each ``BATCH`` documents). A run is sorted
and holds a key once; the anti-joins and merges of runs are Spark's own joins and
groupings by key, which sort again what they shuffle. Tables that a merge has
replaced are deleted. At the end the runs give, for each key, the number of its
documents and its holder; lines of keys in enough documents are dropped
everywhere but in the holder.

A key that a third of all documents hold is counted by partial sums, and the
keys to drop are counted before they are broadcast; beyond ``FEW`` they are
joined by a shuffle, in which Spark splits skewed partitions.

Edge cases: null text is one empty line. Rows equal in doc_id and text are one
document; rows with the same doc_id and other texts count each, and those with
the largest doc_id all keep the line. Ids may lie any distance apart, as batches are cut at quantiles. A null doc_id is smaller than any other; a key held by null ids only
is never dropped. Other columns are ignored by the query and kept by ``dedup``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.llm.common import discard, save, table, text_or_empty

LEAST, DOCS = 20, 3
BATCHES, BATCH, FANOUT = 4, 50_000_000, 2
#: Keys to drop (16 bytes and a doc_id each) up to which they are broadcast.
FEW = 400_000
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped, A-Z lower-cased. lower() does it where no other letter has a lower case; it is far faster than translate()."""
    bare = F.btrim(line, F.lit(WHITE))
    other = bare.rlike(r"[^\x00-\x7F&&[\p{IsUppercase}\p{Lt}]]")
    return F.when(other, F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(bare))


def _hashes(line: Column, least: int) -> Column:
    """Two hashes of the line's key; null if it is too short to count."""
    key = line_key(line)
    return F.when((F.length(line) >= least) & (F.length(key) >= least), F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


def row_key() -> Column:
    """Tells rows with the same doc_id apart."""
    return F.xxhash64(text_or_empty())


def line_hashes(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """doc_id, rid, pos and the hashes of each line that counts, by batch; batch 0 has the largest ids, and batches have about as many documents."""
    # Borders are ids themselves, so rows with one id share a batch; a null id is below all.
    borders = docs.agg(F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)], 10_000)).first()[0] if batches > 1 else None
    kind = docs.schema["doc_id"].dataType
    above = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in borders or []]), lambda b: b < F.col("doc_id"))) if borders else F.lit(0)
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(F.lit(batches - 1) - above)
    lines = docs.select("doc_id", row_key().alias("rid"), batch.cast("int").alias("batch"), F.posexplode(F.transform(F.split(text_or_empty(), "\n"), lambda x: _hashes(x, least))).alias("pos", "h"))
    return save(lines.where("h IS NOT NULL").select("doc_id", "rid", "pos", "h.h1", "h.h2", "batch"), "line-hashes", ("batch",))


class Runs:
    """Sorted runs of (h1, h2, docs, holder), levelled like a log-structured merge tree."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, {}

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels.values() for r in level]
        out = runs[0] if runs else None
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def add(self, own: DataFrame) -> None:
        """own: the keys of a new batch (h1, h2, docs, holder). Its holders stand only where no earlier run has the key."""
        known, batch = self.all(), None
        if known is not None:
            own = batch = save(own, "line-batch")
            new = own.join(known.select("h1", "h2"), ["h1", "h2"], "left_anti")
            seen = own.join(known.select("h1", "h2"), ["h1", "h2"], "left_semi").withColumn("holder", F.lit(None).cast(own.schema["holder"].dataType))
            own = new.unionByName(seen)
        self._put(own, 0)
        discard(batch)

    def _put(self, run: DataFrame, level: int) -> None:
        at = self.levels.setdefault(level, [])
        at.append(save(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(at) > self.fanout:
            merged = self.merge(at)
            self.levels[level] = []
            self._put(merged, level + 1)
            discard(*at)

    def merge(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def counts(self) -> DataFrame:
        """All keys with the number of their documents and the holder."""
        return self.merge([r for level in self.levels.values() for r in level])


def dropped_lines(docs: DataFrame, least: int = LEAST, in_docs: int = DOCS, batches: int | None = None) -> DataFrame:
    """doc_id, rid and the positions (sorted array) of the lines that the document loses."""
    batches = batches or BATCHES + docs.count() // BATCH
    lines = line_hashes(docs, least, batches)
    runs = Runs(docs.sparkSession)
    for b in range(batches):
        # Once per document first: the rows of one document are in one task, so this is done before the shuffle.
        each = lines.where(F.col("batch") == b).groupBy("h1", "h2", "doc_id", "rid").agg(F.count("*").alias("_"))
        own = each.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder"))
        runs.add(own)
    drop = save(runs.counts().where(F.col("docs") >= in_docs), "line-drop")
    discard(*(r for level in runs.levels.values() for r in level))
    few = drop.count() <= FEW
    hit = lines.join(F.broadcast(drop) if few else drop, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull())
    return hit.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped positions, by slices, so that time is linear in their number."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup(docs: DataFrame, least: int = LEAST, in_docs: int = DOCS, batches: int | None = None) -> DataFrame:
    """docs without the dropped lines, and n_lines and n_dropped."""
    drop = dropped_lines(docs, least, in_docs, batches).select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "dropped")
    left = docs.withColumn("_rid", row_key())
    out = left.join(drop, left["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_rid") == F.col("_r")), "left")
    lines = F.split(text_or_empty(), "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(_kept(lines, F.col("dropped")), "\n"))
    n = F.when(F.col("dropped").isNull(), F.length(text_or_empty()) - F.length(F.replace(text_or_empty(), F.lit("\n"), F.lit(""))) + 1).otherwise(F.size(lines))
    return out.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns], n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line,
    translate(regexp_replace(lines[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents))),
c AS (SELECT k, COUNT(DISTINCT doc_id) AS docs, MAX(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING COUNT(DISTINCT doc_id) >= 3),
f AS (SELECT l.*, (c.k IS NOT NULL AND l.doc_id <> c.holder) AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, COUNT(*)::BIGINT AS n_lines, SUM(gone::INT)::BIGINT AS n_dropped,
  sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
