r"""Document fingerprints: a Merkle tree over sections and paragraphs.

Paragraphs are the lines of a text; a paragraph's digest is the SHA-256 of its
text. A section ends after a paragraph whose digest ends with 0 or 8 (one in
eight), so an inserted line moves no border but its own section's. A section's
digest is that of its paragraphs' digests, the root that of the sections'. Below
each paragraph stand leaves, hashes of two neighbouring words (of the one word, if
there is one only).

The fingerprint is the root and the ``SKETCH`` smallest section digests (16 hex
digits each), so its length is bounded. Equal roots mean equal texts.

Two trees are compared from the root down, and only where digests differ:
sections of one that the other lacks are opened, then their paragraphs that the
other's opened sections lack, then those paragraphs' leaves. Weights are code points
(and one for a line's end) of the different paragraphs of a text. What is closed
agrees; opened paragraphs agree by the share of their leaves that the other side's
opened paragraphs have. Likeness is the weight that agrees, of both sides, over the
weight of both and one for the roots; it is 1 for equal roots only.
``edited_branches`` names the sections and paragraphs of one tree that the other lacks, by their
digests, so an insertion moves nothing behind it.

The next document (by ascending doc_id) is found in buckets of neighbouring ids,
each with the first document of the bucket after it as its last row. The buckets'
borders come from a sample of ids and text hashes, so one far id or many equal or
null ids don't fill a bucket. Texts go through one shuffle, by bucket.

Edge cases: null text is empty. Null doc_ids come first in the order, equal ids
are ordered by their text's hash; after the last document comes the first. Rows
equal in both stay side by side, in one bucket. With one document only, it is its own
next one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import save, table, text_or_empty

SKETCH, WORDS = 256, 2
#: Documents in a bucket of neighbouring ids, and buckets at most: the first document of each (some 30 bytes) is broadcast.
BUCKET, BUCKETS = 256, 100_000
#: Documents in the sample that borders are taken from, borders, and how many of them one step of the search passes over.
SAMPLE, SEGMENTS, STEP = 16_384, 256, 16


def paragraph_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p.cast("binary"), 256))


def section_ends(digests: Column) -> Column:
    """After how many paragraphs a section ends, for each section."""
    last = F.transform(digests, lambda d, i: F.when(F.substring(d, -1, 1).isin("0", "8"), i + 1))
    return F.array_distinct(F.concat(F.filter(last, lambda e: e.isNotNull()), F.array(F.size(digests))))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 64)), "").cast("binary"), 256)


def add_tree(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with struct(root, sections) of its column text; a section is its digest with its text behind it. In steps, so that no digest is computed twice."""
    df = df.withColumn("_lines", F.split(text, "\n")).withColumn("_digests", paragraph_digests(F.col(text)))
    df = df.withColumn("_ends", section_ends(F.col("_digests")))
    starts = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1))
    part = lambda of, s, e, between: F.array_join(F.slice(of, s + 1, e - s), between)
    df = df.withColumn("_sections", F.zip_with(starts, "_ends", lambda s, e: F.concat(F.sha2(part(F.col("_digests"), s, e, "").cast("binary"), 256), part(F.col("_lines"), s, e, "\n"))))
    return df.withColumn(to, F.struct(root_digest(F.col("_sections")).alias("root"), F.col("_sections").alias("sections"))).drop("_lines", "_digests", "_ends", "_sections")


def fingerprint(of: Column) -> Column:
    """A tree as text."""
    names = F.array_distinct(F.transform(of["sections"], lambda s: F.substring(s, 1, 16)))
    return F.concat_ws(":", of["root"], F.array_join(F.slice(F.array_sort(names), 1, SKETCH), ","))


def leaves(paragraphs: Column) -> Column:
    """The different leaves of some paragraphs."""

    def of(p: Column) -> Column:
        words = F.transform(F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        return F.transform(F.array(words), lambda w: F.when(F.size(w) < WORDS, F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WORDS)))))[0]

    return F.array_distinct(F.flatten(F.transform(paragraphs, of)))


def _weight(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda s, p: s + F.length(p) + 1)


def add_likeness(df: DataFrame, a: tuple[str, str], b: tuple[str, str], to: str) -> DataFrame:
    """df with the likeness of two trees; a, b: the names of a text and of its tree."""
    opened = lambda x, y: F.flatten(F.transform(F.array_except(F.col(x)["sections"], F.col(y)["sections"]), lambda s: F.split(F.substr(s, F.lit(65)), "\n")))
    df = df.withColumn("_oa", opened(a[1], b[1])).withColumn("_ob", opened(b[1], a[1]))
    df = df.withColumn("_ea", F.array_except("_oa", "_ob")).withColumn("_eb", F.array_except("_ob", "_oa"))
    df = df.withColumn("_la", leaves(F.col("_ea"))).withColumn("_lb", leaves(F.col("_eb")))
    df = df.withColumn("_both", F.size(F.array_intersect("_la", "_lb")))
    for k, (text, _) in zip("ab", (a, b)):
        agree = F.when(F.size(f"_l{k}") > 0, F.col("_both") / F.size(f"_l{k}")).otherwise(0.0)
        df = df.withColumn(f"_all{k}", _weight(F.array_distinct(F.split(text, "\n")))).withColumn(f"_same{k}", F.col(f"_all{k}") - _weight(F.col(f"_e{k}")) * (1 - agree))
    value = (F.col("_samea") + F.col("_sameb")) / (F.col("_alla") + F.col("_allb") + 1)
    df = df.withColumn(to, F.when(F.col(a[1])["root"] == F.col(b[1])["root"], F.lit(1.0)).otherwise(value))
    return df.drop("_oa", "_ob", "_ea", "_eb", "_la", "_lb", "_both", "_alla", "_allb", "_samea", "_sameb")


def _digest(section: Column) -> Column:
    return F.substring(section, 1, 64)


def _lines(section: Column) -> Column:
    return F.split(F.substr(section, F.lit(65)), "\n")


def _lost(a: Column, b: Column) -> Column:
    """The digests of a's sections that b lacks, wherever they stand."""
    return F.array_except(F.transform(a["sections"], _digest), F.transform(b["sections"], _digest))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of a's sections that b lacks. What stands before or after them moves nothing, as digests are compared, not places."""
    lost = _lost(a, b)
    return F.filter(F.transform(a["sections"], lambda x, i: F.when(F.array_contains(lost, _digest(x)), i)), lambda i: i.isNotNull())


def edited_branches(a: Column, b: Column) -> Column:
    """a's sections that b lacks, each with the numbers of those of its paragraphs that none of b's sections has that a lacks.

    With a and b exchanged, it tells what was put in.
    """
    lost, other = _lost(a, b), _lost(b, a)
    theirs = F.flatten(F.transform(F.filter(b["sections"], lambda s: F.array_contains(other, _digest(s))), _lines))
    numbers = lambda s: F.filter(F.transform(_lines(s), lambda p, j: F.when(~F.array_contains(theirs, p), j)), lambda j: j.isNotNull())
    found = F.transform(a["sections"], lambda s, i: F.when(F.array_contains(lost, _digest(s)), F.struct(i.alias("section"), numbers(s).alias("paragraphs"))))
    return F.filter(found, lambda x: x.isNotNull())


def bucket_of(keyed: DataFrame, n: int, bucket: int, most: int = BUCKETS) -> Column:
    """The bucket of each row's key, a struct (doc_id, h) in column _at: buckets are ranges of keys, in their order."""
    buckets = min(max(1, -(-n // bucket)), most)
    segments = min(buckets, SEGMENTS)
    each = -(-buckets // segments)
    # SAMPLE keys at most, whatever n is; the first draw lets through little more, so that tasks don't send as many each.
    drawn = keyed.where(F.rand(3) < min(1.0, 1.5 * SAMPLE / max(1, n))).select("_at.*")
    sample = sorted(((r.doc_id, r.h) for r in drawn.orderBy(F.rand(7)).limit(SAMPLE).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    if not sample:
        return F.lit(0).cast("long")
    borders = [{"doc_id": None, "h": -(1 << 63)}] + [dict(zip(("doc_id", "h"), sample[len(sample) * i // segments])) for i in range(1, segments)]
    kind = keyed.schema["_at"].dataType.simpleString()
    known = lambda rows: F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")
    at = F.col("_at")
    passed = lambda rows: F.size(F.filter(rows, lambda b: b <= at))
    coarse = (passed(known(borders[::STEP])) - 1) * STEP
    segment = coarse + passed(F.slice(known(borders), coarse + 1, STEP)) - 1
    if each == 1:
        return segment.cast("long")
    # Within a segment, buckets are equal spans of ids, or of hashes where one id fills it. Doubles keep the order and can't overflow.
    ends = [*borders[1:], dict(zip(("doc_id", "h"), sample[-1]))]
    low, high = known([{"doc_id": sample[0][0], "h": sample[0][1]}, *borders[1:]])[segment], known(ends)[segment]

    def span(name: str) -> Column:
        x, a, b = at[name].cast("double"), low[name].cast("double"), high[name].cast("double")
        return F.least(F.greatest(F.floor((x - a) / (b - a) * each), F.lit(0)), F.lit(each - 1))

    inside = F.when(at["doc_id"] > high["doc_id"], F.lit(each - 1)).when(low["doc_id"].eqNullSafe(high["doc_id"]), F.when(low["h"] < high["h"], span("h"))).when(low["doc_id"].isNotNull() & at["doc_id"].isNotNull(), span("doc_id"))
    return segment.cast("long") * each + F.coalesce(inside, F.lit(0)).cast("long")


def with_next(docs: DataFrame, columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text and others) with ``next``, a struct of the given columns of the document after it; the last one's is the first document.

    The first document of each bucket is sent to the bucket before as well, where it comes last and is dropped once it
    has been seen.
    """
    keyed = docs.withColumn("_at", F.struct("doc_id", F.xxhash64("text").alias("h")))
    keyed = keyed.withColumn("_bucket", bucket_of(keyed, docs.count(), bucket))
    heads = keyed.groupBy("_bucket").agg(F.min("_at").alias("_head"))
    # One row for each bucket, BUCKETS at most.
    along = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("_bucket").over(along.orderBy("_bucket")), F.max("_bucket").over(along))
    heads = save(heads.select(F.col("_bucket").alias("_of"), F.col("_head.doc_id").alias("_id"), F.col("_head.h").alias("_h"), before.alias("_before")), "merkle-heads")
    first = (F.col("_bucket") == F.col("_of")) & F.col("_at.doc_id").eqNullSafe(F.col("_id")) & (F.col("_at.h") == F.col("_h"))
    placed = keyed.join(F.broadcast(heads), first, "left")
    both = F.when(F.col("_before").isNull(), F.array("_bucket")).otherwise(F.array("_bucket", "_before"))
    placed = placed.select(*docs.columns, "_at", F.posexplode(both).alias("_copy", "_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_copy", "_at")
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_copy = 0").drop("_at", "_bucket", "_copy")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    near = with_next(docs, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.text").alias("after"))
    for text, tree in (("text", "tree"), ("edited", "edited_tree"), ("after", "after_tree")):
        near = add_tree(near, text, tree)
    near = add_likeness(near, ("text", "tree"), ("edited", "edited_tree"), "near_edited")
    near = add_likeness(near, ("text", "tree"), ("after", "after_tree"), "near_next")
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.array_join(differing_sections(F.col("tree"), F.col("edited_tree")), ",").alias("edited_sections"),
    )
