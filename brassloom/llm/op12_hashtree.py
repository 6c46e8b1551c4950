"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

Every node of the tree has a weight, the sum of its shards' weights. A document goes
down from the root: at each level every child draws -ln(u) / weight, where u in (0, 1)
is a hash of the document's key and the child's name, and the smallest draw wins, so
a child wins in proportion to its weight. A document's draws at a node depend on
nothing but the names and weights of that node's children. So if a shard's weight
changes, only the draws of that shard, its rack and its region change: rows move into
or out of these subtrees, and any two rows that stay outside them stay where they are.

A tree grows by one shard without moving rows between old ones: the new shard stands
in a rack of some region, but its branch is founded later (``born``) and draws at
the root beside the regions, whose weights don't change. A row either keeps all of
its earlier winners or goes to the new branch, in which there is the new shard alone.

The law is ``key``: doc_id and the tree decide, nothing else. Slots number the rows of
a shard without gaps. Rows equal in doc_id, size and checksum are interchangeable, so they
are counted first (a hot one is one row from there on) and get a range of slots;
slots follow the md5 of those three values. They are running sums in buckets of about
``BUCKET`` rows on top of the sums of the buckets before, so no shard passes one task.
Texts are read once and go through no shuffle.

Edge cases: null text has size 1 and the checksum of the empty text. A null doc_id is a
key of its own: its rows lie in one shard. Rows with equal doc_id share a shard, whatever
their texts. Shards of weight 0 get no rows. An empty table gives no rows. Other
columns are ignored by the query and kept by ``assign`` and ``write_shards``.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brassloom.llm.common import save, table, text_or_empty
from brassloom.llm.op6_mix import running_before

#: The founding tree of the query: 16 shards.
REGIONS, RACKS, SHARDS = 2, 2, 4
BUCKET = 4096
#: Copies of one row that a task writes out at a time.
PART = 1_000_000


class Shard(NamedTuple):
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    born: int = 0


def founded(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS) -> list[Shard]:
    """A tree of equal shards, numbered from 0."""
    return [Shard((g * racks + r) * shards + s, g, r) for g in range(regions) for r in range(racks) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in the rack that weighs least (the first such)."""
    load: dict[tuple[int, int], float] = {}
    for s in tree:
        load[s.region, s.rack] = load.get((s.region, s.rack), 0.0) + s.weight
    region, rack = min(load, key=lambda at: (load[at], at))
    return [*tree, Shard(max(s.shard for s in tree) + 1, region, rack, weight, max(s.born for s in tree) + 1)]


def levels(tree: list[Shard]) -> list[list[tuple[str, str, float]]]:
    """(parent, child, weight) of each level, from the root down; a shard's name is its number."""
    out: list[dict[tuple[str, str], float]] = [{}, {}, {}]
    for s in tree:
        region = f"region {s.region} since {s.born}"
        rack = f"{region}, rack {s.rack}"
        for level, (parent, child) in zip(out, [("", region), (region, rack), (rack, str(s.shard))]):
            level[parent, child] = level.get((parent, child), 0.0) + s.weight
    found = [[(p, c, w) for (p, c), w in sorted(level.items()) if w > 0] for level in out]
    if not found[0]:
        raise ValueError("a tree needs a shard of positive weight")
    return found


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("none"))


def _draw(key: Column, child: Column, weight: Column) -> Column:
    """From 52 bits of an md5, so that any engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def shard_of(doc_id: Column, tree: list[Shard]) -> Column:
    """The number of the shard that the tree gives to a document."""
    key, at = key_of(doc_id), F.lit("")
    for level in levels(tree):
        children: dict[str, list[dict]] = {}
        for parent, child, weight in level:
            children.setdefault(parent, []).append({"child": child, "weight": weight})
        # One constant for the level, however many nodes it has.
        nodes = F.from_json(F.lit(json.dumps(children)), "map<string,array<struct<child:string,weight:double>>>")
        draws = F.transform(F.element_at(nodes, at), lambda c: F.struct(_draw(key, c["child"], c["weight"]).alias("draw"), c["child"].alias("child")))
        at = F.array_min(draws)["child"]
    return at.cast("int")


def assign(docs: DataFrame, tree: list[Shard], to: str = "shard") -> DataFrame:
    """docs with the shard of each row; no shuffle."""
    return docs.withColumn(to, shard_of(F.col("doc_id"), tree))


def write_shards(docs: DataFrame, tree: list[Shard], path: str, rows_per_file: int = 1_000_000) -> None:
    """docs as Parquet in a folder for each shard (shard=N, which takes the place of a column of that name), in files of about so many rows, whatever a shard's weight."""
    placed = assign(docs, tree)
    files = F.ceil(F.col("_n") / rows_per_file)
    counts = placed.groupBy("shard").agg(F.count("*").alias("_n"))  # a row for each shard
    salted = placed.join(F.broadcast(counts), "shard").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), files))
    kept = [c for c in docs.columns if c != "shard"]
    salted.repartition("shard", "_salt").select(*kept, "shard").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (in the grown tree) of each row of docs."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    once = rows.groupBy(*same).agg(F.count("*").alias("copies"))
    order = F.md5(F.concat_ws(":", key_of(F.col("doc_id")), "size", "text_crc32").cast("binary"))
    once = save(once.withColumn("shard", shard_of(F.col("doc_id"), tree)).withColumn("grown_shard", shard_of(F.col("doc_id"), grown(tree))).withColumn("order", order), "shards-rows")
    n, most = once.agg(F.count("*"), F.max("copies")).first()
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / float(1 << 32)
    placed = once.withColumn("bucket", F.floor(share * max(1, -(-n // (BUCKET * len(tree))))))
    before = running_before(placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows")), ["shard"], "bucket", "rows", "before")
    inside = F.coalesce(F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("order", *same).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("inside", inside).join(before, ["shard", "bucket"]).withColumn("first", F.col("before") + F.col("inside"))
    if (most or 0) > PART:
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PART)))).repartition(*same, "part")
        out = out.withColumn("first", F.col("first") + F.col("part") * PART).withColumn("copies", F.least(F.lit(PART), F.col("copies") - F.col("part") * PART))
    out = out.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    return out.select(*same, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_hashtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), founded())


def _sql_tree(tree: list[Shard], name: str) -> str:
    rows = [f"({n}, '{p}', '{c}', {w}::DOUBLE)" for n, level in enumerate(levels(tree)) for p, c, w in level]
    return f"{name}(level, parent, child, weight) AS (VALUES {', '.join(rows)})"


def _sql_descent(tree: str) -> str:
    """Three levels of draws over the distinct keys, one after the other."""
    step = """{to} AS (SELECT key, arg_min(child, -ln((('0x' || substr(md5(key || '|' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496) / weight) AS node
      FROM {of} JOIN {tree} ON level = {n} AND parent = node GROUP BY key)"""
    return ",\n".join(step.format(to=f"{tree}{n}", of=f"{tree}{n - 1}" if n else "keys", tree=tree, n=n) for n in range(3))


#: crc32's reversed polynomial is 3988292384; its table follows from it.
SQL = f"""
WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, strlen(COALESCE(text, ''))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(COALESCE(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (SELECT doc_id, COALESCE(doc_id::VARCHAR, 'none') AS key, size,
    xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, crcs),
keys AS (SELECT DISTINCT key, '' AS node FROM d),
{_sql_tree(founded(), "old")},
{_sql_tree(grown(founded()), "new")},
{_sql_descent("old")},
{_sql_descent("new")}
SELECT doc_id, size, text_crc32, 'key' AS law, old2.node::INT AS shard,
  row_number() OVER (PARTITION BY old2.node ORDER BY md5(key || ':' || size || ':' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, new2.node::INT AS grown_shard
FROM d JOIN old2 USING (key) JOIN new2 USING (key)
"""
