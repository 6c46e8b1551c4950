import zlib
from collections import Counter

from pyspark.sql import functions as F

from brassloom.llm import op12_hashtree
from brassloom.llm.op12_hashtree import Shard, assign, digests, founded, grown, write_shards


def _where(spark, tree, n=4000):
    return {r.doc_id: r.shard for r in assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()}


def test_shards_are_filled_by_weight(spark):
    tree = [s._replace(weight=3.0) if s.shard == 5 else s for s in founded()]
    n = Counter(_where(spark, tree, 18_000).values())
    assert set(n) == set(range(16)) and 2700 <= n[5] <= 3300 and all(850 <= v <= 1150 for k, v in n.items() if k != 5)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = founded()
    for _ in range(3):
        more = grown(tree)
        old, new = _where(spark, tree), _where(spark, more)
        moved = {k for k in old if old[k] != new[k]}
        assert {new[k] for k in moved} == {more[-1].shard}
        assert 0.5 / len(more) < len(moved) / len(old) < 1.6 / len(more)
        tree = more


def test_a_weight_moves_rows_only_in_or_out_of_its_subtrees(spark):
    tree = founded()
    heavier = [s._replace(weight=4.0) if s.shard == 6 else s for s in tree]  # region 0, rack 1
    old, new = _where(spark, tree), _where(spark, heavier)
    at = {s.shard: s for s in tree}
    moved = [(at[old[k]], at[new[k]]) for k in old if old[k] != new[k]]
    assert moved
    for a, b in moved:
        assert b.region == 0  # nothing moves into the other region, or within it
        if a.region == 0:
            assert b.rack == 1  # nor into the other rack, or within it
            if a.rack == 1:
                assert b.shard == 6


def test_shards_without_weight_are_empty(spark):
    tree = [Shard(0, 0, 0), Shard(1, 0, 1, 0.0), Shard(2, 1, 0, 0.0)]
    assert set(_where(spark, tree).values()) == {0}


def _right(rows, given):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_slots_have_no_gaps_in_any_buckets(docs, monkeypatch):
    monkeypatch.setattr(op12_hashtree, "BUCKET", 3)
    monkeypatch.setattr(op12_hashtree, "PART", 40)
    given = [(k, f"text {k}", "en", "a") for k in range(600)] + [(7, "again é", "en", "a")] * 250 + [(None, f"t{k}", "en", "a") for k in range(90)]
    rows = digests(docs(given), founded()).collect()
    _right(rows, [(i, t) for i, t, _, _ in given])
    assert Counter(rows) == Counter(digests(docs(given[::-1]), founded()).collect())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_edge_cases(edge, docs, tmp_path, spark):
    rows = digests(edge.select("doc_id", "text", *[c for c in edge.columns if c not in ("doc_id", "text")], F.lit(1).alias("shard"), F.lit(2).alias("order")), founded()).orderBy("doc_id").collect()
    _right(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert digests(edge.limit(0), founded()).collect() == []
    write_shards(edge, founded(), f"{tmp_path}/out", rows_per_file=1)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(*edge.columns).collect())) == Counter(map(tuple, edge.collect()))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in rows}
