import random

from brassloom.llm import op6_mix
from brassloom.llm.op6_mix import mix, mix_sizes, sizes, targets


def test_targets_refill_what_caps_leave(spark):
    s = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 50, 1)], "source string, source_size long, n long")
    got = {r.source: r.target for r in targets(s).collect()}
    assert abs(sum(got.values()) - 1.5 * 2150) < 1e-6
    assert got["a"] == 200 and got[None] == 100 and all(v <= 2000 for v in got.values())
    assert abs(got["b"] - 2 * got["c"]) < 1e-6 or got["b"] == 2000


def test_taken_is_near_target_and_reruns_agree(docs):
    r = random.Random(2)
    given = docs([(i, "w " * r.randint(1, 40), "en", f"s{r.randint(0, 5)}" if i % 3 else "hot") for i in range(2500)])
    rows = mix_sizes(sizes(given)).collect()
    by = {}
    for x in rows:
        assert x.taken in (0, x.size, 2 * x.size)
        t = by.setdefault(x.source, [0, x.target])
        t[0] += x.taken
    assert all(abs(taken - target) <= 0.02 * target + 80 for taken, target in by.values())
    again = {x.doc_id: x.taken for x in mix_sizes(sizes(given)).collect()}
    assert again == {x.doc_id: x.taken for x in rows}


def test_null_ids_are_spread_and_joins_by_shuffle_agree(docs, monkeypatch):
    rows = [(None, f"w{k} " * (k % 5 + 1), "en", "a") for k in range(300)] + [(k, "w " * 3, "en", f"s{k % 7}") for k in range(200)]
    given = docs(rows)
    assert sizes(given).where("doc_id IS NULL").select("key").distinct().count() == 300
    want = sorted((r.source, r.size, r.taken, round(r.target, 6)) for r in mix_sizes(sizes(given)).collect())
    monkeypatch.setattr(op6_mix, "FEW", 0)
    assert sorted((r.source, r.size, r.taken, round(r.target, 6)) for r in mix_sizes(sizes(given)).collect()) == want


def test_repeated_rows_share_their_copies(docs):
    given = docs([(1, "a b c", "en", "x")] * 5 + [(2, "d e", "en", "x"), (3, "f", "en", "y")] + [(None, "g h", None, None)] * 3)
    assert mix(given).groupBy("doc_id").count().orderBy("doc_id").collect() == mix(given).groupBy("doc_id").count().orderBy("doc_id").collect()
    taken = sum(r.copies for r in mix_sizes(sizes(given)).collect())
    out = mix(given).collect()
    assert len(out) == taken and {r.text for r in out} <= {"a b c", "d e", "f", "g h"}


def test_edge_cases(edge, docs):
    rows = mix_sizes(sizes(edge)).collect()
    assert len(rows) == 8 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mix_sizes(sizes(edge.limit(0))).collect() == []
    mixed = mix(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in rows)
    nothing = docs([(1, None, "en", "a"), (2, "", "en", None)])
    assert [r.taken for r in mix_sizes(sizes(nothing)).collect()] == [0, 0] and mix(nothing).collect() == []
