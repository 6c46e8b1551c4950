import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from brassloom.llm import op3_linededup
from brassloom.llm.op3_linededup import Runs, dedup

WHITE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def _brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(_key(line)) >= 20:
                held[_key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(_key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_against_brute_force(docs):
    r = random.Random(4)
    pool = [f"A Shared Line, Number {k} of many É" for k in range(12)] + ["short", "", "  ", "É UPPER and lower line here ok"]
    rows = [(i, "\n".join(r.choice(("", " ", "\t")) + r.choice(pool).swapcase() if r.random() < 0.3 else r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(60)] + [(99, None)]
    want = _brute(rows)
    for batches in (1, 4, 7):
        for x in dedup(docs([(i, t, "en", "s") for i, t in rows]), batches=batches).collect():
            assert (x.n_lines, x.n_dropped, x.text or "") == want[x.doc_id]


def test_edge_cases(edge, docs):
    rows = dedup(edge).collect()
    assert len(rows) == 8 and sum(r.n_dropped for r in rows) == 0 and all(r.h1 == 1 for r in rows)
    assert {r.doc_id: r.n_lines for r in rows}[1] == 1
    assert dedup(edge.limit(0)).collect() == []
    same = [(None, "this line is in every document", "en", "s")] * 4
    assert all(r.n_dropped == 0 for r in dedup(docs(same)).collect())
    # equal rows are one document; all rows with the largest id keep the line
    line = "this line is in every document"
    assert sum(r.n_dropped for r in dedup(docs([(1, line, "", "")] + [(7, line, "", "")] * 2)).collect()) == 0
    kept = dedup(docs([(1, line, "", ""), (7, line, "", ""), (7, line + "\nx", "", "")])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in kept) == [(1, 1), (7, 0), (7, 0)]


def test_far_ids_and_joins_by_shuffle(docs, monkeypatch):
    far, line = 9223372036854775000, "this line is in every document"
    rows = [(-far, line), (0, line + "\nx"), (far, line)]
    want = {i: n for i, n in zip((-far, 0, far), (1, 1, 0))}
    for few in (op3_linededup.FEW, 0):
        monkeypatch.setattr(op3_linededup, "FEW", few)
        assert {r.doc_id: r.n_dropped for r in dedup(docs([(i, t, "en", "s") for i, t in rows])).collect()} == want


def test_runs_are_compacted(spark):
    runs = Runs(spark, fanout=2)
    for b in range(6):
        runs.add(spark.range(b, b + 3).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(1).cast("long").alias("docs"), F.lit(100 - b).cast("long").alias("holder")))
    assert sum(map(len, runs.levels.values())) <= 4
    got = {r.h1: (r.docs, r.holder) for r in runs.counts().collect()}
    assert got[0] == (1, 100) and got[2] == (3, 100) and got[7] == (1, 95)
    assert hashlib.sha256(b"").hexdigest()


def test_a_far_id_leaves_batches_even(docs):
    given = docs([(i, f"line number {i} is long enough", "en", "a") for i in range(400)] + [(10**15, "a line that is far from the others", "en", "a"), (None, "a line without any id at all", "en", "a")])
    sizes = {r.batch: r["count"] for r in op3_linededup.line_hashes(given, batches=4).groupBy("batch").count().collect()}
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) <= 110
