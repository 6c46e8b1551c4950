import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brassloom.llm import op2_merkle
from brassloom.llm.op2_merkle import add_tree, edited_branches, with_next
from brassloom.llm.op2_merkle import op2_merkle as query

_hex = lambda x: hashlib.sha256(x.encode()).hexdigest()


def _tree(text):
    lines = text.split("\n")
    sections, held = [], []
    for line in lines:
        held.append(line)
        if _hex(line)[-1] in "08":
            sections.append(tuple(held))
            held = []
    if held:
        sections.append(tuple(held))
    digests = [_hex("".join(map(_hex, s))) for s in sections]
    return _hex("".join(digests)), dict(zip(digests, sections)), digests


def _leaves(lines):
    out = set()
    for line in lines:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
        out |= {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    return out


def _likeness(a, b):
    (root, x, _), (other, y, _) = _tree(a), _tree(b)
    if root == other:
        return 1.0
    oa, ob = ({line for d in s if d not in t for line in s[d]} for s, t in ((x, y), (y, x)))
    ea, eb = oa - ob, ob - oa
    la, lb = _leaves(ea), _leaves(eb)
    weight = lambda lines: sum(len(line) + 1 for line in lines)
    same, whole = 0.0, 1.0
    for text, e, own in ((a, ea, la), (b, eb, lb)):
        every = weight(set(text.split("\n")))
        whole += every
        same += every - weight(e) * (1 - (len(la & lb) / len(own) if own else 0.0))
    return same / whole


def _check(rows, given):
    """rows of the query against the definition; given: texts by doc_id, unique ids."""
    ids = sorted(given)
    assert sorted(rows) == ids
    for i, k in enumerate(ids):
        text, following = given[k] or "", given[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[k]
        assert r.n_chars == len(text) and r.edited_sha256 == _hex(edited)
        assert r.near_edited == pytest.approx(_likeness(text, edited)) and r.near_next == pytest.approx(_likeness(text, following))
        assert (r.near_next == 1) == (text == following) and (r.near_edited == 1) == (text == edited) and 0 <= min(r.near_edited, r.near_next)
        for of, got in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            root, _, digests = _tree(of)
            assert got == root + ":" + ",".join(sorted({d[:16] for d in digests})[: op2_merkle.SKETCH])
        x, y = _tree(text)[2], _tree(edited)[2]
        assert r.edited_sections == ",".join(str(j) for j in range(len(x)) if x[j] not in y)


def _texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(r.randint(0, 9)))
    texts = ["\n".join(line() for _ in range(r.randint(1, 60))) for _ in range(40)]
    near = [t.replace("a", "b", 1) for t in texts[:10]] + ["first\n" + t for t in texts[10:20]]
    return [*texts, *near, "x\n" * 3, "x\n" * 4, "é" * 200, None, "", "\n", "one", "two words", "word " * 30_000, "a\n" * 20_000]


def test_against_brute_force(spark, docs, tmp_path):
    r, texts = random.Random(1), _texts()
    order = [x for k in range(20) for x in (texts[k], texts[40 + k])] + texts[20:40] + texts[60:]
    given = dict(zip(sorted(r.sample(range(-(10**6), 10**6), len(order))), order))
    rows = list(given.items())
    r.shuffle(rows)
    docs([(i, t, "en", "s") for i, t in rows]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in query(spark, str(tmp_path)).collect()}
    _check(got, given)
    ids = sorted(given)
    # A near copy after its text is near, a line put before all others included.
    assert min(got[ids[2 * k]].near_next for k in range(20) if len(order[2 * k]) > 300) > 0.8


def test_given_documents(spark):
    given = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    _check({r.doc_id: r for r in query(spark, "/root/testdata/sf0.001").collect()}, given)


def test_short_texts_keep_what_is_unchanged(spark, docs, tmp_path):
    docs([(1, "these are the eight words of one line", "en", "s"), (2, "quite other things stand here and nowhere else", "en", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    assert rows[1].near_edited > 0.25 and rows[1].near_next == 0


@pytest.mark.parametrize(("bucket", "most"), [(16, 100_000), (2, 100_000), (16, 7), (1, 100_000)])
def test_next_over_many_buckets(spark, monkeypatch, bucket, most):
    monkeypatch.setattr(op2_merkle.bucket_of, "__defaults__", (most,))
    monkeypatch.setattr(op2_merkle, "SEGMENTS", 32)
    big = 9223372036854775000
    given = [-big, *range(0, 3000, 7), 10**15, big]
    ids = spark.createDataFrame([(i, str(i)) for i in given], "doc_id long, text string").repartition(4)
    rows = with_next(ids, ["doc_id"], bucket=bucket).select("doc_id", F.col("next.doc_id").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == dict(zip(given, given[1:] + given[:1])) and len(rows) == len(given)


def test_buckets_are_even_with_far_null_and_equal_ids(spark):
    rows = [(None, f"n{k}") for k in range(1000)] + [(5, f"e{k}") for k in range(1000)] + [(k, "x") for k in range(6, 1006)] + [(9223372036854775000, "far"), (-9223372036854775000, "far")]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.struct("doc_id", F.xxhash64("text").alias("h")))
    for bucket in (64, 4):
        placed = keyed.withColumn("b", op2_merkle.bucket_of(keyed, len(rows), bucket))
        sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
        assert max(sizes) <= 4 * bucket + 8
        inorder = placed.orderBy("_at").select("b").collect()
        assert [r.b for r in inorder] == sorted(r.b for r in inorder)
    out = with_next(keyed.drop("_at"), ["doc_id", "text"], bucket=64).select("doc_id", "text", "next").collect()
    assert len(out) == len(rows) and len({(r.next.doc_id, r.next.text) for r in out}) == len(rows)


def test_edge_cases(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/e/documents.parquet")
    rows = query(spark, f"{tmp_path}/e").collect()
    assert len(rows) == 8 and all(r.fingerprint for r in rows)
    edge.limit(0).write.parquet(f"{tmp_path}/z/documents.parquet")
    assert query(spark, f"{tmp_path}/z").collect() == []
    edge.where("doc_id = 5").write.parquet(f"{tmp_path}/one/documents.parquet")
    (only,) = query(spark, f"{tmp_path}/one").collect()
    assert only.near_next == 1


def _branches(spark, a, b):
    df = add_tree(add_tree(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    row = df.select(edited_branches(F.col("x"), F.col("y")).alias("gone"), edited_branches(F.col("y"), F.col("x")).alias("new")).first()

    def named(text, found):
        sections = [list(s) for s in _sections(text)]
        return [sections[z.section][j] for z in found for j in z.paragraphs]

    return named(a, row.gone), named(b, row.new), len(row.gone), len(row.new)


def _sections(text):
    out, held = [], []
    for line in text.split("\n"):
        held.append(line)
        if _hex(line)[-1] in "08":
            out.append(held)
            held = []
    return [*out, held] if held else out


def test_branches_locate_edits(spark):
    lines = [f"line {i}" for i in range(160)]
    text = "\n".join(lines)
    assert len(_sections(text)) > 10
    assert _branches(spark, text, text) == ([], [], 0, 0)
    gone, new, n, m = _branches(spark, text, text.replace("line 9\n", "line nine\n"))
    assert (gone, new) == (["line 9"], ["line nine"]) and n <= 2 and m <= 2
    # ten lines in front, in the middle and at the end, and ten that are taken out
    some = [f"new {i}" for i in range(10)]
    for at in (0, 77, 160):
        gone, new, n, m = _branches(spark, text, "\n".join([*lines[:at], *some, *lines[at:]]))
        assert gone == [] and new == some and n <= 1
        gone, new, n, m = _branches(spark, "\n".join([*lines[:at], *some, *lines[at:]]), text)
        assert gone == some and new == [] and m <= 1
