import math

import numpy as np
import pytest

from brassloom.llm import op7_topk
from brassloom.llm.op7_topk import top_k


def _brute(rows, every):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good}):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:10]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "few"), [(0.0, op7_topk.FEW_IDS), (0.1, 0), (1.0, op7_topk.FEW_IDS)])
def test_against_brute_force_with_small_blocks(spark, monkeypatch, scale, few):
    monkeypatch.setattr(op7_topk, "FEW_IDS", few)
    monkeypatch.setattr(op7_topk, "BLOCK", 40)
    monkeypatch.setattr(op7_topk, "QUERIES", 7)
    monkeypatch.setattr(op7_topk, "GROUP", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (400, 8)) * rng.lognormal(0, scale, (400, 1))
    v[50] = v[60] = v[70]
    if scale == 0.0:
        v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [rows[20], rows[20], (30, rows[31][1])]  # one query repeated, one id with two vectors
    df = spark.createDataFrame([(i, r, "x", 1) for i, r in rows], "vec_id long, embedding array<float>, rank string, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, every=10).collect())
    assert got == _brute(rows, 10)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (7, [-1.0, -2.0]), (100, [3.0, 4.0]), (None, [1.0, 1.0]), (8, [1.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df).collect())
    assert got == _brute(rows, 100)
    assert top_k(df.limit(0)).collect() == [] and top_k(df.where("vec_id = 0")).collect() == []


def test_vectors_pass_no_window(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(0, 1, (300, 4)))], "vec_id long, embedding array<float>")
    found = op7_topk.blocks(op7_topk.quantized(df), 20, "topk-test")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(found.collect(), key=lambda r: r.no)
    assert [r.no for r in rows] == list(range(len(rows))) and len(rows) >= 15
    assert [r.high for r in rows] == sorted((r.high for r in rows), reverse=True)
    assert sum(len(r.ids) // 8 for r in rows) == 300


def test_large_values_take_wider_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rng.normal(0, 10.0 ** rng.integers(0, 7, (60, 1)), (60, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, every=7).collect()) == _brute(rows, 7)
