import random

import numpy as np
from pyspark.sql import functions as F

from brassloom.llm import op9_quality
from brassloom.llm.op9_quality import NAMES, filter_documents, isotonic, score_documents, statistics


def test_isotonic_rises_and_keeps_the_mean():
    v, t, w = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1.0, 2, 1, 1, 1, 3])
    knots, levels = isotonic(v, t, w)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert np.isclose((np.interp(v, knots, levels)).min(), 0.1)


def test_statistics_of_odd_texts():
    for t in ("", " ", "\n", "A", "x" * 100_000, "é😀\x00"):
        s = statistics(t)
        assert len(s) == len(NAMES) and np.isfinite(s).all()


def test_held_out_accuracy_and_filter(spark, docs, edge):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(6)) if good else " ".join(["SPAM!!"] * 30 + [word().upper() + "!!" for _ in range(10)])
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = score_documents(docs(rows), lab).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == 400 and sum(x.predicted == (x.doc_id % 3 > 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    kept = filter_documents(docs(rows), lab)
    assert kept.columns == docs(rows).columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.predicted}
    assert len(score_documents(edge, lab).collect()) == 8
    assert {x.score for x in score_documents(edge, lab.limit(0)).collect()} == {0.5}
    assert score_documents(edge.limit(0), lab).collect() == []


def test_weights_solve_the_whole_normal_equations(spark, docs):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(("word", "Spam!!", "12", "other,")) for _ in range(r.randint(1, 60))), "en", "s") for i in range(1300)]
    y = {i: float(i % 2) if i % 7 else None for i, *_ in rows}
    given = docs(rows).repartition(7)
    marks = spark.createDataFrame(list(y.items()), "of long, y double")
    stats = op9_quality.extract(given, ["doc_id"]).join(marks, F.col("doc_id") == F.col("of"))
    model = op9_quality.fit(stats, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0)
    x = np.array([statistics(t) for i, t, *_ in rows if i % 5 and y[i] is not None])
    want = np.array([y[i] for i, *_ in rows if i % 5 and y[i] is not None])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    z = model.features(x)
    a = z.T @ z / len(z) + op9_quality.RIDGE * np.eye(z.shape[1])
    assert np.allclose(a @ model.weight, z.T @ want / len(z), atol=1e-8)
    # the kernel that the features stand for is a Gaussian's
    u, v = (np.clip((x[k] - model.mean) / model.scale, -6, 6) for k in (0, 1))
    cosines = z[:2, : op9_quality.FEATURES]
    assert abs(cosines[0] @ cosines[1] - np.exp(-((u - v) ** 2).sum() / (4 * len(u)))) < 0.35


def test_null_labels_and_long_texts(spark, docs):
    none = spark.createDataFrame([(1, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "word " * 300_000, "en", "s"), (2, None, None, None), (2, "", None, None)]
    got = score_documents(docs(rows), none).collect()
    assert [x.score for x in got] == [0.5] * 3 and filter_documents(docs(rows), none).count() == 3


def test_joins_by_shuffle_agree(spark, docs, monkeypatch):
    rows = [(i, "Good words stand here. " * 9 if i % 3 else "SPAM!! " * 60, "en", "s") for i in range(200)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    kept = lambda: sorted(x.doc_id for x in filter_documents(docs(rows), lab).collect())
    want = kept()
    monkeypatch.setattr(op9_quality, "FEW_IDS", 0)
    assert kept() == want and 0 < len(want) < 200
