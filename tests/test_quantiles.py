"""Exact quantiles by rounds of narrowing, against numpy over whole groups."""

import math
import random

import numpy as np
import pytest

from brassloom.operators import quantiles

QS = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9, "e": 1.0}


@pytest.mark.parametrize("leaf", [40, 700, 10**6])
def test_equals_sorting(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    r = random.Random(leaf)
    groups = {
        "even": [r.random() for _ in range(5000)],
        "wild": [r.choice((-1, 1)) * 10.0 ** r.randint(-300, 300) for _ in range(3001)],
        "ties": [float(r.choice((1, 1, 1, 2, 3))) for _ in range(4000)],
        "one": [7.5] * 2500,
        "few": [3.0, 1.0, 2.0],
        "none": [],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("even", None), ("few", float("nan")), ("none", None)]
    r.shuffle(rows)
    found = {x.k: x for x in quantiles.exact(spark.createDataFrame(rows, "k string, x double").repartition(6), ["k"], "x", QS).collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        for name, q in QS.items():
            if not v:
                assert found[k][name] is None
            else:
                ordered = sorted(v)
                at = q * (len(v) - 1)
                low, part = ordered[math.floor(at)], at - math.floor(at)
                want = low + part * (ordered[math.ceil(at)] - low)
                assert np.isclose(found[k][name], want, rtol=1e-9, atol=0), (k, name)


def test_empty_table(spark):
    assert quantiles.exact(spark.createDataFrame([], "k string, x double"), ["k"], "x", QS).collect() == []


def test_a_rank_between_values_that_many_rows_share(spark, monkeypatch):
    """The twentieth lies at the border of two values, which no sketch can tell apart from the rank."""
    monkeypatch.setattr(quantiles, "LEAF", 100)
    rows = [("a", float(v)) for v, n in ((0, 100), (1, 200), (2, 1700)) for _ in range(n)] + [("b", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    found = {r.k: (r.q, r.m) for r in quantiles.exact(df, ["k"], "x", {"q": 0.05, "m": 0.5}).collect()}
    assert abs(found["a"][0] - 0.95) < 1e-9 and found["a"][1] == 2.0 and abs(found["b"][0] - 0.45) < 1e-9 and found["b"][1] == 4.5
