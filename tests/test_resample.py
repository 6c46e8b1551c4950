"""Resampled paths from block summaries, against paths that are walked return by return."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brassloom.operators import resample, scan
from brassloom.operators.resample import block_bootstrap, resample_trades


def _drawn(path, step, n, seed=0):
    def mixed(x):
        for a, by in ((1583458089, 16), (784588716, 13)):
            x = (x * a + 1) % resample.PRIME
            x ^= x >> by
        return x

    return mixed((mixed((path + 1 + 40692 * seed) % resample.PRIME) + step * 69621) % resample.PRIME) * n >> 31


def _walked(r, block, horizon, n_sims, seed):
    out = []
    for path in range(n_sims):
        got = []
        for step in range(-(-horizon // block)):
            at = _drawn(path, step, len(r), seed)
            got += [r[(at + k) % len(r)] for k in range(block)]
        equity, peak, dd = 1.0, 1.0, 0.0
        for x in got[:horizon]:
            equity *= max(0.0, 1 + x)
            peak = max(peak, equity)
            dd = min(dd, equity / peak - 1)
        out.append((equity, dd))
    final, dd = zip(*out)
    return [*np.percentile(final, (5, 50, 95)), *np.percentile(dd, (50, 5)), np.mean(np.array(final) < 1), np.mean(np.array(dd) < -0.25)]


@pytest.mark.parametrize(("block", "horizon", "segment", "few"), [(5, None, 10**6, 10**5), (5, 33, 7, 10), (21, 100, 4, 10**5), (1, None, 10, 10)])
def test_equals_paths_that_are_walked(spark, monkeypatch, block, horizon, segment, few):
    monkeypatch.setattr(scan, "SEGMENT", segment)
    monkeypatch.setattr(resample, "FEW", few)
    monkeypatch.setattr(resample, "CELLS", 100)
    r = random.Random(block)
    long, short = [r.gauss(0, 0.04) for _ in range(57)], [0.1, -0.1]
    long[7], long[20] = -1.0, -0.5
    day = dt.date(2020, 1, 1)
    rows = [("long", day + dt.timedelta(days=i), x) for i, x in enumerate(long)] + [("short", day + dt.timedelta(days=i), x) for i, x in enumerate(short)]
    rows += [("long", day + dt.timedelta(days=900), None), ("long", day + dt.timedelta(days=901), float("nan"))]
    df = spark.createDataFrame(rows, "k string, date date, r double").repartition(5)
    how = {"n_sims": 60, "seed": 3}
    found = block_bootstrap(df, ["k"], horizon=horizon, block=block, **how) if block > 1 else resample_trades(df, ["k"], "r", ["date"], n_trades=horizon, **how)
    got = {x.k: x for x in found.collect()}
    assert got["short"].n_sims == 0 and got["short"].final_p50 is None and got["long"].n_sims == 60
    assert [got["long"][c] for c in resample.RESULTS] == pytest.approx(_walked(long, block, horizon or 57, 60, 3), abs=1e-9)


def test_draws_are_even_and_do_not_follow_one_another(spark):
    df = spark.range(40_000).select((F.col("id") % 200).alias("path"), F.floor(F.col("id") / 200).alias("step"))
    rows = df.withColumn("d", resample.drawn(F.col("path"), F.col("step"), F.lit(50))).collect()
    assert all(x.d == _drawn(x.path, x.step, 50) for x in rows[:500])
    at = {(x.path, x.step): x.d for x in rows}
    each = Counter(at.values())
    assert set(each) == set(range(50)) and sum((n - 800) ** 2 / 800 for n in each.values()) < 90
    for a, b in ((0, 1), (1, 0), (1, 1), (0, 7)):
        pairs = [(d, at[p + a, s + b]) for (p, s), d in at.items() if (p + a, s + b) in at]
        assert abs(np.corrcoef(*zip(*pairs))[0, 1]) < 0.02
        cells = Counter((x // 10, y // 10) for x, y in pairs)
        even = len(pairs) / 25
        assert sum((cells[i, j] - even) ** 2 / even for i in range(5) for j in range(5)) < 60


def test_empty_series(spark):
    none = spark.createDataFrame([], "k string, date date, r double")
    assert block_bootstrap(none, ["k"], n_sims=5).collect() == []
    assert math.isfinite(resample.RUIN)
