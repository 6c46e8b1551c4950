"""Every query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from brassloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.5f}" if abs(v) < 1e6 else f"{v:.6g}"
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat(" ")
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if a != b and any(x != y and not _near(x, y) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]


def _near(x, y):
    try:
        return abs(float(x) - float(y)) <= 2e-5 * (1 + abs(float(y)))
    except ValueError:
        return False


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
