"""Forecast parts with drifting columns, the store of months, and tables kept by key."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from brassloom.sources import forecasts, keyed, parsers

PARTS = {
    "GFS_KAAA_2024-01.csv": 'runtime,ftime,station,model,n_x,tmp\n2024-01-01 00:00,2024-01-02 00:00,KAAA,GFS,41,39\n2024-01-01 00:00,2024-01-01 06:00,KAAA,GFS,,38\n2024-02-01 00:00,2024-02-02 00:00,KAAA,GFS,50,\n',
    "GFS_KAAA_2024-02.csv": 'tmp,model,"station",ftime,runtime,n_x\n,GFS,KAAA,2024-02-02 00:00,2024-02-01 00:00,50\n12,GFS,KAAA,2024-02-03 00:00,2024-02-02 00:00,M\n13,GFS,KAAA,2024-02-03 00:00,2024-02-02 06:00,51.5\n',
    "NBS_KAAA_2024-01.csv": "station,model,runtime,ftime,xnd,txn\nKAAA,NBS,2024-01-01 01:00,2024-01-02 00:00,2,44\nKAAA,NBS,2024-01-01 07:00,2024-01-02 00:00,,\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in PARTS.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def _rows(df):
    return sorted((r.model, str(r.runtime), r.n_x, r.txn, r.xnd, r.tmp, r.month) for r in df.collect())


WANT = [
    ("GFS", "2024-01-01 00:00:00", 41.0, None, None, 39.0, "2024-01"),
    ("GFS", "2024-02-01 00:00:00", 50.0, None, None, None, "2024-01"),
    ("GFS", "2024-02-01 00:00:00", 50.0, None, None, None, "2024-02"),
    ("GFS", "2024-02-02 06:00:00", 51.5, None, None, 13.0, "2024-02"),
    ("NBS", "2024-01-01 01:00:00", None, 44.0, 2.0, None, "2024-01"),
]


def test_files_are_read_by_their_own_headers(spark, folder, monkeypatch):
    assert _rows(forecasts.read_forecasts(spark, str(folder))) == WANT
    monkeypatch.setattr(forecasts, "FEW", 0)
    assert _rows(forecasts.read_forecasts(spark, str(folder))) == WANT
    payloads = spark.createDataFrame([(name[-11:-4], text.replace("\n", "\r\n")) for name, text in PARTS.items()] + [("none", ""), ("head", "runtime,ftime")], "month string, text string")
    assert _rows(forecasts.parse_forecasts(payloads, ["month"], "text")) == WANT


def test_only_missing_months_are_added(spark, folder, tmp_path):
    found, store = forecasts.read_forecasts(spark, str(folder)), f"{tmp_path}/store"
    assert forecasts.stored_months(spark, store).collect() == []
    forecasts.add_months(found.where("month = '2024-01'"), store)
    assert _rows(forecasts.stored_forecasts(spark, store)) == [r for r in WANT if r[-1] == "2024-01"]
    changed = found.withColumn("n_x", F.when(F.col("month") == "2024-01", -1.0).otherwise(F.col("n_x")))
    forecasts.add_months(changed, store)
    forecasts.add_months(changed, store)
    # the forecast that both months hold comes once, from the earlier one; January is as it was
    assert _rows(forecasts.stored_forecasts(spark, store)) == [r for k, r in enumerate(WANT) if k != 2]
    assert len(_rows(forecasts.stored_forecasts(spark, store, once=False))) == 5


def test_tables_by_key(spark, tmp_path):
    store = keyed.Store(spark, f"{tmp_path}/kept")
    df = spark.createDataFrame([(dt.date(2020, 1, d), float(d)) for d in range(1, 20)], "date date, close double")
    assert store.load("y", "^A/B") is None and store.records().collect() == []
    record = store.save(df, "y", "^A/B", url="u", note="n")
    assert (record["rows"], record["first"], record["last"]) == (19, "2020-01-01", "2020-01-19")
    store.save(df.limit(5), "y", "_5e_A_2f_B")
    assert store.load("y", "^A/B").count() == 19 and store.load("y", "_5e_A_2f_B").count() == 5
    store.save(df.where("close > 10"), "y", "^A/B")
    assert store.load("y", "^A/B").count() == 9 and {r.key for r in store.records().collect()} == {"^A/B", "_5e_A_2f_B"}
    assert store.discard_old("y", "^A/B") == 1 and store.load("y", "^A/B").count() == 9
    assert keyed.all_records(store).first()["keys"] == 2
    empty = store.save(df.limit(0), "y", "none")
    assert empty["rows"] == 0 and store.load("y", "none").count() == 0


def test_writers_at_the_same_time_lose_no_key(spark, tmp_path):
    store = keyed.Store(spark, f"{tmp_path}/kept")
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0)], "date date, close double")
    jobs = [threading.Thread(target=store.save, args=(df, "s", f"k{i % 4}")) for i in range(8)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert {r.key for r in store.records().collect()} == {"k0", "k1", "k2", "k3"}
    assert all(store.load("s", f"k{i}").count() == 1 for i in range(4))


def test_a_changed_table_is_not_loaded(spark, tmp_path):
    store = keyed.Store(spark, f"{tmp_path}/kept")
    df = spark.createDataFrame([(dt.date(2020, 1, d), float(d)) for d in range(1, 9)], "date date, close double")
    record = store.save(df, "s", "k")
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/kept/tables/s/k/{record['version']}")
    with pytest.raises(ValueError, match="not what was saved"):
        store.load("s", "k")
    assert store.load("s", "k", check=False).count() == 9


def test_every_daily_file_needs_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n")
    (tmp_path / "b.csv").write_text("Date,Open,High,Low,Close\n2020-01-03,1,2,0.5,1.6\n")
    rows = parsers.read_daily_csv(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(r.date), r.close, r.volume, r.adj_close) for r in rows] == [("2020-01-02", 1.5, 100.0, 1.5), ("2020-01-03", 1.6, None, 1.6)]
    (tmp_path / "c.csv").write_text("No data\n")
    with pytest.raises(ValueError, match="c.csv"):
        parsers.read_daily_csv(spark, str(tmp_path))
