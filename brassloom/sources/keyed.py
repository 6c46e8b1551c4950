"""Tables kept by (source, key) with a record of what they hold.

A table that is saved goes to a folder of its own version; then a record that names this version appears by one rename,
and the key's latest record (by the writer's clock) is the one that counts. Readers see the old version or the new one; nothing is
replaced, so writers lose neither another's key nor another's version, and the manifest is the table of all keys' latest
records. A table's digest is a sum over hashes of its rows; loading compares it.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brassloom.sources.parsers import manifest

RECORD = "source string, key string, url string, note string, rows long, first string, last string, digest string, version string, saved_utc string"
_STAMP = "%Y-%m-%dT%H:%M:%S.%fZ"


def _safe(name: str) -> str:
    """A folder's name; what a path can't hold, and the escape itself, is written as its code."""
    return re.sub(r"[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", name)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, source: str, key: str, date: str = "date", url: str = "", note: str = "") -> dict:
        """Save a table as the key's new version; its record."""
        version = uuid.uuid4().hex
        path = f"{self.root}/tables/{_safe(source)}/{_safe(key)}/{version}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        held = manifest(written, key, date, written.columns).first()
        now = dt.datetime.now(dt.timezone.utc).strftime(_STAMP)
        record = {"source": source, "key": key, "url": url, "note": note, "rows": held.rows, "first": str(held["first"]), "last": str(held["last"]), "digest": held.digest, "version": version, "saved_utc": now}
        self._publish(f"{_safe(source)}~{_safe(key)}~{_safe(now)}{version}.json", json.dumps(record, sort_keys=True))
        return record

    def _publish(self, name: str, text: str) -> None:
        """Write a file beside the records and rename it into them, which is one step of the file system."""
        fs, draft = self._fs(), self._path("records", f".{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, self._path("records", name)):
            raise OSError(f"no record {name} could be made in {self.root}")

    def records(self) -> DataFrame:
        """The manifest: a row for each key."""
        if not self._fs().exists(self._path("records")):
            return self.spark.createDataFrame([], RECORD)
        every = self.spark.read.schema(RECORD).json(f"{self.root}/records")
        return every.groupBy("source", "key").agg(F.max_by(F.struct(*every.columns), F.struct("saved_utc", "version")).alias("r")).select("r.*")

    def _records_of(self, source: str, key: str) -> list:
        """Paths of a key's records, the latest last."""
        found = self._fs().globStatus(self._path("records", f"{_safe(source)}~{_safe(key)}~*.json"))
        return sorted((s.getPath() for s in found or []), key=lambda p: p.getName())

    def record(self, source: str, key: str) -> dict | None:
        found = self._records_of(source, key)
        return json.loads(self.spark.read.text(found[-1].toString(), wholetext=True).first()[0]) if found else None

    def load(self, source: str, key: str, check: bool = True, date: str = "date") -> DataFrame | None:
        """The key's table, None if there is none; raises if it isn't what was saved."""
        record = self.record(source, key)
        if record is None:
            return None
        df = self.spark.read.parquet(f"{self.root}/tables/{_safe(source)}/{_safe(key)}/{record['version']}")
        if check and (held := manifest(df, key, date, df.columns).first()) and (held.digest, held.rows) != (record["digest"], record["rows"]):
            raise ValueError(f"{source}/{key} is not what was saved: {held.rows} rows, {record['rows']} recorded")
        return df

    def discard_old(self, source: str, key: str) -> int:
        """Delete all versions but the current one; how many there were."""
        fs, record = self._fs(), self.record(source, key)
        versions = [s.getPath() for s in fs.listStatus(self._path("tables", _safe(source), _safe(key)))]
        old = [p for p in versions if record is None or p.getName() != record["version"]]
        for p in [*self._records_of(source, key)[:-1], *old]:
            fs.delete(p, True)
        return len(old)


def all_records(store: Store) -> DataFrame:
    """The manifest by source: keys, rows and the range that they span."""
    return store.records().groupBy("source").agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
