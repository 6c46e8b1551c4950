"""Small helpers that the operators share: reading tables, shared scratch tables, shipping code."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, and of one that become Python objects at a time: whole documents are wide.
ARROW_ROWS = 500
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one or two numbers each up to which a counted table is broadcast (24 MB at most).
FEW_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a temporary folder is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brassloom-"))
    return spark.sparkContext.getCheckpointDir()


def save(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to a new table in the shared folder and read it again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that save() wrote and that nothing will read any more."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[tuple[str, int]] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc: SparkContext = spark.sparkContext
    key = (sc.applicationId, id(sc))
    # Batches of Spark's default size take 64 MB of each task, beside and in its Python worker. A session that names a size of its own keeps it.
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, ARROW_ROWS)
    if key in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    fd, path = tempfile.mkstemp(prefix="brassloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(key)


_caches: dict[str, Callable[[], None]] = {}


def cached(name: str, clear: Callable[[], None]) -> None:
    """Tell how to clear what a module keeps in a worker from task to task."""
    _caches[name] = clear


def small_batches(batches: Iterator[pa.RecordBatch], keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices of ARROW_ROWS rows, so that what a task makes of one stays small, whatever size the session asks for.

    Workers outlive their tasks: what operators but ``keep`` have cached goes first, and at the end freed memory goes back to
    the system, beside which the executor's own heap may be full.
    """
    for name, clear in _caches.items():
        if name != keep:
            clear()
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
