"""Shared plumbing: scratch tables in the cluster's shared folder, checked broadcasts, worker caches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the setting is absent."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="placewright-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own_dirs[app]}")
    return f"file://{_own_dirs[app]}"


class Scratch:
    """Written intermediate tables: each cuts the lineage, survives a lost executor, and is
    deleted as soon as its last reader has been written. What a result still reads goes when the
    driver's process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under the scratch folder and return the written table."""
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def tidy(self, *tables: DataFrame) -> None:
        """Delete ``tables``, and let the driver's JVM collect its garbage, upon which Spark deletes
        the shuffle files of queries that are over (as spark.cleaner.periodicGC.interval does)."""
        self.drop(*tables)
        self.spark._jvm.System.gc()

    def _end(self) -> None:
        if self.base.startswith("file:"):  # the JVM may be gone by now
            shutil.rmtree(self.base.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif self.spark.sparkContext._jsc is not None:
            self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count proves it has at most ``max_rows`` rows; else as it
    is, for a shuffled join. Callers keep rows narrow, so rows bound bytes."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so, for joins to a caller's table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts are held as Python strings at once; at the end of a task
    the worker, which is used again, gives freed memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def ascii_lower(text):
    """Lower-case A-Z only, all other code points as they are."""
    return F.translate(text, UPPER, LOWER)
