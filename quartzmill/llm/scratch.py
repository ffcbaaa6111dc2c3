"""Shared scratch space, lineage cuts and worker set-up.

Everything that outlives a task is written below ``spark.checkpoint.dir``,
which every executor and the driver can reach; a lost executor then costs a
re-read, not a re-computation.  Only where the setting is missing (tests in
local mode) a temporary folder of this machine is used instead.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only in local mode without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quartzmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reaches; nothing if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Room:
    """Tables of one computation, in a folder of their own that goes when the ``with`` block ends.

    What is read later, such as a lazy result, must not rest on them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._paths = spark, new_path(spark, "room"), {}

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self._paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)  # the frame is kept, so its id stays its own
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove one of the tables early."""
        delete(self.spark, self._paths[id(df)][1])

    def __enter__(self) -> Room:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)


#: Texts go to Python workers in batches of about this size, which bounds what workers and Arrow hold.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it, and bound their batches."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)i?b?", spark.conf.get(_BATCH_SETTING).lower()).groups()
    size = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library is not glibc
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, and ``release`` when they end."""
    try:
        yield from batches
    finally:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
