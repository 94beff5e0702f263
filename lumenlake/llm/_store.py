"""Where intermediate tables and binary files go, and small session helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch handed to Python, so that long texts never pile up in a worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where Spark runs in
    one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.lumenlake.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.lumenlake.local.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lumenlake/{name}-{uuid.uuid4().hex}"
    if _RECORDED is not None:
        _RECORDED.append(path)
    return path


#: Paths written since a recorded stage began; None outside of one.
_RECORDED: list[str] | None = None
_STALE: list[str] = []


@contextmanager
def recorded(spark: SparkSession) -> Iterator[None]:
    """Note what is written inside, and drop what the recorded block before wrote.

    For stages whose result is written down before the next one begins, like those of a pipeline: what an
    earlier stage needed on its way is of no use any more."""
    global _RECORDED
    drop(spark, _STALE)
    _STALE.clear()
    _RECORDED = _STALE
    try:
        yield
    finally:
        _RECORDED = None


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and the table
    survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 10_000, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as rows for the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trim() -> None:
    """Give freed memory back to the system, where the C library can; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(f):
    """f over Arrow batches, in a worker that first drops what encoders of earlier tasks keep in it, and in the
    end gives back the memory that f has freed."""

    @wraps(f)
    def run(batches):
        encode = sys.modules.get(f"{__package__}._encode")
        if encode and encode.release():
            trim()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def set_aside(df: DataFrame, *keep: str) -> tuple[DataFrame, list]:
    """df with all columns but `keep` under names that no operator uses, and the select list that gives
    them their own names and order back."""
    names = {c: c if c in keep else f"__kept_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]
