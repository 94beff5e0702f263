"""Small files that are there once: marks of what is done, and numbered commits."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The file is there already: another writer was first."""


def file_of(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = file_of(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    where, fs = file_of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there; Conflict if it is."""
    where, fs = file_of(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise Conflict(path) from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the commits in a folder, in order."""
    return [int(n) for n in names(spark, folder) if n.isdigit()]


def commit(spark: SparkSession, folder: str, number: int, text: str) -> int:
    put_new(spark, f"{folder}/{number:010d}", text)
    return number


def committed(spark: SparkSession, folder: str, number: int) -> str:
    return "\n".join(r["value"] for r in spark.read.text(f"{folder}/{number:010d}").collect())
