"""Keyset batches: a table worked on range by range of its key, with a place to go on from after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import exists, put_new

#: Rows of a batch, about.
BATCH_ROWS = 1_000_000


def bounds(df: DataFrame, key: str, rows: int = BATCH_ROWS) -> list:
    """The last key of each range but the last, in order: ranges of about `rows` rows, cut by Spark's sampling.

    Rows of one key are never parted.  One value a batch comes to the driver."""
    parts = max(1, -(-df.count() // rows))
    ranged = df.select(key).where(F.col(key).isNotNull()).repartitionByRange(parts, key)
    ends = ranged.groupBy(F.spark_partition_id()).agg(F.max(key).alias("end")).select("end").orderBy("end").collect()
    return [r["end"] for r in ends][:-1]


def in_range(key: str, ends: list, number: int) -> Column:
    """Whether a row is of a batch, as comparisons with literals that reach the scan; nulls are of the first one, and the
    last has no end, so that each row is of exactly one."""
    c = F.col(key)
    low = F.lit(True) if number == 0 else c > F.lit(ends[number - 1])
    high = F.lit(True) if number == len(ends) else c <= F.lit(ends[number])
    return (low & high) | c.isNull() if number == 0 else low & high


class Stopped(RuntimeError):
    """A run that ended before its last batch, as it was asked to."""


def run(df: DataFrame, key: str, path: str, process: Callable[[DataFrame, int], None], rows: int = BATCH_ROWS, most: int | None = None) -> int:
    """Hand the rows of df to process(batch, number) batch by batch, and return how many batches this run did.

    The ranges are cut once and kept under path, as is a mark for each batch that is done.  A later run with the same
    path leaves those out, so that after a stop at any point no batch is lost; the one that was under way is done
    again, and process() should replace what it wrote for that number.  Rows that come later belong to the range of
    their key.  `most` ends a run after so many batches, by Stopped."""
    spark, did = df.sparkSession, 0
    ends = _kept_bounds(df, key, path, rows)
    for number in range(len(ends) + 1):
        mark = f"{path}/done/{number:010d}"
        if exists(spark, mark):
            continue
        if did == most:
            raise Stopped(f"{did} batches of this run are done, {number} of {len(ends) + 1} in all")
        process(df.where(in_range(key, ends, number)), number)
        put_new(spark, mark, "done")
        did += 1
    return did


def _kept_bounds(df: DataFrame, key: str, path: str, rows: int) -> list:
    spark: SparkSession = df.sparkSession
    if not exists(spark, f"{path}/bounds/_SUCCESS"):
        found = spark.createDataFrame([(e,) for e in bounds(df, key, rows)], df.select(F.col(key).alias("end")).schema)
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return [r["end"] for r in spark.read.parquet(f"{path}/bounds").orderBy("end").collect()]
