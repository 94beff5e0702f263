"""Streaming forms: sessions, the completion barrier, idempotent jobs, rate limits, online clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.events import assign_clusters

# Kinds of messages, and the children that a finished hash job starts.
MESSAGES = ("HASH", "OCR", "EMBEDDING", "CATEGORY", "FACE", "EVENT")
CHILDREN = ("OCR", "EMBEDDING", "CATEGORY", "FACE")


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need timestamps with a zone; the library's have none and are taken as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_sessions(events: DataFrame, time: str, owner: str, gap: str = "6 hours", late: str = "0 seconds") -> DataFrame:
    """Sessions of a stream: they are emitted once the watermark has passed their end."""
    return (
        as_event_time(events, time)
        .withWatermark(time, late)
        .groupBy(owner, F.session_window(time, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
        .select(owner, "n", "first_at", "last_at")
    )


def closed(events: DataFrame, path: str, time: str, owner: str, last) -> DataFrame:
    """A stream of events and, behind them, one event of no owner long after `last`, read from path.

    It moves the watermark over all sessions, so that a finite input leaves none open."""
    spark = events.sparkSession
    row = spark.range(1).select(F.lit(None).cast(events.schema[owner].dataType).alias(owner), (F.lit(last) + F.expr("INTERVAL 1000 DAYS")).cast(events.schema[time].dataType).alias(time))
    row.write.mode("overwrite").parquet(path)
    return events.select(owner, time).unionByName(spark.readStream.schema(row.schema).parquet(path))


def distinct_jobs(jobs: DataFrame, time: str = "queued_at", late: str = "1 hour") -> DataFrame:
    """Each job id once while it is remembered."""
    keyed = as_event_time(jobs, time).withColumn("job_id", F.concat_ws("_", "job_type", F.col("image_id").cast("string")))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["job_id"])


def fan_out(finished: DataFrame) -> DataFrame:
    """The jobs that finished hash jobs start."""
    return finished.where("job_type = 'HASH' and status = 'COMPLETED'").select("image_id", F.explode(F.array(*map(F.lit, CHILDREN))).alias("job_type"), F.lit("QUEUED").alias("status"))


def dispatch(handlers: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each kind of message to its handler; unknown kinds raise."""

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            unknown = batch.where(~F.col("job_type").isin(*handlers)).limit(1).collect()
            if unknown:
                raise ValueError(f"unknown job type {unknown[0]['job_type']!r}")
            for kind, handle in handlers.items():
                handle(batch.where(F.col("job_type") == kind))
        finally:
            batch.unpersist()

    return each


def rate_windows(requests: DataFrame, time: str, owner: str, most: int, width: str = "60 seconds") -> DataFrame:
    """Requests per owner and window, and whether they exceed the limit."""
    timed = as_event_time(requests, time) if requests.schema[time].dataType != T.TimestampType() else requests
    counts = timed.groupBy(owner, F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(owner, F.col("w.start").alias("start_at"), "n", (F.col("n") > most).alias("limited"))


def retain(jobs: DataFrame, order: list, completed: int = 200, failed: int = 500) -> DataFrame:
    """Finished jobs that history keeps: the latest of each type and outcome.

    Each outcome has a limit of its own, so that tasks cut their rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("job_type").orderBy(*order))

    def latest(status: str, most: int) -> DataFrame:
        return jobs.where(F.col("status") == status).withColumn("rn", place).where(F.col("rn") <= most)

    return latest("COMPLETED", completed).unionByName(latest("FAILED", failed))


class _Identities(StatefulProcessor):
    """The faces of an owner so far, in a list that only grows at its end."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "id bigint, v array<double>, cluster bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [(int(i), list(v), int(c)) for i, v, c in self.known.get()]
        fresh = sorted((int(r["image_id"]), [float(x) for x in r["v"]]) for r in rows)
        before = len(known)
        found = assign_clusters(fresh, known, self.threshold)
        self.known.appendList(known[before:])
        return iter([Row(user_id=key[0], image_id=i, cluster_id=c) for i, c in found])


def online_clusters(faces: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Face clusters of a stream (user_id, image_id, v): each owner's faces are kept as state, to which a batch adds its
    own and nothing else is written.  Start it inside arrivals.keyed_state()."""
    rows = faces.select("user_id", "image_id", "v").groupBy("user_id")
    return rows.transformWithState(_Identities(threshold), "user_id bigint, image_id bigint, cluster_id bigint", "append", "none")


def batch_sessions(events: DataFrame, time: str, owner: str, gap: str = "6 hours") -> DataFrame:
    """The same sessions over a bounded table."""
    return (
        as_event_time(events, time)
        .groupBy(owner, F.session_window(time, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
        .select(owner, "n", "first_at", "last_at")
    )
