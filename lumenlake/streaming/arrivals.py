"""Duplicate groups of a stream of hashes, as they form in order of arrival.

Each arriving hash is sent to its bands and to its exact digest.  Keyed state holds what has arrived there, so a hash
meets the few that share a band with it and reads no earlier input; matches come out once, in the first band that the
two share.  Each micro-batch then joins its matches to the groups that their partners already have.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.links import roots, settle

EXACT = -1
_STORE = "spark.sql.streaming.stateStore.providerClass"
_MATCH = "user_id bigint, kind string, a bigint, b bigint"
_GROUP = "user_id bigint, kind string, representative bigint, image_id bigint"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in a store with keys of its own; the setting is put back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _edges(band: int, bands: int, total: int) -> tuple[int, int]:
    return band * total // bands, (band + 1) * total // bands


def _band(h: Column, band: int, bands: int, words: int) -> Column:
    """The bits of one band of a hash (array of longs, the lowest bit of the first word first), as text."""
    lo, hi = _edges(band, bands, words * 64)
    parts = []
    while lo < hi:
        word, at = divmod(lo, 64)
        take = min(hi - lo, 64 - at)
        value = F.shiftrightunsigned(F.get(h, F.lit(word)), at)
        parts.append((value if take == 64 else value.bitwiseAND(F.lit((1 << take) - 1))).cast("string"))
        lo += take
    return F.concat_ws(",", *parts)


class _Meetings(StatefulProcessor):
    """What has arrived at one band or digest of an owner."""

    def __init__(self, limit: int, words: int):
        self.limit, self.words = limit, words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "id bigint, h array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        owner, band, _ = key
        known = [(int(i), list(h)) for i, h in self.seen.get()]
        fresh = sorted((int(r["image_id"]), [int(x) for x in r["h"]]) for r in rows)
        if band == EXACT:
            return self._exact(owner, known, fresh)
        self.seen.appendList([(i, h) for i, h in fresh])
        return self._near(owner, band, known, fresh)

    def _exact(self, owner, known, fresh) -> Iterator[Row]:
        # the first of a digest stands for all; a second entry tells that the group exists
        if len(known) < 2:
            self.seen.put([(i, []) for i, _ in (known + fresh)[:2]])
        out = [] if len(known) > 1 or len(known) + len(fresh) < 2 else [(known + fresh)[0][0]]
        first = (known + fresh)[0][0]
        out += [i for i, _ in fresh if i != first]
        return iter([Row(user_id=owner, kind="EXACT", a=first, b=i) for i in out])

    def _near(self, owner, band, known, fresh) -> Iterator[Row]:
        if not known and len(fresh) < 2:
            return
        ids = np.array([i for i, _ in known + fresh])
        bits = np.array([h for _, h in known + fresh], np.int64).reshape(len(ids), -1).view(np.uint64)
        for k in range(len(known), len(ids)):
            differ = bits[:k] ^ bits[k]
            near = np.flatnonzero(np.bitwise_count(differ).sum(1) <= self.limit)
            for j in near.tolist():
                if self._first_band(differ[j]) == band:
                    yield Row(user_id=owner, kind="NEAR", a=int(ids[j]), b=int(ids[k]))

    def _first_band(self, differ: np.ndarray) -> int:
        whole = sum(int(x) << 64 * w for w, x in enumerate(differ.tolist()))
        bands = self.limit + 1
        for band in range(bands):
            lo, hi = _edges(band, bands, self.words * 64)
            if not whole >> lo & ((1 << hi - lo) - 1):
                return band
        return bands


def meetings(hashes: DataFrame, limit: int, words: int) -> DataFrame:
    """(user_id, kind, a, b) of a stream of (user_id, image_id, sha256, h): EXACT (first, other), with (first, first)
    once, and NEAR pairs of hashes that differ in `limit` bits at most, a having arrived before b.

    Ids rise in order of arrival.  State is kept per owner and band, so an owner of any size is spread."""
    bands = [F.struct(F.lit(k).alias("band"), _band(F.col("h"), k, limit + 1, words).alias("value")) for k in range(limit + 1)]
    exact = F.struct(F.lit(EXACT).alias("band"), F.col("sha256").alias("value"))
    each = hashes.select("user_id", "image_id", "h", F.explode(F.array(exact, *bands)).alias("at"))
    keyed = each.select("user_id", "at.band", "at.value", "image_id", "h").groupBy("user_id", "band", "value")
    return keyed.transformWithState(_Meetings(limit, words), _MATCH, "append", "none")


def _stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What earlier micro-batches wrote to a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < before).drop("batch")


def _grouping(path: str):
    """A foreachBatch function that joins matches to groups.  A batch that runs again replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = settle(batch)
        exact = found.where("kind = 'EXACT'")
        twins = exact.where("a <> b").select("a", "b")
        matches = settle(found.where("kind = 'NEAR'").join(twins, ["a", "b"], "left_anti").select("user_id", "a", "b"))
        known = _stored(spark, f"{path}/homes", "node bigint, root bigint", number)
        # the group of a match is that of its own first match, whether that came now or earlier
        parent = matches.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        home = known.select(F.col("node").alias("root"), F.col("root").alias("__home"))
        parent = settle(parent.join(home, "root", "left").select("node", F.coalesce("__home", "root").alias("root")))
        parent = roots(parent)
        old = known.join(matches.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        home = parent.unionByName(old).select(F.col("node").alias("a"), F.col("root").alias("representative"))
        joined = matches.join(home, "a", "left").select("user_id", F.lit("NEAR").alias("kind"), F.coalesce("representative", "a").alias("representative"), F.col("b").alias("image_id"))
        founders = joined.select("user_id", "kind", "representative", F.col("representative").alias("image_id"))
        rows = exact.select("user_id", "kind", F.col("a").alias("representative"), F.col("b").alias("image_id")).unionByName(joined).unionByName(founders)
        rows.distinct().write.mode("overwrite").parquet(f"{path}/groups/batch={number}")
        parent.write.mode("overwrite").parquet(f"{path}/homes/batch={number}")

    return each


def start(hashes: DataFrame, path: str, limit: int, words: int) -> StreamingQuery:
    """Group all that the stream has, under path: checkpoint, groups and the first group of each image.  Started again
    with the same path, it goes on with what is new."""
    with keyed_state(hashes.sparkSession):
        stream = meetings(hashes, limit, words).writeStream.foreachBatch(_grouping(path)).option("checkpointLocation", f"{path}/checkpoint")
        return stream.outputMode("append").trigger(availableNow=True).start()


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, kind, representative, image_id): the groups so far, as duplicates.arrival_groups() has them."""
    return _stored(spark, f"{path}/groups", _GROUP, 2**62).distinct()
