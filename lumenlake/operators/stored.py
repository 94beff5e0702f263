"""A stored table that is changed by merges: only the buckets of changed keys are written anew, under a numbered commit.

A commit is one small file that names the folder of each bucket.  Readers follow the last commit, so they see a merge
whole or not at all; a writer that another one overtook is refused, as its number is taken.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits
from .commits import Conflict
from .common import upsert

__all__ = ["Conflict", "create", "merge", "read", "replace"]

#: Buckets of a table unless told; a commit names each.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, root: str, version: int | None) -> dict:
    known = commits.numbers(spark, f"{root}/commits")
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{root} has no version {version}" if known else f"{root} holds no table")
    number = known[-1] if version is None else version
    return json.loads(commits.committed(spark, f"{root}/commits", number)) | {"version": number}


def _write(df: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write df by bucket and return the folder of each one that has rows."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    placed = df.withColumn("__bucket", _bucket(keys, buckets))
    placed.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    names = commits.names(df.sparkSession, folder)
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}


def _commit(spark: SparkSession, root: str, number: int, state: dict) -> int:
    return commits.commit(spark, f"{root}/commits", number, json.dumps({k: state[k] for k in ("keys", "by", "buckets", "schema", "folders")}))


def create(df: DataFrame, root: str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """Write df as version 0 of a table whose rows `keys` tell apart, in buckets of `by` (the keys unless told; a
    subset keeps the rows of an owner together, so that a change of one owner touches one bucket)."""
    by = by or keys
    state = {"keys": keys, "by": by, "buckets": buckets, "schema": json.loads(df.schema.json()), "folders": _write(df, root, by, buckets)}
    return _commit(df.sparkSession, root, 0, state)


def _rows(spark: SparkSession, state: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    folders = [f for b, f in state["folders"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one unless told."""
    return _rows(spark, _state(spark, root, version))


def merge(spark: SparkSession, root: str, new: DataFrame | None = None, gone: DataFrame | None = None, version: int | None = None) -> int:
    """Put the rows of `new` in place of those of equal keys, drop the keys of `gone`, and return the new version.

    Of `new` rows that share a key one should be given.  version: the one that the change is based on, the last unless
    told; if it is not the last any more, nothing changes and Conflict is raised.  Only buckets with changed keys are
    read and written."""
    state = _state(spark, root, version)
    keys, by, buckets = state["keys"], state["by"], state["buckets"]
    touched = _touched([df for df in (new, gone) if df is not None], by, buckets)
    rows = _rows(spark, state, sorted(touched))
    if gone is not None:
        rows = rows.join(gone.select(*keys), keys, "left_anti")
    if new is not None:
        rows = upsert(rows, new.select(*rows.columns), keys)
    return _rewritten(spark, root, state, rows, touched)


def replace(spark: SparkSession, root: str, new: DataFrame, owners: DataFrame | None = None, version: int | None = None) -> int:
    """Put the rows of `new` in place of all rows of their owners (the columns that buckets are of), and return the new version.

    owners: those whose rows go, also where `new` has none for them.  version, and what is read and written: as in merge(),
    so that owners may be many: their rows share the files of their buckets, and no file or folder is one owner's."""
    state = _state(spark, root, version)
    by, buckets = state["by"], state["buckets"]
    gone = new.select(*by) if owners is None else new.select(*by).unionByName(owners.select(*by))
    touched = _touched([gone], by, buckets)
    rows = _rows(spark, state, sorted(touched))
    gone = gone.distinct().toDF(*[f"__{c}" for c in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    rows = rows.join(gone, same, "left_anti").unionByName(new.select(*rows.columns))
    return _rewritten(spark, root, state, rows, touched)


def _touched(changed: list[DataFrame], by: list[str], buckets: int) -> set[str]:
    """The buckets of changed rows."""
    each = [df.select(_bucket(by, buckets).alias("b")).distinct() for df in changed]
    return {str(r["b"]) for df in each for r in df.collect()}  # `buckets` of them at most


def _rewritten(spark: SparkSession, root: str, state: dict, rows: DataFrame, touched: set[str]) -> int:
    """Commit `rows` as all rows of the buckets that are touched."""
    written = _write(rows.select(*T.StructType.fromJson(state["schema"]).names), root, state["by"], state["buckets"]) if touched else {}
    kept = {b: f for b, f in state["folders"].items() if b not in touched}
    return _commit(spark, root, state["version"] + 1, state | {"folders": kept | written})
