"""Scopes, paging, ranking and table maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from . import commits


def live(images: DataFrame) -> DataFrame:
    return images.where(~F.col("deleted"))


def completed(images: DataFrame) -> DataFrame:
    """Live images whose processing is complete; roll-ups and clustering count these only."""
    return live(images).where(F.col("status") == "COMPLETED")


def where_all(df: DataFrame, **equal) -> DataFrame:
    """df filtered by the arguments that are not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def until_second_59(c: Column | str, first: str, last: str) -> Column:
    """A closed range of days whose last instant is 23:59:59, to the second."""
    col = F.col(c) if isinstance(c, str) else c
    return (col >= F.expr(f"TIMESTAMP_NTZ'{first} 00:00:00'")) & (col <= F.expr(f"TIMESTAMP_NTZ'{last} 23:59:59'"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each key in the given total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


#: Rows of a shuffle that one task takes, about, where a plan says in how many tasks it is dealt.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as `rows` rows need, so that a task's share does not grow with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


# The most rows that a page of each kind has, and the rows of a page without a wish.
MOST_ROWS = {"search": 100, "people": 50, "events": 50, "documents": 200, "previews": 10, "page": 100}
DEFAULT_ROWS = 50


def page_size(wanted: int | None, kind: str = "page") -> int:
    """The rows of a page: what is wanted, between 1 and the most of its kind."""
    return max(1, min(DEFAULT_ROWS if wanted is None else wanted, MOST_ROWS[kind]))


def page_offset(page: int, size: int) -> int:
    """The rows before a page; pages count from 1."""
    return (max(1, page) - 1) * size


def page_totals(total: Column, page: int, size: int) -> dict[str, Column]:
    """pages and has_more of a listing of `total` rows."""
    pages = F.ceil(total / size)
    return {"pages": pages, "has_more": F.lit(page) < pages}


def known_year(year: int, this_year: int) -> int:
    """year, if it lies between 2000 and the next one; ValueError if not."""
    if not 2000 <= year <= this_year + 1:
        raise ValueError(f"a year between 2000 and {this_year + 1} is wanted, not {year}")
    return year


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: DataFrame | None = None) -> DataFrame:
    """One page of df after the cursor row, with `has_next`.

    order: (column, descending) pairs; nulls come first if descending and last if ascending.  cursor: one
    row with those columns, itself left out.  One row more than the page is read to know of a next one.
    """
    sort = [F.desc_nulls_first(c) if d else F.asc_nulls_last(c) for c, d in order]
    if cursor is not None:
        at = cursor.select(*[F.col(c).alias(f"__{c}") for c, _ in order]).limit(1)
        after = F.lit(False)
        equal = F.lit(True)
        for c, descending in order:
            here, there = F.col(c), F.col(f"__{c}")
            if descending:
                later = F.when(there.isNull(), here.isNotNull()).otherwise(F.coalesce(here < there, F.lit(False)))
            else:
                later = F.when(here.isNull(), there.isNotNull()).otherwise(F.coalesce(here > there, F.lit(False)))
            after = after | (equal & later)
            equal = equal & here.eqNullSafe(there)
        df = df.join(F.broadcast(at), after, "inner").drop(*[f"__{c}" for c, _ in order])
    probe = df.orderBy(*sort).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*sort))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return probe.withColumns({"__place": place, "has_next": total > limit}).where(F.col("__place") <= limit).drop("__place")


def counted_children(parents: DataFrame, children: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """parents with one count per condition over their children; 0 for the childless."""
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]
    return parents.join(children.groupBy(key).agg(*sums), key, "left").fillna(0, list(conditions))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def patch(points: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """points with the columns that changes has besides the keys in place of their own, where changes has the row
    and a value; other rows, and points that are not there, are left alone."""
    new = [c for c in changes.columns if c not in keys]
    joined = points.join(changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in new]), keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in points.columns])


def remove(points: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """points without those of the keys given."""
    return points.join(ids.select(*keys), keys, "left_anti")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose keys old does not have, ready to be appended."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def count_attempts(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """attempts per key: one more for those seen again, 0 for new ones."""
    mark = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    after = F.when(F.col("attempts").isNull(), 0).when(F.col("__seen"), F.col("attempts") + 1).otherwise(F.col("attempts"))
    return old.select(*keys, "attempts").join(mark, keys, "full_outer").withColumn("attempts", after.cast("int")).drop("__seen")


def soft_delete(images: DataFrame, ids: DataFrame) -> DataFrame:
    """images with `deleted` set for the ids given; nothing is dropped."""
    mark = ids.select("image_id").distinct().withColumn("__gone", F.lit(True))
    return images.join(mark, "image_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """A conditional bulk update as a projection."""
    return df.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


#: Folders that one task writes, about.
TASK_FOLDERS = 100


def dealt_to_folders(df: DataFrame, key: str) -> DataFrame:
    """df dealt to as many tasks as its folders, one for each key, or its rows need; a key of very many rows to several."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__rows"))
    folders, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    tasks = max(1, -(-folders // TASK_FOLDERS), -(-rows // TASK_ROWS))
    if rows <= TASK_ROWS:
        return df.repartition(tasks, key)
    large = sizes.where(F.col("__rows") > TASK_ROWS).select(F.col(key).alias("__key"), F.ceil(F.col("__rows") / TASK_ROWS).alias("__parts"))
    part = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.coalesce("__parts", F.lit(1)))
    placed = df.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("__part", part)
    return placed.repartition(tasks, key, "__part").select(*df.columns)


def replace_tenant(df: DataFrame, path: str, tenant: str = "user_id") -> None:
    """Write df over the partitions of its tenants only; other tenants' files stay.  A tenant's rows are few files, and a
    large tenant is several, which no one task writes alone; many small tenants are written by many tasks.  The driver puts each
    folder in place by itself: for tables of very many tenants there is stored.replace()."""
    dealt_to_folders(df, tenant).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, after: int | None = None) -> int:
    """Write several tables as one version under root: readers see all of them or none.  Returns its number.

    The tables go to a folder of their own; one small file, which must not be there, names it as the last step.  after:
    the version that this one follows, the last unless told; if another writer was first, commits.Conflict is raised
    and readers do not see these tables."""
    known = commits.numbers(spark, f"{root}/published")
    number = (known[-1] + 1 if known else 0) if after is None else after + 1
    version = f"{root}/version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    return commits.commit(spark, f"{root}/published", number, version)


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a published version, the last one unless told."""
    number = commits.numbers(spark, f"{root}/published")[-1] if version is None else version
    return spark.read.parquet(f"{commits.committed(spark, f'{root}/published', number)}/{name}")


def few(df: DataFrame, most: int) -> DataFrame:
    """df to be joined as a copy in every task, after its rows are counted; ValueError if there are more than `most`."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no small side of a join")
    return F.broadcast(df)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fold_by(df: DataFrame, key: str, order: list[Column], fold: Callable[[object, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """An order-dependent fold per key: fold(key, rows) gives the tuples of the result.

    Rows are sorted in the JVM and come as Arrow batches of many keys, so that small groups cost no call
    of their own; one key's rows are held at a time.  They must fit a task, so give summaries of what is
    folded, not the items themselves."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    out += fold(held[0][key], held)
                    held = []
                held.append(row)
            yield _batch(names, out)
        if held:
            yield _batch(names, list(fold(held[0][key], held)))

    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
