"""Values that run along the rows of an owner, for owners of any size.

A window holds all rows of an owner in one task.  Here the rows are cut into ranges of (owner, order) that Spark
balances; a window runs inside each range, a row per range tells what the next one has to know, and that is
carried over.  Results are those of one window per owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .links import settle

#: Rows of one owner up to which a plain window is used.
WINDOW_ROWS = 1_000_000


def has_large_owner(items: DataFrame, owner: str, rows: int | None = None) -> bool:
    """Whether an owner has more rows than one task should sort."""
    sizes = items.groupBy(owner).agg(F.count("*").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) > (WINDOW_ROWS if rows is None else rows)


def ranges(items: DataFrame, owner: str, order: list[str], parts: int | None = None) -> DataFrame:
    """items with `__part`: ranges of about equal size in the order of owner and `order`, which tells rows apart.

    They are written down, as a later run could cut them elsewhere."""
    parts = parts or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(items.repartitionByRange(parts, owner, *order).withColumn("__part", F.spark_partition_id()))


def _carried(parts: DataFrame, owner: str, ends: list[Column], carry: dict[str, Column]) -> DataFrame:
    """parts with what the ranges of the same owner before each one hand on: a row per owner and range is joined."""
    per = parts.groupBy(owner, "__part").agg(*ends)
    by_part = Window.partitionBy(owner).orderBy("__part")
    told = per.select(F.col(owner).alias("__owner"), F.col("__part").alias("__range"), *[c.over(w(by_part)).alias(n) for n, (c, w) in carry.items()])
    return parts.join(told, parts[owner].eqNullSafe(told["__owner"]) & (parts["__part"] == told["__range"])).drop("__owner", "__range")


def with_previous(parts: DataFrame, owner: str, order: list[str], value: Column, name: str) -> DataFrame:
    """parts (of ranges()) with the value of the row before, which no row lacks; null for an owner's first row.

    value must not fall along the order, as a time in order of time does not."""
    own = parts.withColumn("__value", value)
    carried = _carried(own, owner, [F.max("__value").alias("__end")], {"__carry": (F.lag("__end"), lambda w: w)})
    inside = Window.partitionBy(owner, "__part").orderBy(*order)
    return carried.withColumn(name, F.coalesce(F.lag("__value").over(inside), "__carry")).drop("__value", "__carry")


def with_running(parts: DataFrame, owner: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """parts (of ranges()) with running sums, the row itself included; nulls add nothing, and before the first
    value a sum is null."""
    own = parts.withColumns({f"__{n}": c for n, c in sums.items()})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(own, owner, [F.sum(f"__{n}").alias(f"__{n}_end") for n in sums], {f"__{n}_carry": (F.sum(f"__{n}_end"), before) for n in sums})
    inside = Window.partitionBy(owner, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = carried
    for n in sums:
        here, carry = F.sum(f"__{n}").over(inside), F.col(f"__{n}_carry")
        out = out.withColumn(n, F.coalesce(here + carry, here, carry))
    return out.drop(*[f"__{n}{end}" for n in sums for end in ("", "_carry")])
