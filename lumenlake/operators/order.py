"""Exact order statistics by histograms that are refined where the wanted ranks are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import settle

#: Cells of a histogram, and rows of a cell up to which its values are counted one by one.
CELLS, FEW = 4_096, 65_536


def ranked_values(df: DataFrame, key: str, value: str, places, cells: int = CELLS, few: int = FEW, count: str | None = None) -> DataFrame:
    """(key, place, value): per key the value at rank floor(n x place), from 0 and n - 1 at most, of its n values in
    ascending order; nulls and NaN are no values.  count: a column that tells how many times a row's value stands.

    A pass over the rows counts the cells of a histogram for each wanted rank and tells the least and greatest value
    of each; the next pass looks into the cell that has the rank.  A cell of one value needs no more, and one of few
    rows has its values counted.  Only counts of cells are shuffled, and a rank's cell is a row on the driver, so equal
    and crowded values are no large task.  Keys and places are few; the rows are written down for the passes."""
    rows = settle(df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"), (F.lit(1) if count is None else F.col(count)).cast("long").alias("w")).where("x is not null and not isnan(x)"))
    spark, kinds = df.sparkSession, df.schema[key].dataType.simpleString()
    ends = rows.groupBy("k").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    # wanted: (key, place) -> the rank inside its open cell, and the cell: its least and greatest value and its rows
    wanted = {(e["k"], float(p)): (min(e["n"] - 1, int(e["n"] * p)), (e["lo"], e["hi"], e["n"])) for e in ends for p in places}
    found = []
    while True:
        found += [(k, p, lo) for (k, p), (_, (lo, hi, _)) in wanted.items() if lo == hi]
        wanted = {w: c for w, c in wanted.items() if c[1][0] != c[1][1]}
        if not wanted:
            break
        open_ = sorted({(k, lo, hi, n <= few) for (k, _), (_, (lo, hi, n)) in wanted.items()}, key=str)
        cut = F.broadcast(spark.createDataFrame([(i, *c) for i, c in enumerate(open_)], f"i int, k {kinds}, lo double, hi double, whole boolean"))
        inside = rows.join(cut, rows["k"].eqNullSafe(cut["k"]) & (rows["x"] >= cut["lo"]) & (rows["x"] <= cut["hi"]))
        # halves first, as the range of doubles is wider than a double
        at = F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells)
        cell = F.when(F.col("whole"), F.col("x")).otherwise(F.least(at, F.lit(cells - 1)).cast("double"))
        counts: dict[tuple, list] = {c: [] for c in open_}
        for c in inside.groupBy("i", cell.alias("cell")).agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            counts[open_[c["i"]]].append((c["lo"], c["hi"], c["n"]))
        for (k, p), (rank, (lo, hi, n)) in wanted.items():
            for one in sorted(counts[k, lo, hi, n <= few]):
                if rank < one[2]:
                    wanted[k, p] = (rank, one)
                    break
                rank -= one[2]
    return spark.createDataFrame(found, f"`{key}` {kinds}, place double, `{value}` double")


def pivoted(ranked: DataFrame, key: str, value: str, names: dict[float, str]) -> DataFrame:
    """ranked_values() with a column per place."""
    picks = [F.max(F.when(F.col("place") == p, F.col(value))).alias(n) for p, n in names.items()]
    return ranked.groupBy(key).agg(*picks)
