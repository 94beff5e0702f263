"""Nearest vectors by an inverted file: cells around coarse centres, written by cell, owner and time.

Centres are fit on a bounded sample; every row is assigned to its nearest one and written.  A search looks into the
cells nearest to a query, or, to be exact, into all that can hold a better vector than those found so far.
Owner and time are filters of the scan: cells are folders, and owner and time are sorted inside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .links import settle
from .neighbours import nearest

#: Rows that the centres are fit on at most, cells of an index at most, and rounds of fitting.
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 20_000, 4_096, 12


@dataclass
class Index:
    """A written index: its folder, the centre of each cell, and how far its farthest vector is from it."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def fit(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means over at most sample_rows vectors, chosen by a hash of their ids; about the root of the
    number of rows unless given.  Only that sample comes to the driver."""
    cells = cells or max(1, int(vectors.count() ** 0.5))
    sample = vectors.where("v is not null").select("image_id", "v").orderBy(F.xxhash64("image_id"), "image_id").limit(sample_rows).toArrow()
    points = _matrix(sample["v"].combine_chunks()) if sample.num_rows else np.zeros((1, 1))
    cells = min(cells, MOST_CELLS, len(np.unique(points, axis=0)))
    # starts far apart: each next one is the point that is farthest from all before
    first, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(first) < cells:
        first.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[first[-1]]) ** 2).sum(1))
    centres = points[first]
    for _ in range(rounds):
        home = _nearest_centre(points, centres)[0]
        n = np.bincount(home, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(after, centres):
            break
        centres = after
    return centres


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its distance."""
    square = (centres**2).sum(1)
    home = np.concatenate([np.argmin(square - 2 * points[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])
    return home, np.sqrt(((points - centres[home]) ** 2).sum(1))


def build(vectors: DataFrame, path: str, centres: np.ndarray | None = None, owner: str = "user_id", time: str | None = "taken_at") -> Index:
    """Write the index of vectors (image_id, owner, time, v) and return it; time may be None.  Rows without a vector are
    left out.

    A cell of many rows is several files, which no one task writes alone."""
    spark = vectors.sparkSession
    centres = fit(vectors) if centres is None else centres
    shared = spark.sparkContext.broadcast(centres)
    rows = vectors.where("v is not null").select("image_id", F.col(owner).alias("owner"), (F.col(time) if time else F.lit(None).cast("timestamp")).alias("at"), "v")
    schema = "image_id {}, owner {}, at {}, v array<double>, cell int, far double".format(*(rows.schema[c].dataType.simpleString() for c in ("image_id", "owner", "at")))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, far = _nearest_centre(_matrix(b.column(3)), shared.value) if b.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(far)], [*b.schema.names, "cell", "far"])

    placed = rows.withColumn("v", F.col("v").cast("array<double>")).mapInArrow(assigned, schema)
    # an even deal by cell, owner and time: ranges split a cell where it is large
    placed.repartitionByRange("cell", "owner", "at", "image_id").sortWithinPartitions("cell", "owner", "at").write.mode("overwrite").partitionBy("cell").parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    radii = np.zeros(len(centres))
    for r in kept.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radii[r["cell"]] = r["far"]
    return Index(kept, centres, radii)


def _cells(queries: DataFrame, index: Index, probes: int, rest: bool = False) -> DataFrame:
    """(image_id, owner, v, cell): the `probes` cells of each query whose centres have the greatest product with it;
    with `rest` the others that can hold a vector of at least the query's `least` score."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radii))
    names = ["image_id", "owner", "v", "least"]
    kinds = [queries.schema[c].dataType.simpleString() for c in names]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            points = _matrix(b.column(2))
            score = points @ centres.T
            order = np.argsort(-score, axis=1, kind="stable")
            pick = np.zeros(score.shape, bool)
            np.put_along_axis(pick, order[:, :probes], True, axis=1)
            if rest:
                bound = score + np.sqrt((points**2).sum(1))[:, None] * radii * (1 + 1e-9) + 1e-9
                pick = ~pick & (bound >= b.column(3).to_numpy(zero_copy_only=False)[:, None])
            row, cell = np.nonzero(pick)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:3]), pa.array(cell, pa.int32())], [*names[:3], "cell"])

    return queries.select(*names).mapInArrow(chosen, ", ".join(f"{n} {k}" for n, k in zip(names[:3], kinds)) + ", cell int")


def _slot(n: int, by_owner: bool) -> Column:
    """A number for a cell, or for a cell and owner."""
    return F.col("cell").cast("long") + (F.col("owner").cast("long") * n if by_owner else 0)


def _looked_at(index: Index, cells: DataFrame, condition: Column | None) -> DataFrame:
    """The rows of the cells that are asked for, and of no others, that meet the condition."""
    some = [r["cell"] for r in cells.select("cell").distinct().collect()]  # MOST_CELLS at most
    rows = index.rows.where(F.col("cell").isin(some))
    return rows if condition is None else rows.where(condition)


def search(
    index: Index, queries: DataFrame, k: int, probes: int | None = 8, by_owner: bool = True, condition: Column | None = None, floor: float | None = None, earlier: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The k best vectors for each query (image_id, owner, v) by dot product, never itself, as (a, b, score, rn), and how
    many rows were compared with each query, as (a, rows_read).

    Only rows of the query's owner count if by_owner, and those that meet the condition, on `at`, `owner` or
    `image_id`, which reaches the scan.  probes: cells looked into; None is exact: after 8 cells those that can
    still hold one of the k best are looked into too.  floor: the least score, by which cells are left out from the
    start; earlier: only rows of lesser ids count."""
    exact, probes, n = probes is None, probes or 8, len(index.centres)
    asked = queries.select("image_id", "owner", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("double").alias("least"))

    def compared(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        cells = settle(cells.withColumn("slot", _slot(n, by_owner)))
        rows = _looked_at(index, cells, condition).withColumn("slot", _slot(n, by_owner))
        sizes = rows.groupBy("slot").agg(F.count("*").alias("rows"))
        read = cells.select("image_id", "slot").join(sizes, "slot").groupBy(F.col("image_id").alias("a")).agg(F.sum("rows").alias("rows_read"))
        found = nearest(cells.select("slot", "image_id", "v"), rows.select("slot", "image_id", "v"), k, "slot", earlier).select("a", "b", "score", "rn")
        return found if floor is None else found.where(F.col("score") >= floor), read

    if exact and floor is not None:
        return compared(_cells(asked.withColumn("least", F.lit(float(floor))), index, 0, rest=True))
    found, read = compared(_cells(asked, index, probes))
    if exact:
        found = settle(found)
        least = found.where(F.col("rn") == k).select(F.col("a").alias("image_id"), F.col("score").alias("__least"))
        again = asked.join(least, "image_id", "left").withColumn("least", F.coalesce("__least", F.lit(float("-inf"))))
        more, further = compared(_cells(again, index, probes, rest=True))
        both = found.select("a", "b", "score").unionByName(more.select("a", "b", "score"))
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.asc("b")))
        found = both.withColumn("rn", place).where(F.col("rn") <= k)
        read = read.unionByName(further).groupBy("a").agg(F.sum("rows_read").alias("rows_read"))
    return found, read


def among(items: DataFrame, k: int, path: str, owner: str = "user_id", floor: float | None = None, earlier: bool = False) -> DataFrame:
    """(owner, a, b, score, rn) as neighbours.nearest(items, items, k, owner, earlier) gives it, for scores of floor at
    least: by an index of the items, so that a vector meets the cells that can matter and not all vectors."""
    built = build(items, path, owner=owner, time=None)
    found, _ = search(built, items.select("image_id", F.col(owner).alias("owner"), "v"), k, None, True, None, floor, earlier)
    return items.select(owner, F.col("image_id").alias("a")).join(found, "a").select(owner, "a", "b", "score", "rn")


def probes_for(index: Index, queries: DataFrame, k: int, least: float = 0.97, by_owner: bool = True, condition: Column | None = None, sample: int = 200) -> int:
    """The fewest cells that give a recall of `least` for a sample of the queries, chosen by a hash of their ids and
    compared with an exact search.  Only the sample and its neighbours' cells come to the driver."""
    some = settle(queries.orderBy(F.xxhash64("image_id"), "image_id").limit(sample))
    found, _ = search(index, some, k, None, by_owner, condition)
    homes = found.select("a", F.col("b").alias("image_id")).join(index.rows.select("image_id", "cell"), "image_id").select("a", "cell").toArrow()
    ids = some.select("image_id", F.col("v").cast("array<double>").alias("v")).toArrow()
    if not homes.num_rows:
        return 1
    order = np.argsort(-(_matrix(ids["v"].combine_chunks()) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in the order in which a query looks into cells
    row = {i: n for n, i in enumerate(ids["image_id"].to_pylist())}
    needed = np.sort([place[row[a], c] + 1 for a, c in zip(homes["a"].to_pylist(), homes["cell"].to_pylist())])
    return int(needed[max(0, int(np.ceil(least * len(needed))) - 1)])


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, wanted, recall): the share of wanted rows (a, b) that are found."""
    hit = found.select("a", "b").distinct().withColumn("hit", F.lit(1))
    joined = wanted.select("a", "b").join(hit, ["a", "b"], "left")
    return joined.groupBy("a").agg(F.count("*").alias("wanted"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
