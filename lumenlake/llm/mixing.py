"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size.  Its
integer part is taken as it is; the fraction is rounded by pairing documents and moving mass (words)
at random from one to the other until one of them is integral.  A pair's summed mass never changes,
so a source's taken words stay at its target but for the one document that is left over at the end.
Buckets round on their own; what each leaves over meets in a reduction tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _text
from ._store import bound_batches, materialize, set_aside, tidy

#: Weights dealt to the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents per bucket of the first level (about), and buckets that one node of the tree combines.
BUCKET_ROWS, FAN_IN = 1_000, 64
_EPS = 1e-9

_ROUNDED = "n_row long, doc_id long, source string, size long, base long, p double, bucket long, nodes long, done boolean"


def with_size(docs: DataFrame) -> DataFrame:
    """docs with `size` (in place of one that it has): the number of runs of other characters than space
    and \\t-\\r; null has 0."""
    docs = docs.drop("size")
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("size", T.LongType())])
    at = docs.columns.index("text")

    @tidy
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in _text.each_slice(batch.column(at)):
                out[i:j] = np.diff(_text.spans(data, offsets, _text.NON_SPACE)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "size"])

    return docs.mapInArrow(sized, schema)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source its weight and target: share x all sizes dealt by weight, none above most x its size.

    Capping a source hands its excess to the others by weight, so the targets are
    min(most x size, level x weight) for one common level.  Sources ordered by cap / weight reach
    their caps in that order; the level is the first at which the rest of the budget suits the rest
    of the weights.  One row per source: the table has as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * share - before) / left
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    return (
        capped.withColumn("level", level)
        .withColumn("level", F.max(open_).over(whole))
        .select("source", "source_size", "nodes", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def _noise(key: int, seed: int) -> float:
    """A uniform number in [0, 1) that depends on nothing but the key and the seed."""
    x = (key * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def pivot(p_a: float, s_a: float, p_b: float, s_b: float, u: float) -> tuple[float, float]:
    """Move mass between two fractional documents until one has probability 0 or 1.

    Either a gains what b can give, or b gains what a can give; the odds of the two outcomes make
    the expected probabilities the ones given.  p_a s_a + p_b s_b stays as it is.
    """
    up = min((1 - p_a) * s_a, p_b * s_b)
    down = min(p_a * s_a, (1 - p_b) * s_b)
    move = up if u * (up + down) < down else -down
    return _clean(p_a + move / s_a), _clean(p_b - move / s_b)


def _clean(p: float) -> float:
    return 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def round_rows(keys: list[int], sizes: list[int], ps: list[float], seed: int, last: bool, reserve: int = 2) -> list[float]:
    """Round the fractions of one source's rows, which come largest first.

    All are paired and rounded at random, but for `reserve` rows of each power of two of sizes.  What
    is left over, and those few, stay fractional for the next level of the tree; at the last one each
    takes the integer that brings the source nearest to its target, from the largest to the smallest.
    """
    out = [_clean(p) for p in ps]
    open_ = [i for i, p in enumerate(out) if 0 < p < 1]
    kept, held = set(), {}
    for i in reversed(open_):
        size = sizes[i].bit_length()
        held[size] = held.get(size, 0) + 1
        if held[size] <= reserve:
            kept.add(i)
    free = [i for i in open_ if i not in kept]
    waiting: int | None = None
    for i in free:
        if waiting is None:
            waiting = i
            continue
        j = waiting
        out[j], out[i] = pivot(out[j], sizes[j], out[i], sizes[i], _noise(keys[i] ^ (keys[j] << 1), seed))
        waiting = j if 0 < out[j] < 1 else i if 0 < out[i] < 1 else None
    if last:
        error = 0.0
        rest = kept if waiting is None else kept | {waiting}
        for i in sorted(rest, key=lambda i: (-sizes[i], i)):
            up, down = error + (1 - out[i]) * sizes[i], error - out[i] * sizes[i]
            out[i], error = (1.0, up) if abs(up) < abs(down) else (0.0, down)
    return out


def _rounder(seed: int):
    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (bucket, source), largest first; such a node is held whole, and is bounded."""
        held: dict[str, list] = {}
        schema = None

        def flush() -> pa.RecordBatch:
            last = held["nodes"][0] == 1
            ps = round_rows(held["n_row"], held["size"], held["p"], seed, last)
            done = [last or not 0 < p < 1 for p in ps]
            return pa.RecordBatch.from_pydict({**held, "p": ps, "done": done}, schema=schema)

        for batch in batches:
            schema = batch.schema
            rows = batch.to_pydict()
            node = list(zip(rows["bucket"], rows["source"], strict=True))
            cuts = [0, *[i for i in range(1, len(node)) if node[i] != node[i - 1]], len(node)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and (held["bucket"][0], held["source"][0]) != node[lo]:
                    yield flush()
                    held = {}
                for name, values in rows.items():
                    held.setdefault(name, []).extend(values[lo:hi])
        if held:
            yield flush()

    return rounded


def copies(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per document of docs (doc_id, source, text, ...): size, source_size, target, `copies` and n_row, its row key.

    Equal inputs give equal results: buckets and random numbers depend on the row key alone, a hash of
    doc_id, source, size and text, never on how Spark split the input.  A source of null is a source like
    others.  Rows of equal doc_id count as different documents, and are dealt to buckets by their texts; a
    document without words gets no copy.  Other columns of docs do not matter, whatever their names; an empty
    table gives no rows; a long text counts whole.  Shuffled are ids, sources, sizes and hashes, never texts.
    """
    sized = with_size(docs.select("doc_id", "source", "text")).withColumn("n_row", row_key())
    sized = materialize(sized.select("n_row", "doc_id", "source", "size"), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / bucket_rows).alias("nodes"))
    target = materialize(targets(per_source, share, most, weights), "mix-targets")
    nodes = target.agg(F.max("nodes")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = (
        sized.join(F.broadcast(target) if target.count() <= 100_000 else target, sized.source.eqNullSafe(target.source), "left")
        .drop(target.source)
        .withColumn("base", F.floor(ratio + _EPS).cast("long"))
        .withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
        .withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
        .withColumn("base", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0).cast("long")))
        .withColumn("bucket", F.pmod("n_row", "nodes"))
        .withColumn("done", F.lit(False))
        .select("n_row", "doc_id", "source", "size", "base", "p", "bucket", "nodes", "done")
    )
    done, level = [], start
    while True:
        out = materialize(_level(level, seed), "mix-level")
        done.append(out.where("done"))
        if nodes == 1:
            break
        nodes, seed = -(-nodes // fan_in), seed + 1
        level = out.where("not done").withColumn("nodes", F.ceil(F.col("nodes") / fan_in)).withColumn("bucket", F.pmod("bucket", "nodes"))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    return (
        rounded.join(F.broadcast(target) if target.count() <= 100_000 else target, rounded.source.eqNullSafe(target.source), "left")
        .select("n_row", "doc_id", rounded.source, "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))
    )


def row_key() -> Column:
    """A hash of doc_id, source, size and text, which tells rows of one doc_id apart."""
    return F.xxhash64("doc_id", "source", "size", F.xxhash64("text"))


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """Round each node, a bucket of one source; a large source has as many more of them."""
    ordered = rows.repartition("bucket", "source").sortWithinPartitions("bucket", "source", F.col("size").desc(), "n_row", "doc_id")
    return ordered.mapInArrow(_rounder(seed), _ROUNDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it.

    Rows that agree in doc_id, source and text share their summed copies evenly; what is left over goes to the
    first of them in the order of their other columns, so that reruns agree.
    """
    others = [f"__kept_{i}" for i, f in enumerate(docs.schema) if f.name not in ("doc_id", "source", "text") and not isinstance(f.dataType, T.MapType | T.VariantType)]
    docs, restored = set_aside(docs, "doc_id", "source", "text")
    plan = copies(docs, **options).groupBy("n_row").agg(F.sum("copies").alias("__total"), F.count("*").alias("__rows"))
    keyed = with_size(docs).withColumn("n_row", row_key())
    turn = F.row_number().over(Window.partitionBy("n_row").orderBy("doc_id", *others))
    each = F.floor(F.col("__total") / F.col("__rows")) + (F.col("__turn") <= F.col("__total") % F.col("__rows")).cast("long")
    return (
        keyed.join(plan.where("__total > 0"), "n_row")
        .withColumn("__turn", turn)
        .withColumn("__copies", each.cast("int"))
        .where("__copies > 0")
        .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*restored)
    )
