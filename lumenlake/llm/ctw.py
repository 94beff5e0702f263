"""Language-model scores by context-tree weighting over bytes.

A byte is a path of eight binary decisions.  Every decision (the bits already known of the byte) has a
context tree of its own, over the bytes before it, nearest first, down to DEPTH.  A node counts zeros
and ones and estimates by Krichevsky and Trofimov; its weighted probability is half its own estimate
and half the product of its children's.  The mixture over all depths is what predicts.

Counts come from the training documents alone and stay as they are while texts are scored.  A model
row is a gram: DEPTH context bytes and a byte, packed in a long with the nearest context byte on top,
so that contexts of every depth are prefixes of it.  Grams that only scored texts hold are rows too,
with a count of 0; thus every lookup finds its row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import bound_batches, materialize, tidy

#: Context bytes of the deepest nodes.  A gram fills 8 x (DEPTH + 1) = 48 bits of a long.
DEPTH = 5
#: Model rows and words that every task holds; rarer ones are looked up by a join.
LOCAL_GRAMS, LOCAL_WORDS = 4_000_000, 2_000_000
#: Distinct keys that a counting task gathers before it hands them on.
COUNT_KEYS = 3_000_000
#: Depth at which the tree is cut.  What lies below is weighed by groups of equal nearest bytes, which hold
#: 2 ** (8 * (DEPTH - _CUT + 1)) grams at most, however large the corpus is; depth 2 by a groupBy; depths 1
#: and 0 on the driver (256 x 256 nodes).
_CUT = 3
#: Grams that a task weighs together, and nodes of depth 2 that it holds at a time.
WEIGH_ROWS, UPPER_ROWS = 250_000, 1_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the bytes (A-Z as a-z) and the end of every text, and the n + 1 offsets of each text's.

    Before a text stand DEPTH zero bytes; its end is a zero byte."""
    n, total = len(offsets) - 1, len(data)
    flat = np.zeros(total + n * (DEPTH + 1), np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    flat[np.arange(total) + row * (DEPTH + 1) + DEPTH] = _text.LOWER[data]
    keys = flat.copy()
    for back in range(1, DEPTH + 1):
        keys[back:] |= flat[:-back] << np.uint64(8 * (DEPTH + 1 - back))
    scored = np.ones(len(flat), bool)
    begins = offsets[:-1] + np.arange(n) * (DEPTH + 1)
    scored[(begins[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[scored], offsets + np.arange(n + 1)


def gram_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() of a slice; a single text that is longer comes in parts of bounded size."""
    if len(offsets) > 2 or len(data) <= _text.SLICE_BYTES:
        yield grams(data, offsets)
        return
    for lo, hi in _text.windows(len(data)):
        near = data[max(0, lo - DEPTH) : hi]
        keys, _ = grams(near, np.array([0, len(near)]))
        keys = keys[lo - max(0, lo - DEPTH) : len(keys) - (hi < len(data))]
        yield keys, np.array([0, len(keys)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series at x + 8, then back down."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _node_weights(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log weighted probability of inner nodes, and the share of their own estimate in it."""
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, below) - math.log(2)
    return weighted, np.exp(own - math.log(2) - weighted)


def subtree(keys: np.ndarray, counts: np.ndarray, top: int = _CUT) -> tuple[np.ndarray, list[tuple]]:
    """Weigh the trees below the nodes of depth `top`, for the grams of those nodes.

    Returns per gram the eight predictions of its bits from depth `top` on, and per bit the nodes of
    depth `top`: (node key, zeros, ones, log weighted probability)."""
    symbol = (keys & np.uint64(0xFF)).astype(np.int64)
    predictions = np.empty((len(keys), 8))
    tops = []
    for bit in range(8):
        prefix = (symbol >> (8 - bit)) | (1 << bit)
        one = (symbol >> (7 - bit)) & 1
        child_of = child_weighted = None
        trail = []
        for depth in range(DEPTH, top - 1, -1):
            node = ((keys >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8)) | prefix.astype(np.uint64)
            distinct, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            ones = np.bincount(inverse, counts * one, len(distinct))
            zeros = np.bincount(inverse, counts * (1 - one), len(distinct))
            if child_of is None:
                weighted, share = log_kt(zeros, ones), np.ones(len(distinct))
            else:
                below = np.bincount(inverse[child_of], child_weighted, len(distinct))
                weighted, share = _node_weights(zeros, ones, below)
            estimate = (np.where(one, ones[inverse], zeros[inverse]) + 0.5) / (zeros + ones + 1.0)[inverse]
            trail.append((share[inverse], estimate))
            child_of, child_weighted = first, weighted
        mixed = trail[0][1]
        for share, estimate in trail[1:]:
            mixed = share * estimate + (1 - share) * mixed
        predictions[:, bit] = mixed
        tops.append((distinct, zeros, ones, weighted))
    return predictions, tops


class Upper:
    """Nodes of depth 2: sorted keys (two context bytes, known bits with a leading 1), counts and shares."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, share: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.zeros, self.ones, self.share = (x[order] for x in (keys, zeros, ones, share))

    def mixed(self, keys: np.ndarray, predictions: np.ndarray) -> np.ndarray:
        """The predictions of the bits of each gram from depth 2 on, given those from depth 3 on."""
        symbol, out = keys & np.uint64(0xFF), np.empty_like(predictions)
        context = ((keys >> np.uint64(8 * (DEPTH - 1))) << np.uint64(8)).astype(np.int64)
        for bit in range(8):
            prefix = (symbol >> np.uint64(8 - bit)).astype(np.int64) | (1 << bit)
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            at = np.searchsorted(self.keys, context | prefix)
            zeros, ones, share = self.zeros[at], self.ones[at], self.share[at]
            out[:, bit] = share * (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0) + (1 - share) * predictions[:, bit]
        return out


class Root:
    """Depths 0 and 1 of all eight trees: per context byte and known bits, counts and shares."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        """rows: (context byte << 8 | known bits with a leading 1, zeros, ones, log weighted below)."""
        self.zeros, self.ones, below = (np.zeros((256, 256)) for _ in range(3))
        for key, zeros, ones, weighted in rows:
            self.zeros[key >> 8, key & 255], self.ones[key >> 8, key & 255], below[key >> 8, key & 255] = zeros, ones, weighted
        weighted, self.share = _node_weights(self.zeros, self.ones, below)
        self.zeros0, self.ones0 = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        _, self.share0 = _node_weights(self.zeros0, self.ones0, weighted.sum(axis=0))

    def log10(self, keys: np.ndarray, predictions: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability, given its bits' predictions from depth 2 on."""
        symbol = (keys & np.uint64(0xFF)).astype(np.int64)
        context = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        out = np.zeros(len(keys))
        for bit in range(8):
            prefix = (symbol >> (8 - bit)) | (1 << bit)
            one = ((symbol >> (7 - bit)) & 1).astype(bool)
            zeros, ones = self.zeros[context, prefix], self.ones[context, prefix]
            estimate = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            share = self.share[context, prefix]
            mixed = share * estimate + (1 - share) * predictions[:, bit]
            zeros, ones = self.zeros0[prefix], self.ones0[prefix]
            estimate = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            share = self.share0[prefix]
            out += np.log10(share * estimate + (1 - share) * mixed)
        return out


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    counts = np.concatenate([c for _, c in held])
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


class _Gather:
    """Adds up counts by key; hands them on when it holds too many."""

    def __init__(self, kind: int):
        self.kind, self.held, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > COUNT_KEYS:
            self.held = [_merge(self.held)]
            self.size = len(self.held[0][0])
            if self.size > COUNT_KEYS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts = _merge(self.held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["kind", "key", "n"])
        self.held, self.size = [], 0


def _with_fold(docs: DataFrame, folds: int) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return docs.select("doc_id", "text", fold.alias("held_out"))


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all of docs (doc_id, text, held_out): kind 0 are grams, n counts those of
    training documents; kind 1 are word hashes of training documents."""
    bound_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_grams, of_words = _Gather(0), _Gather(1)
        for batch in batches:
            held_out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in _text.each_slice(batch.column(1)):
                for keys, at in gram_parts(data, offsets):
                    tagged = (keys << np.uint64(1)) | np.repeat(held_out[i:j], np.diff(at)).astype(np.uint64)
                    distinct, n = np.unique(tagged, return_counts=True)
                    yield from of_grams.add(distinct >> np.uint64(1), np.where(distinct & np.uint64(1), 0, n))
                words, at = _text.word_hashes(data, offsets, _text.NON_SPACE)
                distinct, n = np.unique(words[np.repeat(~held_out[i:j], np.diff(at))], return_counts=True)
                yield from of_words.add(distinct, n)
        yield from of_grams.rest()
        yield from of_words.rest()

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(counted, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def model(gram_counts: DataFrame, upper_rows: int = UPPER_ROWS) -> DataFrame:
    """(key, n) of grams -> (key, n, value): log10 of the gram's probability in its context."""
    spark = gram_counts.sparkSession
    shift = 8 * (DEPTH + 1 - _CUT)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; whole groups of the _CUT nearest context bytes are weighed, many at a time."""
        held: list[pa.RecordBatch] = []
        rows, wanted = 0, WEIGH_ROWS

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
            predictions, tops = subtree(keys, n.astype(float))
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), len(keys), [None, pa.py_buffer(predictions)]).cast(pa.binary())
            yield _weighed_batch(0, keys, n, np.zeros(len(keys)), np.zeros(len(keys)), bits)
            for node, zeros, ones, weighted in tops:
                yield _weighed_batch(1, node, zeros.astype(np.int64), ones, weighted, pa.nulls(len(node), pa.binary()))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= wanted:
                table = pa.Table.from_batches(held)
                group = table["key"].to_numpy() >> shift
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield from flush(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), rows - last
                wanted = max(WEIGH_ROWS, 2 * rows)
        if rows:
            yield from flush(pa.Table.from_batches(held))

    ordered = gram_counts.select("key", "n").repartition(F.shiftright("key", shift)).sortWithinPartitions("key")
    rows = materialize(ordered.mapInArrow(weighed, "kind int, key long, n long, ones double, weighted double, bits binary"), "ctw-nodes")

    def above(nodes: DataFrame) -> DataFrame:
        """Sums over the nodes (context bytes, then known bits) that agree but for the farthest context byte."""
        key = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
        return nodes.groupBy(key.alias("key")).agg(*(F.sum(c).alias(c) for c in ("n", "ones", "weighted")))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, zeros, ones, below = (c.to_numpy() for c in batch.columns)
            weighted, share = _node_weights(zeros.astype(float), ones, below)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weighted), pa.array(share)], ["key", "n", "ones", "weighted", "share"])

    second = materialize(above(rows.where("kind = 1")).mapInArrow(shared, "key long, n long, ones double, weighted double, share double"), "ctw-upper")
    root = Root([tuple(r) for r in above(second).select("key", "n", "ones", "weighted").collect()])

    def finisher(upper):
        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                data, _ = _text.utf8(batch.column(2))
                predictions = np.ascontiguousarray(data).view(np.float64).reshape(-1, 8)
                value = root.log10(keys, upper.value.mixed(keys, predictions)) if len(keys) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["key", "n", "value"])

        return finished

    # nodes of depth 2 go to the tasks in parts of upper_rows, 2 ** 24 / upper_rows at most; the grams of a
    # part have their nodes in it
    parts = max(1, -(-second.count() // upper_rows))
    found: DataFrame | None = None
    for part in range(parts):
        own = F.pmod(F.xxhash64("context"), F.lit(parts)) == part
        table = second.withColumn("context", F.shiftright("key", 8)).where(own).select("key", "n", "ones", "share").toArrow()
        key, zeros, ones, share = (c.to_numpy() for c in table.columns)
        upper = spark.sparkContext.broadcast(Upper(key, zeros.astype(float), ones, share))
        some = rows.where("kind = 0").withColumn("context", F.shiftright("key", 8 * (DEPTH - 1))).where(own).select("key", "n", "bits")
        done = some.mapInArrow(finisher(upper), "key long, n long, value double")
        found = done if found is None else found.unionByName(done)
    return found


def _weighed_batch(kind: int, keys, n, ones, weighted, bits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(ones), pa.array(weighted), bits],
        ["kind", "key", "n", "ones", "weighted", "bits"],
    )


def _common(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Keys and values of the most frequent rows of (key, n, value), `most` at most, sorted by key; and
    the other rows, if any.  Rows of like counts stay together."""
    level = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    total, least, left = 0, None, False
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if total + row["count"] > most:
            left = True
            break
        total, least = total + row["count"], row["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), table if left else None
    near = table.where(level >= least).select("key", "value").toArrow()
    keys, values = near["key"].to_numpy(), near["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], table.where(level < least) if left else None


def _lookup(keys: np.ndarray, rows: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Per row (of n, in ascending order in `rows`): the sum of the values found and their number; per
    row the distinct keys that were not found and how often each occurs."""
    known, values = table
    distinct, inverse = np.unique(keys, return_inverse=True)
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        found = known[at] == distinct
        value = np.where(found, values[at], 0.0)
    else:
        found, value = np.zeros(len(distinct), bool), np.zeros(len(distinct))
    hit = found[inverse]
    sums = np.bincount(rows, value[inverse], n)
    hits = np.bincount(rows, hit, n).astype(np.int64)
    missing, times = [[] for _ in range(n)], [[] for _ in range(n)]
    lost = np.flatnonzero(~hit)
    if len(lost):
        for row, part in zip(*_runs(rows[lost], keys[lost]), strict=True):
            some, often = np.unique(part, return_counts=True)
            missing[row], times[row] = some, often
    return sums, hits, missing, times


def _runs(rows: np.ndarray, keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cut = np.flatnonzero(np.diff(rows)) + 1
    return rows[np.concatenate([[0], cut])].tolist(), np.split(keys, cut)


_SCORED = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, grams array<long>, gram_times array<long>, words array<long>, word_times array<long>"


def score(docs: DataFrame, folds: int = 10, local_grams: int = LOCAL_GRAMS, local_words: int = LOCAL_WORDS, upper_rows: int = UPPER_ROWS) -> DataFrame:
    """Per document of docs (doc_id, text, ...): held_out, n_tokens, n_known, train_tokens, base_score,
    score and bits_per_byte (the code length of text and end, per byte of text; null for no bytes).

    crc32(doc_id as text) mod folds is 0 for held-out documents; a null doc_id counts as training.
    base_score is a smoothed unigram of words and ends, score the model's log10 probability of the
    text's bytes and its end.  Null texts are empty.  With no training document every probability
    falls back to its prior.  Equal rows stay rows of their own; other columns of docs do not matter,
    whatever their names; an empty table gives no rows.  Long texts are taken in parts.
    """
    spark = docs.sparkSession
    folded = _with_fold(docs, folds)
    found = materialize(counts(folded), "lm-counts")
    ends = folded.where("not held_out").count()
    words = found.where("kind = 1").select("key", "n", F.log10(F.col("n") + 0.1).alias("value"))
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train, vocabulary = n_words + ends, distinct + (ends > 0)
    gram_table = materialize(model(found.where("kind = 0"), upper_rows), "lm-model")
    *near_grams, far_grams = _common(gram_table, local_grams)
    *near_words, far_words = _common(words, local_words)
    shared = spark.sparkContext.broadcast((tuple(near_grams), tuple(near_words)))
    end_value = math.log10(ends + 0.1)

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_grams, of_words = shared.value
        for batch in batches:
            for i, j, data, offsets in _text.each_slice(batch.column(1)):
                n = j - i
                total, lost, lost_times = np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
                for keys, at in gram_parts(data, offsets):
                    more, _, some, often = _lookup(keys.view(np.int64), np.repeat(np.arange(n), np.diff(at)), n, of_grams)
                    total += more
                    for row in range(n):
                        if len(some[row]):
                            lost[row] = np.concatenate([lost[row], some[row]]).astype(np.int64)
                            lost_times[row] = np.concatenate([lost_times[row], often[row]]).astype(np.int64)
                hashes, at = _text.word_hashes(data, offsets, _text.NON_SPACE)
                base, known, rare, rare_times = _lookup(hashes.view(np.int64), np.repeat(np.arange(n), np.diff(at)), n, of_words)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        batch.column(2).slice(i, n),
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(at) + 1),
                        pa.array(known + (ends > 0)),
                        pa.array(base + end_value),
                        pa.array(total),
                        *(pa.array(x, lists) for x in (lost, lost_times, rare, rare_times)),
                    ],
                    ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "grams", "gram_times", "words", "word_times"],
                )

    rows = materialize(folded.mapInArrow(scored, _SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    extra = []
    for far, keys, times, value in ((far_grams, "grams", "gram_times", "more_score"), (far_words, "words", "word_times", "more_base")):
        each = rows.where(F.size(keys) > 0).select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("x")).select("row", "x.key", "x.times")
        if keys == "grams" and far is None:
            continue  # every gram of a scored text is a row of the model
        if far is None:
            far = words.where("false")
        absent = math.log10(0.1) if keys == "words" else 0.0
        each = each.join(far.select("key", "value"), "key", "left")
        extra.append(each.groupBy("row").agg(F.sum(F.col("times") * F.coalesce("value", F.lit(absent))).alias(value), F.sum(F.when(F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias(f"n_{value}")))
    for one in extra:
        rows = rows.join(one, "row", "left")
    more_score = F.coalesce("more_score", F.lit(0.0)) if "more_score" in rows.columns else F.lit(0.0)
    score_ = F.col("score") + more_score
    norm = math.log10(train + 0.1 * (vocabulary + 1))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_more_base", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        score_.alias("score"),
        F.when(F.col("n_bytes") > 0, -score_ / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
