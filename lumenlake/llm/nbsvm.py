"""Quality classifier: Naive Bayes support vectors.

A document is the set of its n-grams: byte trigrams, words, and one- to three-grams of word shapes
(capitals, digits, symbols, whether the word repeats the one before).  N-grams are hashed into a fixed
number of features.  Each indicator is scaled by its class log-count ratio, and a linear hinge-loss
model over them is fit by dual coordinate descent.  Margins become probabilities by Platt scaling on
labelled documents that the fit left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _text
from ._store import bound_batches, materialize, tidy

FEATURE_BITS = 18
#: The classifier is fit on at most so many labelled documents of each class, chosen by a hash of doc_id.
CLASS_ROWS = 3_000
#: Score from which a document is predicted to be of quality.
THRESHOLD = 0.3

#: Distinct features that the documents of one class hold at most in the fit: 80 MB on the driver.
CLASS_FEATURES = 20_000_000

#: Per byte a count of capitals, small letters, digits and symbols, 16 bits each.
_COUNTS = np.zeros(256, np.uint64)
for _at, _chars in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,'-"])):
    _COUNTS[list(_chars)] = 1 << 16 * _at


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A byte per word: its capitals, digits and symbols, and whether it repeats the word before."""
    counts = np.add.reduceat(_COUNTS[data], starts)  # what stands between words counts as nothing
    upper, lower, digit, mark = ((counts >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4))
    shape = ((upper > 1) & (lower == 0)) | ((upper > 0) & (lower > 0)) << 1 | (digit > 0) << 2 | np.minimum(mark, 3).astype(np.int64) << 3 | same << 5 | (mark == (ends - starts).astype(np.uint64)) << 6
    return shape.astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct feature of at most SLICE_ROWS texts, sorted by both.

    Goes by windows of bytes and runs of words, so that a long text needs no more than a slice and its words."""
    n = len(offsets) - 1
    held = [np.zeros(0, np.uint32)]

    def add(rows: np.ndarray, feats: np.ndarray) -> None:
        held.append(_text.distinct(rows.astype(np.uint32) << np.uint32(FEATURE_BITS) | feats.astype(np.uint32)))
        if n == 1 and len(held) > 20:
            held[:] = [_text.distinct(np.concatenate(held))]

    def hashed(grams: np.ndarray, kind: int) -> np.ndarray:
        return _text.mix(grams + np.uint64(kind << 56)) >> np.uint64(64 - FEATURE_BITS)

    for lo, hi in _text.windows(len(data) - 2):
        row = np.repeat(np.arange(n, dtype=np.uint16), np.diff(np.clip(offsets, lo, hi + 2)))
        part = data[lo : hi + 2].astype(np.uint32)
        grams = (part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(32 - FEATURE_BITS)
        inner = row[:-2] == row[2:]
        add(row[:-2][inner], grams[inner])
    starts, ends, at = _text.spans(data, offsets, _text.NON_SPACE)
    first = 0
    while first < len(starts):
        upto = max(first + 1, int(np.searchsorted(ends, starts[first] + _text.SLICE_BYTES, "right")))
        back = max(0, first - 3)  # a gram of three words and the word before it
        lo, own = int(starts[back]), slice(back, upto)
        text, s, e = data[lo : int(ends[upto - 1])], starts[own] - lo, ends[own] - lo
        words = _text.span_hashes(text, s, e)
        row = np.repeat(np.arange(n, dtype=np.uint16), np.diff(np.clip(at, back, upto)))
        add(row, hashed(words, 2))
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        shape, skip = _shapes(text, s, e, same), int(back > 0)  # the first word's neighbour is out of sight
        for size in (1, 2, 3):
            count = len(shape) - size + 1
            if count > skip:
                gram = np.zeros(count, np.uint64)
                for k in range(size):
                    gram = (gram << np.uint64(8)) | shape[k : count + k]
                one = row[:count] == row[size - 1 :]
                one[:skip] = False
                add(row[:count][one], hashed(gram[one], 2 + size))
        first = upto
    found = _text.distinct(np.concatenate(held))
    return (found >> np.uint32(FEATURE_BITS)).astype(np.int64), (found & np.uint32((1 << FEATURE_BITS) - 1)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the normalised feature counts of class 1 over those of class 0."""
    counts = [np.full(1 << FEATURE_BITS, smooth) for _ in range(2)]
    for feats, label in zip(rows, labels, strict=True):
        counts[int(label)][feats] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of min 1/2 |w|^2 + cost x sum of hinge losses, by dual coordinate descent."""
    y = np.where(labels > 0, 1.0, -1.0)
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] == 0:
                continue
            gradient = y[i] * float(weights[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def platt(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a x margin + b))), by Newton's method on smoothed targets."""
    ones, zeros = weights[labels > 0].sum(), weights[labels == 0].sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        slope, curve = weights * (p - target), weights * p * (1 - p) + 1e-9
        g = np.array([slope @ margins + 1e-6 * a, slope.sum()])
        h = np.array([[curve @ margins**2 + 1e-6, curve @ margins], [curve @ margins, curve.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """weights: per feature, its ratio times its weight; margins are means over root-n features."""

    weights: np.ndarray
    a: float
    b: float

    def margins(self, row: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(row, minlength=n), 1)
        return np.bincount(row, self.weights[feats], n) / np.sqrt(size)

    def scores(self, row: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(row, feats, n) + self.b, -35, 35)))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, priors: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on feature lists.  priors weigh the classes of a sample back to their shares.

    With one class only, or none, every score is the smoothed share of class 1."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << FEATURE_BITS), 1.0, math.log(share / (1 - share)))

    def train(chosen: np.ndarray) -> np.ndarray:
        own = [rows[i] for i in chosen]
        ratios = log_count_ratios(own, labels[chosen])
        values = [(ratios[f] / math.sqrt(max(1, len(f)))).astype(np.float32) for f in own]
        return ratios * dual_descent(own, values, labels[chosen], 1 << FEATURE_BITS)

    order = np.random.default_rng(3).permutation(len(rows))
    margins = np.zeros(len(rows))
    for part in (order[0::2], order[1::2]):  # each half is scaled by the model of the other
        rest = np.setdiff1d(order, part)
        half = Model(train(rest), 1.0, 0.0)
        for i in part:
            margins[i] = half.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    a, b = platt(margins, labels, np.where(labels > 0, priors[1], priors[0]))
    return Model(train(np.arange(len(rows))), a, b)


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, folds: int = 5, class_features: int = CLASS_FEATURES) -> Model:
    """Fit on the labelled documents (labels: doc_id, quality) outside fold 0 of crc32(doc_id as text).

    At most class_rows of each class are used, those of the least hash of doc_id, and of them as many as
    hold class_features distinct features; texts count whole.  Labels of null are left out; a doc_id
    labelled more than once counts as 1 if any of its labels is 1.  Repeated rows of a document count
    each; an empty table, or one class alone, gives one score for all.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0
    known = labels.where("quality is not null and doc_id is not null").where(training).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows)
        sample = part if sample is None else sample.unionByName(part)

    @tidy
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _text.each_slice(batch.column(2)):
                row, feats = features(data, offsets)
                each = np.split(feats.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(each, pa.list_(pa.int32()))], ["doc_id", "quality", "features"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    lists = materialize(chosen.mapInArrow(listed, "doc_id long, quality int, features array<int>"), "quality-features")
    upto = F.sum(F.size("features")).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    bounded = lists.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < class_features).drop("upto")
    table = bounded.toArrow().sort_by("doc_id")
    lists = table["features"].combine_chunks()
    rows = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if table.num_rows else []
    used = {label: max(1, int((table["quality"].to_numpy() == label).sum())) for label in totals}
    return fit_rows(rows, table["quality"].to_numpy(), tuple(totals.get(k, 1) / used.get(k, 1) for k in (0, 1)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """docs with (in place of columns of these names) score (0 to 1), predicted (1 from threshold on) and held_out (fold 0; false for a null
    doc_id).  A null text scores as an empty one, which has no features but the bias.  Each row is judged by
    its text alone, so repeated rows score alike; an empty table gives none; a long text is taken in pieces."""
    docs = docs.drop("score", "predicted", "held_out")
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in _text.each_slice(batch.column(at)):
                out[i:j] = shared.value.scores(*features(data, offsets), j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return docs.mapInArrow(scored, schema).withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": held_out})
