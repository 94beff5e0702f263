"""Zero-shot classification and threshold calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import dot, guarded
from . import order
from .common import few

# Calibration grids.
THRESHOLDS = [round(i / 100, 2) for i in range(5, 50)]
TEMPERATURES = [0.3, 0.4, 0.5, 0.6, 0.75, 1.0]
CONFIDENCES = [0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5]


def centroids(vectors: DataFrame, key: str = "category") -> DataFrame:
    """Mean vector per key, position by position."""
    parts = vectors.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("centre"))


#: Prototypes that every vector is compared with at most.
MOST_PROTOTYPES = 10_000


def class_scores(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Every vector against every prototype (slug, centre), which go to all tasks once they are counted."""
    return vectors.join(few(prototypes, MOST_PROTOTYPES)).withColumn("score", dot("v", "centre")).drop("centre", "v")


def softmax(scores: DataFrame, keys: list[str], temperature: float | Column = 1.0) -> DataFrame:
    """scores with `confidence`: a softmax over the rows of each key, shifted by the best, to 4 places."""
    w = Window.partitionBy(*keys)
    t = F.lit(float(temperature)) if isinstance(temperature, int | float) else temperature
    e = F.exp((F.col("score") - F.max("score").over(w)) / t)
    return scores.withColumn("__e", e).withColumn("confidence", F.round(F.col("__e") / F.sum("__e").over(w), 4)).drop("__e")


def classify(vectors: DataFrame, prototypes: DataFrame, temperature: float = 1.0, floor: float = 0.20, most: int = 2, fallback="other") -> DataFrame:
    """Per image its classes above the floor, two at most and never the fallback; else the fallback with
    its own confidence, or 1 if there is no prototype for it."""
    scored = softmax(class_scores(vectors, prototypes), ["image_id"], temperature)
    w = Window.partitionBy("image_id")
    place = F.row_number().over(w.orderBy(((F.col("slug") == fallback) | (F.col("confidence") <= floor)).cast("int"), F.desc("confidence"), F.asc("slug")))
    good = (F.col("slug") != fallback) & (F.col("confidence") > floor)
    ranked = scored.withColumns({"rn": place, "__good": F.sum(good.cast("int")).over(w), "__own": F.max(F.when(F.col("slug") == fallback, F.col("confidence"))).over(w)})
    hits = ranked.where((F.col("slug") != fallback) & (F.col("confidence") > floor) & (F.col("rn") <= most)).select("image_id", "slug", "confidence", "rn")
    rest = ranked.where("__good = 0").groupBy("image_id").agg(F.coalesce(F.max("__own"), F.lit(1.0)).alias("confidence"))
    slug_type = scored.schema["slug"].dataType
    return hits.unionByName(rest.select("image_id", F.lit(fallback).cast(slug_type).alias("slug"), "confidence", F.lit(1).alias("rn")))


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Categories (image_id, slug) that a new classification does not have any more."""
    return old.join(new.select("image_id", "slug"), ["image_id", "slug"], "left_anti")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What re-classification would drop and add, without writing anything."""
    return stale(old, new).withColumn("change", F.lit("drop")).unionByName(stale(new, old).withColumn("change", F.lit("add")))


def score_stats(pairs: DataFrame) -> DataFrame:
    """Per class of pairs (relevant, score): n, mean, deviation, extremes and quartiles.  With a column `n`, a row
    stands for n pairs.

    A percentile is the sorted value at floor(p x n), the last at most, found by refined histograms, so that no task
    sorts a class or the pairs of one score."""
    pairs = _weighed(pairs)
    quartiles = order.pivoted(order.ranked_values(pairs, "relevant", "score", (0.25, 0.5, 0.75), count="n"), "relevant", "score", {0.25: "p25", 0.5: "p50", 0.75: "p75"})
    plain = pairs.groupBy("relevant").agg(F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
    means = F.broadcast(plain.select(F.col("relevant").alias("__of"), "mean"))
    apart = pairs.join(means, F.col("relevant").eqNullSafe(F.col("__of"))).groupBy("relevant")
    spread = apart.agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("mean"), 2) * F.col("n")) / F.sum("n")).alias("std"))
    for part in (spread, quartiles):
        part = part.withColumnRenamed("relevant", "__of")
        plain = plain.join(part, plain["relevant"].eqNullSafe(part["__of"])).drop("__of")
    return plain.select("relevant", "n", "mean", "std", "low", "p25", "p50", "p75", "high")


def _weighed(pairs: DataFrame) -> DataFrame:
    return pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1).cast("long"))


def both_classes(pairs: DataFrame) -> DataFrame:
    """pairs, if some are relevant and some are not; ValueError if not, as nothing can be calibrated then."""
    if {r["relevant"] for r in pairs.select("relevant").distinct().collect()} < {True, False}:
        raise ValueError("calibration needs relevant pairs and others")
    return pairs


def threshold_sweep(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall and F1 of score >= threshold for each threshold, from one pass over the pairs.

    Pairs are counted by how many thresholds they reach, and those few counts are summed per threshold.
    With a column `n`, a row stands for n pairs.  Without predicted pairs precision is 1, without relevant ones recall is 1, without either F1 is 0."""
    spark, steps = pairs.sparkSession, sorted(thresholds)
    reached = reduce(lambda a, b: a + b, ((F.col("score") >= F.lit(float(t))).cast("int") for t in steps))
    counts = _weighed(pairs).groupBy(reached.alias("reached"), "relevant").agg(F.sum("n").alias("c"))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(steps)], "step int, threshold double")
    rows = grid.join(counts)
    hit = F.col("reached") > F.col("step")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0))

    sums = rows.groupBy("threshold").agg(total(hit & F.col("relevant")).alias("tp"), total(hit & ~F.col("relevant")).alias("fp"), total(~hit & ~F.col("relevant")).alias("tn"), total(~hit & F.col("relevant")).alias("fn"))
    rates = sums.withColumns({"precision": guarded(F.col("tp"), F.col("tp") + F.col("fp"), 1), "recall": guarded(F.col("tp"), F.col("tp") + F.col("fn"), 1)})
    return rates.withColumn("f1", guarded(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0))


def best(sweep: DataFrame, score: str = "f1", by: str = "threshold") -> DataFrame:
    """The row of the greatest score; of equal ones the first."""
    return sweep.orderBy(F.desc(score), F.asc(by)).limit(1)


def _grid(spark: SparkSession, name: str, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def temperature_sweep(scores: DataFrame, temperatures: list[float] = TEMPERATURES) -> DataFrame:
    """Top-1 accuracy and mean confidence of the expected class per temperature.

    scores: image_id, expected, slug, score."""
    rows = softmax(scores.join(F.broadcast(_grid(scores.sparkSession, "temperature", temperatures))), ["temperature", "image_id"], F.col("temperature"))
    place = F.row_number().over(Window.partitionBy("temperature", "image_id").orderBy(F.desc("score"), F.asc("slug")))
    own = rows.withColumn("rn", place).where("slug = expected")
    return own.groupBy("temperature").agg(F.avg((F.col("rn") == 1).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))


def confidence_sweep(scores: DataFrame, temperature: float | DataFrame, floors: list[float] = CONFIDENCES, fallback=None) -> DataFrame:
    """Per floor: recall of the expected class among those that survive, and how often the best survivor
    is the expected one (0 without survivors).

    temperature: a number, or a frame of one row with that column, such as best() of temperature_sweep().
    A class of `fallback` never survives."""
    if isinstance(temperature, DataFrame):
        rows = softmax(scores.join(F.broadcast(temperature.select("temperature").limit(1))), ["image_id"], F.col("temperature"))
    else:
        rows = softmax(scores, ["image_id"], temperature)
    rows = rows.join(F.broadcast(_grid(scores.sparkSession, "floor", floors)))
    real = F.lit(True) if fallback is None else F.col("slug") != fallback
    lives = (F.col("confidence") >= F.col("floor")) & real
    per = rows.groupBy("floor", "image_id").agg(
        F.max(F.when(F.col("slug") == F.col("expected"), lives)).alias("kept"),
        F.max_by("slug", F.when(real, F.struct("score", -F.col("slug").cast("double")))).alias("top"),
        F.max(F.when(lives, 1).otherwise(0)).alias("any"),
        F.max("expected").alias("expected"),
    )
    return per.groupBy("floor").agg(
        F.avg(F.coalesce(F.col("kept"), F.lit(False)).cast("double")).alias("recall"),
        F.count_if(F.col("any") == 1).alias("survivors"),
        guarded(F.count_if((F.col("any") == 1) & (F.col("top") == F.col("expected"))).cast("double"), F.count_if(F.col("any") == 1), 0).alias("precision"),
    )
