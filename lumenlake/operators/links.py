"""Forests and connected components as joins of whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenlake-")
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df without its lineage, by a checkpoint in the folder that all machines share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def roots(parent: DataFrame) -> DataFrame:
    """parent (node, root) with every chain followed to its end; a node that is its own root ends one.

    Each round doubles the steps, so a chain of n nodes takes about log2 n rounds."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        above = F.coalesce("__up", "root")
        after = settle(parent.join(up, "root", "left").select("node", above.alias("root"), (above != F.col("root")).alias("__moved")))
        parent = after.select("node", "root")
        if after.where("__moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """Per node of edges (a, b) the least node of its component: (node, root).

    Every node hangs on its least neighbour, chains are followed, and the edges between what is left go on.
    Minima combine before the shuffle, so a node of very many edges is no large task."""
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = roots(settle(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))))
        if label is None:
            label = hung
        else:
            later = hung.select(F.col("node").alias("root"), F.col("root").alias("__later"))
            label = settle(label.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(hung.select(F.col("node").alias(end), F.col("root").alias("__root")), end).drop(end).withColumnRenamed("__root", end)
        edges = settle(edges.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if label is None else label
