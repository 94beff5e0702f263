"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def _roots(parent: DataFrame) -> DataFrame:
    """parent (node, root with root < node) with every chain followed to its end."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        followed = materialize(
            parent.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("__moved")),
            "roots",
        )
        moved = followed.where("__moved").limit(1).count()
        parent = followed.select("node", "root")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """Per node of edges (a, b) the smallest node that it reaches: (node, component).

    Each round points every node at its smallest neighbour, if that is smaller, follows the chains,
    and keeps the edges between different roots.  Every remaining root then has an edge to a smaller
    one or is the least of its component, so the rounds are few.  Nothing is collected; minima
    combine before the shuffle, so a node with very many edges makes no large task.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).where("root < node")
        parent = _roots(materialize(nearest, "parents"))
        if found is None:
            found = parent
        else:
            later = parent.select(F.col("node").alias("root"), F.col("root").alias("__later"))
            found = materialize(
                found.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root")).unionByName(parent),
                "components",
            )
        for end in ("a", "b"):
            to = parent.select(F.col("node").alias(end), F.col("root").alias("__to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.select("root").distinct().select(F.col("root").alias("node"), F.col("root"))
    return found.unionByName(least.join(found, "node", "left_anti")).select("node", F.col("root").alias("component")).distinct()
