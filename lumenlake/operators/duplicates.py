"""Exact and near duplicates of images by hashes, and nearest neighbours by vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import hamming_longs
from . import vector_index
from .links import components, roots, settle, shared_folder
from .neighbours import INDEX_ROWS, near_bits, nearest


def exact_groups(items: DataFrame, owner: str = "user_id", key: str = "sha256") -> DataFrame:
    """Groups of equal hashes per owner: the representative (least id) and the number of members."""
    return items.groupBy(owner, key).agg(F.min("image_id").alias("representative"), F.count("*").alias("n")).where("n > 1")


#: Bits of a band at least; with shorter ones most rows would meet, and blocks are compared in full instead.
BAND_BITS = 16
#: Pairs that blocks compare in the time of one that meets by a band.
BLOCK_SPEED = 20


def near_pairs(items: DataFrame, limit: int, words: int, owner: str = "user_id") -> DataFrame:
    """Pairs of an owner whose bit hashes (array of longs `h`) differ in `limit` bits at most.

    Bits are dealt to limit + 1 bands; two hashes within the limit agree in a band at least, so equal
    bands are the join keys and no pair is missed.  Hashes too short for bands of BAND_BITS are compared
    block by block, and so are those that meet by bands more often than once in BLOCK_SPEED pairs of an owner, as
    hashes do many of whose bits hardly differ."""
    total = words * 64
    bands = limit + 1
    if total // bands < BAND_BITS:
        return near_bits(items, limit, owner)
    base = items.select("image_id", owner, "h")

    def bits(band: int):
        lo = band * total // bands
        hi = (band + 1) * total // bands
        parts = []
        while lo < hi:
            word, at = divmod(lo, 64)
            take = min(hi - lo, 64 - at)
            value = F.shiftrightunsigned(F.get("h", F.lit(word)), at)
            parts.append(value if take == 64 else value.bitwiseAND(F.lit((1 << take) - 1)))
            lo += take
        return F.xxhash64(F.lit(band), *parts)

    banded = base.withColumn("band", F.explode(F.array(*[bits(b) for b in range(bands)])))
    if _pairs(banded, owner, "band") * BLOCK_SPEED > _pairs(base, owner):
        return near_bits(items, limit, owner)
    a = banded.select(owner, "band", F.col("image_id").alias("a"), F.col("h").alias("ha"))
    b = banded.select(owner, "band", F.col("image_id").alias("b"), F.col("h").alias("hb"))
    near = a.join(b, [owner, "band"]).where("a < b").withColumn("distance", hamming_longs("ha", "hb")).where(F.col("distance") <= limit)
    return near.select(owner, "a", "b", "distance").distinct()


def _pairs(rows: DataFrame, *keys: str) -> float:
    """How many pairs of rows have equal keys."""
    n = F.count("*").cast("double")
    return rows.groupBy(*keys).agg((n * (n - 1) / 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]


def near_classes(items: DataFrame, limit: int, words: int, owner: str = "user_id") -> DataFrame:
    """(owner, kind, a, b, distance): every image b as a member of the class of its hash, named by the least image a that
    has the same one, and the pairs a < b of classes whose hashes differ in `limit` bits at most.

    Copies, such as blank images, count as one class, so a hash that very many have meets others once."""
    classes = items.groupBy(owner, "h").agg(F.min("image_id").alias("image_id"))
    members = items.select(owner, "h", F.col("image_id").alias("b")).join(classes.withColumnRenamed("image_id", "a"), [owner, "h"])
    members = members.select(owner, F.lit("MEMBER").alias("kind"), "a", "b", F.lit(0).alias("distance"))
    return members.unionByName(near_pairs(classes, limit, words, owner).select(owner, F.lit("NEAR").alias("kind"), "a", "b", "distance"))


def group_pairs(pairs: DataFrame) -> DataFrame:
    """Members of the groups that pairs (a, b) connect: (image_id, group_id), the least id naming a group.

    Batch grouping closes over all pairs; arrival_groups() follows arrival order instead."""
    return components(pairs).select(F.col("node").alias("image_id"), F.col("root").alias("group_id"))


def arrival_groups(items: DataFrame, near: DataFrame, owner: str = "user_id") -> DataFrame:
    """Groups as they form when images arrive in order of id: (owner, kind, representative, image_id).

    items: owner, image_id, sha256; near: pairs a < b within the limit.  An exact twin joins the group of the
    first image with its hash.  Of the near ones each image joins the first group that its match has, or
    founds one that the match represents; the exact match is left out, later twins are not.  What group an
    image has first is its first match's, so following first matches to their end names the groups."""
    first = items.groupBy(owner, "sha256").agg(F.min("image_id").alias("representative"), F.count("*").alias("__n"))
    exact = items.join(first.where("__n > 1"), [owner, "sha256"]).select(owner, F.lit("EXACT").alias("kind"), "representative", "image_id")
    twin = exact.where("representative <> image_id").select(F.col("representative").alias("a"), F.col("image_id").alias("b"))
    matches = settle(near.select(owner, "a", "b").join(twin, ["a", "b"], "left_anti"))
    parent = matches.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    home = roots(settle(parent)).select(F.col("node").alias("a"), F.col("root").alias("representative"))
    joined = matches.join(home, "a", "left").select(owner, F.coalesce("representative", "a").alias("representative"), F.col("b").alias("image_id"))
    founders = joined.select(owner, "representative", F.col("representative").alias("image_id"))
    grouped = joined.unionByName(founders).distinct().select(owner, F.lit("NEAR").alias("kind"), "representative", "image_id")
    return exact.unionByName(grouped)


def replay_groups(arrivals: list[tuple], limit: int) -> list[tuple]:
    """Groups as they form in arrival order, for one owner: (kind, group, representative, member) rows.

    arrivals: (image_id, sha256, bits as an int), in order.  Each image joins the first group of the kind
    that its match has, or founds one that the match represents.  Of several exact twins the first is
    the exact match; the others are near matches like any hash within the limit."""
    rows: list[tuple] = []
    first: dict[tuple, int] = {}
    seen: list[tuple] = []
    groups = 0

    def put(kind: str, image, match) -> None:
        nonlocal groups
        group = first.get((kind, match))
        if group is None:
            groups += 1
            group = groups
            first[kind, match] = group
            rows.append((kind, group, match, match))
        rows.append((kind, group, match, image))
        first.setdefault((kind, image), group)

    for image, sha, bits in arrivals:
        twin = next((i for i, s, _ in seen if s == sha), None)
        if twin is not None:
            put("EXACT", image, twin)
        for other, _, have in seen:
            if other != twin and (have ^ bits).bit_count() <= limit:
                put("NEAR", image, other)
        seen.append((image, sha, bits))
    return rows


def knn_join(items: DataFrame, k: int, owner: str = "user_id", index_rows: int = INDEX_ROWS) -> DataFrame:
    """The k nearest others of every vector within its owner, by dot product: block by block, or by an inverted file where
    there are more than index_rows vectors."""
    if items.count() > index_rows:
        return vector_index.among(items, k, f"{shared_folder(items.sparkSession)}/knn-{uuid.uuid4().hex}", owner)
    return nearest(items, items, k, owner)
