"""Event clustering: time buckets, then order-dependent merges over bucket summaries."""

from __future__ import annotations

import math
import uuid
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_KM, haversine, haversine_km, missing
from ..functions.vector import dot, l2_normalize, norm
from . import scan, vector_index
from .common import completed, fold_by
from .links import roots, settle, shared_folder
from .neighbours import INDEX_ROWS, nearest

# Gaps, distances and thresholds of the clustering.
GAP_HOURS, LEAST_IMAGES = 6, 3
PLACE_KM, PLACE_DAYS = 50.0, 2
LOOK_COSINE, LOOK_DAYS, LOOK_IMAGES = 0.82, 7, 10
FACE_SHARED, FACE_DAYS = 2, 30
VISIT_KM = 50.0


def sessions(items: DataFrame, time: str, gap_hours: float = GAP_HOURS, owner: str = "user_id", key: str = "image_id", window_rows: int | None = None) -> DataFrame:
    """items with `bucket` (from 0 per owner): a gap of more than gap_hours starts a new one.

    An owner of more than window_rows rows is not sorted in one task, but in ranges that carry their ends over."""
    micros, gap = F.unix_micros(F.col(time).cast("timestamp")), int(gap_hours * 3_600_000_000)
    if scan.has_large_owner(items, owner, window_rows):
        parts = scan.with_previous(scan.ranges(items, owner, [time, key]), owner, [time, key], micros, "__before")
        new = F.when(micros - F.col("__before") > gap, 1).otherwise(0)
        return scan.with_running(parts, owner, [time, key], {"bucket": new}).drop("__before", "__part")
    order = Window.partitionBy(owner).orderBy(time, key)
    starts = F.when(micros - F.lag(micros).over(order) > gap, 1).otherwise(0)
    return items.withColumn("__new", starts).withColumn("bucket", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_means(items: DataFrame, time: str, owner: str = "user_id", key: str = "image_id", window_rows: int | None = None) -> DataFrame:
    """items with `n`, `sum_lat` and `sum_lng` of the rows with a place up to each, in order of time; the sums are null
    before the first.  Large owners are cut into ranges, as in sessions()."""
    sums = {"n": F.when(F.col("lat").isNotNull(), 1).otherwise(0), "sum_lat": F.col("lat"), "sum_lng": F.col("lng")}
    if scan.has_large_owner(items, owner, window_rows):
        return scan.with_running(scan.ranges(items, owner, [time, key]), owner, [time, key], sums).drop("__part")
    along = Window.partitionBy(owner).orderBy(time, key).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumns({name: F.sum(c).over(along) for name, c in sums.items()})


def time_buckets(images: DataFrame) -> DataFrame:
    """Bucket summaries of completed images per owner: images in order, start, end and mean place.

    Undated images of an owner make one last bucket without a place, if there are three or more.
    Coordinates are null together or not at all (see schema.faults)."""
    good = completed(images)
    dated = sessions(good.where("taken_at is not null"), "taken_at")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("taken_at", "image_id"))), lambda x: x["image_id"])
    buckets = dated.groupBy("user_id", "bucket").agg(
        F.count("*").alias("n"), ordered.alias("images"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng")
    )
    undated = good.where("taken_at is null").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("image_id")).alias("images")).where(F.col("n") >= LEAST_IMAGES)
    none = undated.select("user_id", F.lit(2**40).alias("bucket"), "n", "images", *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("start_at", "end_at")], *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng")])
    return buckets.withColumn("bucket", F.col("bucket").cast("long")).unionByName(none)


def _bands(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height)


def _columns(band: Column, height: float) -> Column:
    """Cells of a band of latitude around the globe, each as wide as it is high at the band's edge nearest a pole."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / height)).cast("long")


def spatial_cells(lat: Column, lng: Column, km: float, reach: bool) -> Column:
    """The cells of a place, as an array of (band, column): its own or, with reach, all in which a place within km may be.

    Bands of latitude are km high.  Each is cut into cells that are no narrower; around the poles there is one.
    What is within km lies within asin(sin(km) / cos(lat)) of longitude, or anywhere if a pole is within km."""
    height = km / 111.0  # a degree is a little longer, so a band is a little higher than km
    own = _bands(lat, height)
    around = F.pmod(lng + 180, F.lit(360.0))

    def cell(band: Column, east: Column) -> Column:
        n = _columns(band, height)
        return F.struct(band.cast("long").alias("band"), F.least(F.floor(east * n / 360), n - 1).cast("long").alias("column"))

    if not reach:
        return F.array(cell(own, around))
    angle = km / EARTH_KM
    near_pole = F.abs(lat) + math.degrees(angle) >= 90
    span = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(angle)) / F.cos(F.radians(lat)))))) * (1 + 1e-9) + 1e-9

    def cells(step: Column) -> Column:
        band = own + step
        n = _columns(band, height)
        width = 360.0 / n
        first = F.floor((around - span) / width)
        last = F.least(F.floor((around + span) / width), first + n - 1)
        return F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: F.struct(band.cast("long").alias("band"), F.pmod(k, n).alias("column")))

    return F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), cells))


def spatial_candidates(buckets: DataFrame, km: float = PLACE_KM, days: int = PLACE_DAYS) -> DataFrame:
    """Pairs of an owner's buckets that share a cell of place and time, each pair once, before any distance is known."""
    micros, span = F.unix_micros(F.col("start_at").cast("timestamp")), days * 86_400_000_000
    slot = F.floor(micros / span)
    placed = buckets.where("lat is not null and start_at is not null")
    a = placed.select("user_id", *[F.col(c).alias(f"{c}_a") for c in ("bucket", "lat", "lng")], micros.alias("at_a"), F.explode(spatial_cells(F.col("lat"), F.col("lng"), km, False)).alias("cell"), slot.alias("slot"))
    near = F.explode(spatial_cells(F.col("lat"), F.col("lng"), km, True)).alias("cell")
    b = placed.select("user_id", *[F.col(c).alias(f"{c}_b") for c in ("bucket", "lat", "lng")], micros.alias("at_b"), slot.alias("slot"), near)
    b = b.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    return a.join(b, ["user_id", "cell", "slot"]).where("bucket_a < bucket_b").drop("cell", "slot")


def spatial_pairs(buckets: DataFrame, km: float = PLACE_KM, days: int = PLACE_DAYS) -> DataFrame:
    """Pairs of an owner's buckets within km and days of each other; undated buckets have none.

    Buckets meet by owner, band of latitude, cell of longitude and cell of `days`: each is in its own cell, and the
    other of a pair in all that are near, across the date line and the poles."""
    met = spatial_candidates(buckets, km, days).where(F.abs(F.col("at_a") - F.col("at_b")) <= days * 86_400_000_000)
    return met.withColumn("km", haversine_km("lat_a", "lng_a", "lat_b", "lng_b")).where(F.col("km") <= km)


def look_pairs(buckets: DataFrame, vectors: DataFrame, least: float = LOOK_COSINE, days: int = LOOK_DAYS, of: Column | None = None) -> DataFrame:
    """Pairs of an owner's dated buckets that start within days of each other and look alike: the cosine of
    the mean vectors of their first images is `least` or more.

    of: the vector that an image has, where several images share one; its own unless told.  Buckets meet by cells of
    `days`: one of a pair is in its own, the other in its own and the one before."""
    slots = buckets.where("start_at is not null").select("user_id", "bucket", "start_at", F.posexplode("images").alias("pos", "image_id")).where(F.col("pos") < LOOK_IMAGES)
    slots = slots.select("user_id", "bucket", "start_at", (F.col("image_id") if of is None else of).alias("of"))
    each = slots.join(vectors.select(F.col("image_id").alias("of"), "v"), "of")
    held = each.groupBy("user_id", "bucket").agg(F.min("start_at").alias("start_at"), F.collect_list("v").alias("vs"))
    places = F.sequence(F.lit(0), F.array_max(F.transform("vs", F.size)) - 1)

    def mean(at: Column) -> Column:
        own = F.filter(F.transform("vs", lambda v: F.get(v, at).cast("double")), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, x: s + x), F.size(own))

    placed = held.where(F.array_max(F.transform("vs", F.size)) > 0).select("user_id", "bucket", "start_at", F.transform(places, mean).alias("centre"))
    micros = F.unix_micros(F.col("start_at").cast("timestamp"))
    span = days * 86_400_000_000
    placed = placed.withColumns({"at": micros, "cell": F.floor(micros / span), "norm": norm("centre")})

    def side(name: str, cells: Column) -> DataFrame:
        return placed.select("user_id", *[F.col(c).alias(f"{c}_{name}") for c in ("bucket", "at", "centre", "norm", "cell")], cells.alias("cell"))

    met = side("x", F.col("cell")).join(side("y", F.explode(F.array("cell", F.col("cell") - 1))), ["user_id", "cell"])
    met = met.where((F.col("cell_x") < F.col("cell_y")) | (F.col("bucket_x") < F.col("bucket_y"))).where(F.abs(F.col("at_x") - F.col("at_y")) <= span)
    size = F.col("norm_x") * F.col("norm_y")
    alike = met.withColumn("cosine", F.when(size > 0, dot("centre_x", "centre_y") / size).otherwise(0.0)).where(F.col("cosine") >= least)
    return alike.select("user_id", F.least("bucket_x", "bucket_y").alias("bucket_a"), F.greatest("bucket_x", "bucket_y").alias("bucket_b"), "cosine")


def shared_faces(members: DataFrame, starts: DataFrame, least: int = FACE_SHARED, days: int = FACE_DAYS) -> DataFrame:
    """Pairs of an owner's buckets with `least` clusters in common, starting within days of each other; an undated bucket
    is near all of them.

    members: (user_id, bucket, cluster_id); starts: (user_id, bucket, start_at).  Dated buckets meet by cluster and cell
    of `days`, so one cluster that is in very many of them is spread over time; an owner has an undated bucket or none."""
    span = days * 86_400_000_000
    own = members.distinct().join(starts, ["user_id", "bucket"]).withColumn("at", F.unix_micros(F.col("start_at").cast("timestamp")))
    dated = own.where("at is not null").withColumn("cell", F.floor(F.col("at") / span))
    a = dated.select("user_id", "cluster_id", "cell", F.col("bucket").alias("a"), F.col("at").alias("at_a"))
    around = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    b = dated.select("user_id", "cluster_id", around, F.col("bucket").alias("b"), F.col("at").alias("at_b"))
    near = a.join(b, ["user_id", "cluster_id", "cell"]).where("a < b").where(F.abs(F.col("at_a") - F.col("at_b")) <= span).select("user_id", "a", "b")
    x = own.where("at is null").select("user_id", "cluster_id", F.col("bucket").alias("x"))
    y = own.select("user_id", "cluster_id", F.col("bucket").alias("y"), "at")
    any_time = x.join(y, ["user_id", "cluster_id"]).where("x <> y and (at is not null or x < y)").select("user_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return near.unionByName(any_time).groupBy("user_id", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _merge_all(buckets: list[dict], joins, merge, days: int) -> list[dict]:
    """Merge the first pair (in order) that joins, and start over, until no pair does.

    After a merge only pairs with the merged bucket are new, so the search goes on with those: the buckets
    before it in turn, and then those behind it.  If buckets come in order of their starts, the undated last, a
    merge keeps them so; the search then ends where starts are more than `days` away, and an owner of very many
    buckets takes time in proportion to them."""
    buckets = list(buckets)
    span = timedelta(days=days)
    starts = [b["start_at"] for b in buckets]
    dated = [s for s in starts if s is not None]
    ordered = dated == sorted(dated) and starts[: len(dated)] == dated

    def behind(i: int):
        if not ordered:
            yield from range(i + 1, len(buckets))
            return
        at, j = buckets[i]["start_at"], i + 1
        while j < len(buckets) and buckets[j]["start_at"] is not None and (at is None or buckets[j]["start_at"] - at <= span):
            yield j
            j += 1
        k = len(buckets)
        while k > j and buckets[k - 1]["start_at"] is None:
            k -= 1
        yield from range(k, len(buckets))

    def before(i: int):
        at, first = buckets[i]["start_at"] if ordered else None, i
        while first and at is not None and buckets[first - 1]["start_at"] is not None and at - buckets[first - 1]["start_at"] <= span:
            first -= 1
        return range(0 if at is None else first, i)

    i = 0
    while i < len(buckets):
        j = next((j for j in behind(i) if joins(buckets[i], buckets[j])), None)
        if j is None:
            i += 1
        while j is not None:
            buckets[i] = merge(buckets[i], buckets.pop(j))
            k = next((k for k in before(i) if joins(buckets[k], buckets[i])), None)
            i, j = (i, None) if k is None else (k, i)
    return buckets


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _joined(a: dict, b: dict) -> dict:
    one = {**a, "images": a["images"] + b["images"], "start_at": _least(a["start_at"], b["start_at"]), "end_at": _most(a["end_at"], b["end_at"])}
    if "parts" in a:  # a summary: its first images, the buckets that it is made of, and its people
        one |= {"parts": a["parts"] + b["parts"], "n": a["n"] + b["n"], "people": a["people"] | b["people"]}
    return one


def _within(a: dict, b: dict, days: int) -> bool:
    return a["start_at"] is None or b["start_at"] is None or abs(a["start_at"] - b["start_at"]) <= timedelta(days=days)


def merge_places(buckets: list[dict], km: float = PLACE_KM, days: int = PLACE_DAYS) -> list[dict]:
    """Buckets near in place and time become one at the midpoint of the two places."""

    def joins(a: dict, b: dict) -> bool:
        if a["lat"] is None or b["lat"] is None:
            return False
        return _within(a, b, days) and haversine(a["lat"], a["lng"], b["lat"], b["lng"]) <= km

    return _merge_all(buckets, joins, lambda a, b: {**_joined(a, b), "lat": (a["lat"] + b["lat"]) / 2, "lng": (a["lng"] + b["lng"]) / 2}, days)


def _cosine(a, b) -> float:
    size = math.sqrt(float(np.dot(a, a))) * math.sqrt(float(np.dot(b, b)))
    return float(np.dot(a, b)) / size if size else 0.0


def merge_looks(buckets: list[dict], vectors: dict, cosine: float = LOOK_COSINE, days: int = LOOK_DAYS) -> list[dict]:
    """Buckets whose centroids (of the first images that have a vector) are alike become one."""
    for b in buckets:
        found = [vectors[i] for i in b["images"][:LOOK_IMAGES] if i in vectors]
        b["centre"] = np.mean(np.array(found, float), axis=0) if found else None

    def joins(a: dict, b: dict) -> bool:
        return a["centre"] is not None and b["centre"] is not None and _within(a, b, days) and _cosine(a["centre"], b["centre"]) >= cosine

    def merge(a: dict, b: dict) -> dict:
        one = _joined(a, b)
        one["centre"] = (a["centre"] + b["centre"]) / 2
        for c in ("lat", "lng"):
            one[c] = a[c] if a[c] is not None else b[c]
        return one

    return _merge_all(buckets, joins, merge, days)


def merge_faces(buckets: list[dict], clusters: dict, least: int = FACE_SHARED, days: int = FACE_DAYS) -> list[dict]:
    """Buckets that share people become one with the people of both."""
    for b in buckets:
        if "people" not in b:
            b["people"] = {c for i in b["images"] for c in clusters.get(i, ())}

    def joins(a: dict, b: dict) -> bool:
        return len(a["people"] & b["people"]) >= least and _within(a, b, days)

    return _merge_all(buckets, joins, lambda a, b: {**_joined(a, b), "people": a["people"] | b["people"]}, days)


def _parted(summary: DataFrame) -> DataFrame:
    """summary with `part`: buckets of an owner that no merge can bring together are in different parts.

    A merge reaches over a gap between two neighbours only if a bucket before it has what the merge compares (a place, a
    look, people) and started within the merge's days of the first start behind the gap, as a merged bucket starts with
    its first; and if some bucket behind it has that too.  An undated bucket is near all others, so it keeps an owner
    together if it has a look or people."""
    order = Window.partitionBy("user_id").orderBy("bucket")
    whole = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("start_at").cast("timestamp"))
    has = {"place": (F.col("lat").isNotNull(), PLACE_DAYS), "look": (F.coalesce(F.exists("looks", lambda x: x["v"].isNotNull()), F.lit(False)), LOOK_DAYS), "people": (F.coalesce(F.size("people"), F.lit(0)) > 0, FACE_DAYS)}
    flagged = summary.withColumns({"__at": micros, **{f"__{n}": c for n, (c, _) in has.items()}})
    dated = F.col("__at").isNotNull()
    reach = F.lit(False)
    for name, (_, days) in has.items():
        own = F.col(f"__{name}") & dated
        last = F.last(F.when(own, F.col("__at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.max(own).over(order.rowsBetween(0, Window.unboundedFollowing))
        reach = reach | (ahead & F.coalesce(F.col("__at") - last <= days * 86_400_000_000, F.lit(False)))
    near_all = F.coalesce(F.bool_or(~dated & (F.col("__look") | F.col("__people"))).over(whole), F.lit(False))
    cut = flagged.withColumns({"__cut": (~reach).cast("int"), "__near": near_all})
    part = F.when(F.col("__near"), 0).otherwise(F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parted = cut.withColumn("part", F.concat_ws(":", F.col("user_id").cast("string"), part.cast("string")))
    return parted.drop("__at", "__cut", "__near", *[f"__{n}" for n in has])


def cluster(images: DataFrame, vectors: DataFrame, faces: DataFrame, cosine: float = LOOK_COSINE) -> DataFrame:
    """The events of every owner: (user_id, event, cover, n, start_at, images).

    The merges depend on their order, so buckets that may meet are folded in one task: those of an owner
    between gaps that no merge reaches over.  What comes there is a summary per bucket: its times, place, number of images, the first LOOK_IMAGES of them with their vectors, and the
    people in it.  The fold gives which buckets make an event; their images are joined back after."""
    buckets = settle(time_buckets(images))
    slots = buckets.select("user_id", "bucket", F.posexplode("images").alias("pos", "image_id"))
    seen = F.array_sort(F.collect_list(F.struct("pos", "image_id", "v")))
    looks = slots.where(F.col("pos") < LOOK_IMAGES).join(vectors.select("image_id", "v"), "image_id", "left").groupBy("user_id", "bucket").agg(seen.alias("looks"))
    people = slots.join(faces.select("image_id", "cluster_id"), "image_id").groupBy("user_id", "bucket").agg(F.collect_set("cluster_id").alias("people"))
    summary = _parted(buckets.drop("images").join(looks, ["user_id", "bucket"], "left").join(people, ["user_id", "bucket"], "left"))

    def fold(_, rows):
        vecs = {x["image_id"]: x["v"] for r in rows for x in r["looks"] or () if x["v"] is not None}
        some = [{c: r[c] for c in ("n", "start_at", "end_at", "lat", "lng")} | {"images": [x["image_id"] for x in r["looks"] or ()], "parts": [r["bucket"]], "people": set(r["people"] or ())} for r in rows]
        merged = merge_faces(merge_looks(merge_places(some), vecs, cosine), {})
        kept = [b for b in merged if b["n"] >= LEAST_IMAGES]
        return [(rows[0]["user_id"], b["parts"][0], b["start_at"], at, bucket) for b in kept for at, bucket in enumerate(b["parts"])]

    made = fold_by(summary, "part", [F.asc("bucket")], fold, "user_id long, first long, start_at timestamp_ntz, at int, bucket long")
    parts = made.join(buckets.select("user_id", "bucket", "images"), ["user_id", "bucket"])
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "images"))), lambda x: x["images"]))
    events = parts.groupBy("user_id", "first").agg(F.min("start_at").alias("start_at"), ordered.alias("images"))
    events = events.withColumn("event", F.row_number().over(Window.partitionBy("user_id").orderBy("first")) - 1)
    return events.select("user_id", "event", F.get("images", F.lit(0)).alias("cover"), F.size("images").alias("n"), "start_at", "images")


def dominant_category(members: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The most frequent slug per key; of equally frequent ones the first seen."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    counts = members.withColumn("__at", at).groupBy(*keys, "slug").agg(F.count("*").alias("n"), F.min("__at").alias("__at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("__at")))
    return counts.withColumn("__rn", place).where("__rn = 1").drop("__rn", "__at")


def fold_places(events: list[dict], km: float = VISIT_KM) -> list[dict]:
    """Places visited, given an owner's events from the latest on (undated first).

    An event without a place is one of its own; another joins the first place less than km from the one
    that founded it."""
    places: list[dict] = []
    for e in events:
        home = None
        if e["lat"] and e["lng"]:
            home = next((p for p in places if p["lat"] and p["lng"] and haversine(p["lat"], p["lng"], e["lat"], e["lng"]) < km), None)
        if home is None:
            places.append({"lat": e["lat"], "lng": e["lng"], "visits": 1, "images": e["n_images"], "last_at": e["start_at"]})
        else:
            home["visits"] += 1
            home["images"] += e["n_images"]
            home["last_at"] = _most(home["last_at"], e["start_at"])
    return sorted(places, key=lambda p: -p["visits"])


def visited_places(trips: DataFrame) -> DataFrame:
    """fold_places per owner of trips (user_id, event_id, start_at, lat, lng, n_images)."""

    def fold(user, rows):
        found = fold_places(rows)
        return [(user, i, p["lat"], p["lng"], p["visits"], p["images"], p["last_at"]) for i, p in enumerate(found)]

    latest = [F.desc_nulls_first("start_at"), F.asc("event_id")]
    return fold_by(trips, "user_id", latest, fold, "user_id long, place int, lat double, lng double, visits int, images long, last_at timestamp_ntz")


def unlocated(events: DataFrame) -> DataFrame:
    return events.where(missing("lat", "lng"))


def assign_clusters(arrivals: list[tuple], known: list[tuple], threshold: float = LOOK_COSINE) -> list[tuple]:
    """Online identity clustering of one owner: (id, cluster) per arrival (id, vector), in order.

    The nearest face so far, if it is alike enough, gives its cluster; else the face founds a cluster named
    by its id.  Clusters never merge.  known: (id, vector, cluster) so far; it grows."""
    ids = [i for i, _, _ in known]
    clusters = [c for _, _, c in known]
    size = len(known)
    vectors = np.zeros((size + len(arrivals), len(arrivals[0][1]) if arrivals else 0))
    for k, (_, v, _) in enumerate(known):
        vectors[k] = _unit(v)
    out = []
    for image, v in arrivals:
        one = _unit(v)
        home = image
        if size:
            scores = vectors[:size] @ one
            best = min(np.flatnonzero(scores >= scores.max() - 1e-12).tolist(), key=lambda k: ids[k])
            if scores[best] >= threshold:
                home = clusters[best]
        vectors[size] = one
        size += 1
        ids.append(image)
        clusters.append(home)
        known.append((image, v, home))
        out.append((image, home))
    return out


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    size = math.sqrt(float(v @ v))
    return v / size if size else v


def face_clusters_online(vectors: DataFrame, threshold: float = LOOK_COSINE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """assign_clusters() for every owner in order of id: (user_id, image_id, cluster_id).

    A face hangs on the nearest earlier one of its owner, if that is alike enough, and has the cluster that
    the chain of those ends at; so an owner of any size spreads over tiles, and no task folds it.  Of more than
    index_rows faces each meets the cells of an inverted file that can hold one so alike, and no others."""
    items = vectors.select("user_id", "image_id", l2_normalize("v").alias("v"))
    if items.count() > index_rows:
        found = vector_index.among(items, 1, f"{shared_folder(items.sparkSession)}/faces-{uuid.uuid4().hex}", floor=threshold, earlier=True)
    else:
        found = nearest(items, items, 1, earlier=True).where(F.col("score") >= threshold)
    near = found.select(F.col("a").alias("image_id"), F.col("b").alias("root"))
    parent = items.select("user_id", "image_id").join(near, "image_id", "left").select("user_id", F.col("image_id").alias("node"), F.coalesce("root", "image_id").alias("root"))
    parent = settle(parent)
    home = roots(parent.select("node", "root"))
    return parent.select("user_id", "node").join(home, "node").select("user_id", F.col("node").alias("image_id"), F.col("root").alias("cluster_id"))
