"""Operators for large owners and crowded values against plain versions, with limits set low."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.functions.geo import haversine
from lumenlake.operators import common, duplicates, events, order, scan, vector_index
from lumenlake.plans import search
from lumenlake.sources import files


def visits(spark, n=900):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        at = start + timedelta(minutes=rng.choice([0, 5, 200, 400]) * rng.randint(0, 60))
        place = rng.choice([None, (rng.randint(-90, 90) / 1.0, rng.randint(-180, 180) / 1.0)])
        rows.append((1 if k % 3 else rng.randint(2, 40), k, at, place and place[0], place and place[1]))
    rows += [(50, n + k, start, 1.0, 2.0) for k in range(200)]  # ties
    return spark.createDataFrame(rows, "user_id long, image_id long, taken_at timestamp_ntz, lat double, lng double").repartition(6)


def test_ranges_give_the_rows_of_one_window(spark):
    items = visits(spark)
    for one, many in ((events.sessions(items, "taken_at"), events.sessions(items, "taken_at", window_rows=10)), (events.running_means(items, "taken_at"), events.running_means(items, "taken_at", window_rows=10))):
        assert one.columns == many.columns
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    plan = events.sessions(items, "taken_at", window_rows=10)
    parts = scan.ranges(items, "user_id", ["taken_at", "image_id"], 16)
    largest = parts.groupBy("user_id", "__part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 300 and plan.count() == items.count()  # one owner has 600 of 1,100 rows
    assert events.sessions(items.limit(0), "taken_at", window_rows=10).count() == 0


def test_previous_and_running_values(spark):
    items = visits(spark, 300)
    parts = scan.ranges(items, "user_id", ["taken_at", "image_id"], 9)
    w = Window.partitionBy("user_id").orderBy("taken_at", "image_id")
    got = scan.with_previous(parts, "user_id", ["taken_at", "image_id"], F.col("taken_at"), "before").select("image_id", "before")
    assert sorted(got.collect()) == sorted(items.select("image_id", F.lag("taken_at").over(w).alias("before")).collect())


def places(spark):
    rng = random.Random(8)
    rows = []
    for k in range(260):
        lat, lng = rng.choice([(89.9, 0), (-89.8, 100), (0, 179.9), (0, -179.9), (60, 10), (60.2, 10.5), (12, -180), (12, 180), (45, 45), (90, 0), (-90, 3)])
        lat = max(-90.0, min(90.0, lat + rng.uniform(-0.4, 0.4)))
        lng = (lng + rng.uniform(-0.6, 0.6) * (100 if abs(lat) > 89 else 1) + 180) % 360 - 180
        rows.append((k % 2, k, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 140)), lat, lng))
    rows += [(0, 900, datetime(2024, 1, 1), None, None), (0, 901, None, 45.0, 45.0), (1, 902, datetime(2024, 1, 1), 12.0, 180.0), (1, 903, datetime(2024, 1, 1), 12.0, -180.0)]
    return rows, spark.createDataFrame(rows, "user_id long, bucket long, start_at timestamp_ntz, lat double, lng double")


@pytest.mark.parametrize("km", [50.0, 5.0, 700.0])
def test_spatial_pairs_across_poles_and_the_date_line(spark, km):
    rows, buckets = places(spark)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] is not None and b[3] is not None and a[2] and b[2] and abs(a[2] - b[2]) <= timedelta(days=2) and haversine(a[3], a[4], b[3], b[4]) <= km:
                want.add((a[0], a[1], b[1]))
    got = [(r["user_id"], r["bucket_a"], r["bucket_b"]) for r in events.spatial_pairs(buckets, km).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, 902, 903) in want


def test_cells_of_longitude_part_what_one_latitude_held_together(spark):
    rows = [(0, k, datetime(2024, 1, 1), 50.0, -180 + k * 0.9) for k in range(400)]
    buckets = spark.createDataFrame(rows, "user_id long, bucket long, start_at timestamp_ntz, lat double, lng double")
    met, found = events.spatial_candidates(buckets).count(), events.spatial_pairs(buckets).count()
    print(f"pairs that met: {met}, by latitude alone {400 * 399 // 2}; found {found}")
    assert found == 0 and met < 1_000


def test_shared_faces_by_cells_of_time(spark):
    rng = random.Random(1)
    starts = [(u, b, None if b == 59 else datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 30, 60, 61, 90, 400]), hours=rng.randint(0, 1))) for u in (0, 1) for b in range(60)]
    members = [(u, b, c) for u, b, _ in starts for c in [7, *rng.sample(range(12), 2)] for _ in range(2)]
    people, at = {}, {(u, b): t for u, b, t in starts}
    for u, b, c in members:
        people.setdefault((u, b), set()).add(c)
    want = set()
    for u in (0, 1):
        for a in range(60):
            for b in range(a + 1, 60):
                n, x, y = len(people[u, a] & people[u, b]), at[u, a], at[u, b]
                if n >= 2 and (x is None or y is None or abs(x - y) <= timedelta(days=30)):
                    want.add((u, a, b, n))
    frame = spark.createDataFrame(members, "user_id long, bucket long, cluster_id long")
    got = [tuple(r) for r in events.shared_faces(frame, spark.createDataFrame(starts, "user_id long, bucket long, start_at timestamp_ntz")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(b == 59 for _, _, b, _ in want)


def test_a_small_side_is_counted(spark):
    assert common.few(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        common.few(spark.range(4), 3)


def plain_rank(values, place):
    return sorted(values)[min(len(values) - 1, int(len(values) * place))]


def test_ranks_of_crowded_values(spark):
    rng = random.Random(5)
    groups = {
        "equal": [0.5] * 700,
        "crowd": [0.5 + rng.randint(0, 9) * 1e-16 for _ in range(500)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)] + [-1.7e308, 1.7e308],
        "plain": [rng.gauss(0, 1) for _ in range(999)],
        "few": [3.0],
        None: [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("plain", None), ("plain", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    spots = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    for cells, few in ((order.CELLS, order.FEW), (64, 30)):
        got = {(r["k"], r["place"]): r["x"] for r in order.ranked_values(df, "k", "x", spots, cells, few).collect()}
        assert got == {(k, p): plain_rank(vs, p) for k, vs in groups.items() for p in spots}


def vectors(spark, n=1500):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, 16))
    v[5] = v[6] = v[7]
    rows = [(k, int(k % 3), datetime(2023, 1, 1) + timedelta(days=int(k)), v[k].tolist()) for k in range(n)] + [(n, 0, datetime(2023, 1, 1), None)]
    return v, spark.createDataFrame(rows, "image_id long, user_id long, taken_at timestamp_ntz, v array<double>")


def test_an_index_is_exact_or_finds_nine_in_ten(spark, tmp_path):
    v, frame = vectors(spark)
    built = vector_index.build(frame, str(tmp_path / "index"), vector_index.fit(frame, 40, 500))
    assert built.rows.count() == len(v)
    queries = frame.where("image_id % 100 = 0 and v is not null").select("image_id", F.col("user_id").alias("owner"), "v")
    condition = search.date_filter(search.Intent("", year=2024), "at")
    days = np.array([(datetime(2023, 1, 1) + timedelta(days=k)).year == 2024 for k in range(len(v))])
    for by_owner, when in ((True, condition), (False, None)):
        want = set()
        for q in range(0, len(v), 100):
            fits = [k for k in range(len(v)) if k != q and (not by_owner or (k % 3 == q % 3 and days[k]))]
            want |= {(q, k) for k in sorted(fits, key=lambda k: (-float(v[q] @ v[k]), k))[:10]}
        found, read = vector_index.search(built, queries, 10, None, by_owner, when)
        assert {(r["a"], r["b"]) for r in found.collect()} == want
        probes = vector_index.probes_for(built, frame.where("image_id % 100 <> 0 and v is not null").select("image_id", F.col("user_id").alias("owner"), "v"), 10, by_owner=by_owner, condition=when)
        some, less = vector_index.search(built, queries, 10, probes, by_owner, when)
        share = vector_index.recall(some, found).agg(F.avg("recall")).first()[0]
        assert share >= 0.9 and less.agg(F.sum("rows_read")).first()[0] < 0.7 * 15 * (len(v) if not by_owner else days.sum() / 3)
    plan = vector_index._looked_at(built, queries.withColumn("cell", F.lit(3)), condition)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(at," in plan


def test_large_owners_by_an_index(spark):
    _, frame = vectors(spark, 500)
    items = frame.where("v is not null")
    one, many = duplicates.knn_join(items, 4), duplicates.knn_join(items, 4, index_rows=100)
    assert one.columns == many.columns
    assert sorted((*r[:3], round(r[3], 9), r[4]) for r in one.collect()) == sorted((*r[:3], round(r[3], 9), r[4]) for r in many.collect())
    asked = items.where("image_id % 100 = 0")
    one, many = (search.semantic_many(items, asked, search.Intent(""), floor=2.0, limit=20, index_rows=n) for n in (10_000, 100))
    assert sorted((r[0], r[1], round(r[2], 9)) for r in one.collect()) == sorted((r[0], r[1], round(r[2], 9)) for r in many.collect()) and not one.isEmpty()
    for threshold in (0.8, 0.97):
        one, many = events.face_clusters_online(items, threshold), events.face_clusters_online(items, threshold, index_rows=100)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_a_month_without_a_year_goes_up_to_the_current_one(spark):
    now = datetime.now()
    rows = [(y, datetime(y, m, d, 23, 59, 59)) for y in (now.year - 21, now.year - 20, 2024, now.year, now.year + 1) for m, d in ((6, 30), (7, 1))]
    df = spark.createDataFrame(rows, "y int, taken_at timestamp_ntz")
    kept = df.where(search.date_filter(search.Intent("june", month=6))).select("y").collect()
    assert sorted(r[0] for r in kept) == sorted({now.year - 20, 2024, now.year})


def test_types_that_an_upload_may_have(spark):
    heads = {
        b"\xff\xd8\xff\xe0": "image/jpeg",
        b"\x89PNG\r\n\x1a\n": "image/png",
        b"GIF89a": "image/gif",
        b"RIFF\x00\x00\x00\x00WEBP": "image/webp",
        b"II*\x00": "image/tiff",
        b"MM\x00*": "image/tiff",
        b"\x00\x00\x00\x18ftypheic": "image/heic",
        b"\x00\x00\x00\x18ftypheix": "image/heic",
        b"\x00\x00\x00\x18ftypmif1": "image/heif",
        b"\x00\x00\x00\x18ftypisom": None,
        b"BM\x00\x00": None,
        b"RIFF\x00\x00\x00\x00WAVE": None,
        b"": None,
    }
    df = spark.createDataFrame([(bytearray(h + b"\x00" * 20), m) for h, m in heads.items()], "content binary, want string")
    assert all(r["mime"] == r["want"] for r in df.withColumn("mime", files.sniff("content")).collect())


def test_intents(spark):
    asked = ["Show my beach photos from december 2023", "dec jan trip", "with John at the beach", "show my photos", "birthday party 2021 in Goa", "x2023y École with éa Tour"]
    df = spark.createDataFrame([(t,) for t in asked], "query string")
    got = [r.asDict() for r in df.select(*[c.alias(n) for n, c in search.intent_columns("query").items()]).collect()]
    assert [(g["year"], g["month"]) for g in got] == [(2023, 12), (None, 1), (None, None), (None, None), (2021, None), (None, None)]
    assert got[2]["name"] == "john" and got[3]["semantic"] == "show my photos" and got[4]["event_words"] == ["party", "birthday party", "birthday", "goa"]
    assert got[5]["event_words"] == ["tour", "éa tour"] and math.isclose(1, 1)


def test_parts_of_an_owner_fold_like_the_whole(spark):
    """Owners with few places, looks and people, and gaps of all kinds, against the merges of all of an owner's images."""
    rng = random.Random(11)
    images, vectors, faces, number = [], [], [], 0
    for user in range(40):
        at = datetime(2024, 1, 1)
        kinds = [rng.random() < 0.6 for _ in range(3)]
        for _ in range(rng.randint(3, 14)):
            at += timedelta(days=rng.choice([0.5, 1, 2, 2.2, 5, 7, 8, 20, 29, 31, 40]))
            place = kinds[0] and rng.random() < 0.5 and (10.0 + rng.choice([0, 0.2, 3]), 20.0)
            for k in range(rng.randint(1, 4)):
                images.append((user, number, at + timedelta(minutes=k), *(place or (None, None))))
                if kinds[1] and rng.random() < 0.3:
                    vectors.append((number, rng.choice([[1.0, 0.0], [0.9, 0.3], [0.0, 1.0]])))
                if kinds[2]:
                    faces += [(number, c) for c in rng.sample(range(4), rng.choice([0, 0, 1, 2]))]
                number += 1
        for _ in range(rng.choice([0, 0, 0, 4])):
            images.append((user, number, None, None, None))
            if rng.random() < 0.2:
                faces += [(number, 0), (number, 1)]
            number += 1
    frame = spark.createDataFrame(images, "user_id long, image_id long, taken_at timestamp_ntz, lat double, lng double").withColumns({"deleted": F.lit(False), "status": F.lit("COMPLETED")})
    summaries = {}
    for r in events.time_buckets(frame).orderBy("user_id", "bucket").collect():
        summaries.setdefault(r["user_id"], []).append({c: r[c] for c in ("images", "start_at", "end_at", "lat", "lng")})
    vecs, people = dict(vectors), {}
    for i, c in faces:
        people.setdefault(i, []).append(c)
    want = set()
    for user, buckets in summaries.items():
        merged = events.merge_faces(events.merge_looks(events.merge_places(buckets), vecs, 0.82), people)
        want |= {(user, tuple(b["images"]), b["start_at"]) for b in merged if len(b["images"]) >= 3}
    v, f = spark.createDataFrame(vectors, "image_id long, v array<double>"), spark.createDataFrame(faces, "image_id long, cluster_id long")
    got = events.cluster(frame, v, f, 0.82).collect()
    assert {(r["user_id"], tuple(r["images"]), r["start_at"]) for r in got} == want and len(got) == len(want) > 60
