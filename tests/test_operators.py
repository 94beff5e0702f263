"""Paging, maintenance, folds and streams on small tables; order-dependent merges against models."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.operators import commits, common, duplicates, events, links, neighbours, scoring
from lumenlake.plans import library
from lumenlake.sources import files
from lumenlake.streaming import arrivals, jobs

T0 = dt.datetime(2024, 1, 1)


def hours(h, ms=0):
    return T0 + dt.timedelta(hours=h, milliseconds=ms)


def photos(spark, rows):
    return spark.createDataFrame([(i, 1, t, "COMPLETED", False, 1.0, 1.0) for i, t in rows], "image_id long, user_id long, taken_at timestamp_ntz, status string, deleted boolean, lat double, lng double")


def test_sessions_and_undated_buckets(spark):
    got = {r["bucket"]: r["images"] for r in events.time_buckets(photos(spark, [(1, hours(0)), (2, hours(6)), (3, hours(12, 1)), (4, None), (5, None)])).collect()}
    assert got == {0: [1, 2], 1: [3]}
    assert 2**40 in {r["bucket"] for r in events.time_buckets(photos(spark, [(4, None), (5, None), (6, None)])).collect()}


def bucket(i, start, lat=None, lng=None, images=None):
    return {"images": images or [i], "start_at": start, "end_at": start, "lat": lat, "lng": lng}


def test_place_merges_drift_and_respect_time():
    step = 40 / 111.19
    near = [bucket(0, T0, 0.0, 0.0), bucket(1, T0, 0.0, step), bucket(2, T0, 0.0, 2 * step)]
    assert [b["images"] for b in events.merge_places(near)] == [[0, 1], [2]]
    days = dt.timedelta(days=2)
    assert len(events.merge_places([bucket(0, T0, 1.0, 1.0), bucket(1, T0 + days, 1.0, 1.0)])) == 1
    assert len(events.merge_places([bucket(0, T0, 1.0, 1.0), bucket(1, T0 + days + dt.timedelta(milliseconds=1), 1.0, 1.0)])) == 2
    assert len(events.merge_places([bucket(0, T0), bucket(1, T0)])) == 2


def test_look_and_face_merges():
    v = {0: [1.0, 0.0], 1: [0.9, 0.43589]}
    assert len(events.merge_looks([bucket(0, None), bucket(1, T0)], v)) == 1
    assert len(events.merge_looks([bucket(0, T0), bucket(1, T0 + dt.timedelta(days=8))], v)) == 2
    late = T0 + dt.timedelta(days=30)
    assert len(events.merge_faces([bucket(0, T0), bucket(1, late)], {0: {1, 2}, 1: {1, 3}})) == 2
    assert len(events.merge_faces([bucket(0, T0), bucket(1, late)], {0: {1, 2}, 1: {1, 2}})) == 1


def model_merge(buckets, joins, merge):
    while True:
        for i in range(len(buckets)):
            for j in range(i + 1, len(buckets)):
                if joins(buckets[i], buckets[j]):
                    break
            else:
                continue
            break
        else:
            return buckets
        merged = merge(buckets[i], buckets[j])
        buckets = [merged if k == i else b for k, b in enumerate(buckets) if k != j]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 96)), max_size=9), st.booleans())
def test_merges_match_a_literal_restart(points, in_order):
    points = sorted(points, key=lambda p: p[1]) if in_order else points
    buckets = [bucket(i, hours(h), p / 100.0, 0.5) for i, (p, h) in enumerate(points)]

    def joins(a, b):
        return abs(a["start_at"] - b["start_at"]) <= dt.timedelta(days=2) and events.haversine(a["lat"], a["lng"], b["lat"], b["lng"]) <= 50

    def merge(a, b):
        return {"images": a["images"] + b["images"], "start_at": min(a["start_at"], b["start_at"]), "end_at": max(a["end_at"], b["end_at"]), "lat": (a["lat"] + b["lat"]) / 2, "lng": (a["lng"] + b["lng"]) / 2}

    got = events.merge_places([dict(b) for b in buckets])
    assert got == model_merge(buckets, joins, merge)
    assert sorted(i for b in got for i in b["images"]) == list(range(len(points)))


def test_places():
    rows = [{"lat": 10.0, "lng": 10.0, "n_images": 2, "start_at": T0}, {"lat": 10.0, "lng": 10.0, "n_images": 3, "start_at": hours(5)}, {"lat": 0.0, "lng": 5.0, "n_images": 1, "start_at": T0}, {"lat": 11.0, "lng": 10.0, "n_images": 1, "start_at": T0}]
    got = events.fold_places([dict(r) for r in rows])
    assert [(p["visits"], p["images"]) for p in got] == [(2, 5), (1, 1), (1, 1)] and got[0]["last_at"] == hours(5)


def test_online_clusters_never_merge():
    v = [[1.0, 0.0], [0.0, 1.0], [0.7071, 0.7071], [0.99, 0.1]]
    assert events.assign_clusters(list(enumerate(v)), [], 0.9) == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_keyset_pages_walk_through_ties_and_nulls(spark):
    rows = [(i, None if i % 4 == 0 else hours(i // 5)) for i in range(23)]
    df = spark.createDataFrame(rows, "image_id long, at timestamp_ntz")
    order, seen, cursor = [("at", True), ("image_id", True)], [], None
    while True:
        page = common.keyset_page(df, order, 5, cursor).collect()
        seen += [r["image_id"] for r in page]
        if not page[0]["has_next"]:
            break
        cursor = df.where(F.col("image_id") == page[-1]["image_id"])
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0]), reverse=True)]


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 3)], "image_id long, status string, attempts int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0), (3, "d", 0)], "image_id long, status string, attempts int")
    assert sorted(r["status"] for r in common.upsert(old, new.distinct(), ["image_id"]).collect()) == ["a", "c", "d"]
    assert [r["image_id"] for r in common.insert_new(old, new, ["image_id"]).collect()] == [3]
    assert {r["image_id"]: r["attempts"] for r in common.count_attempts(old, new, ["image_id"]).collect()} == {1: 0, 2: 4, 3: 0}
    images = spark.createDataFrame([(1, False), (2, False)], "image_id long, deleted boolean")
    assert common.live(common.soft_delete(images, spark.createDataFrame([(2,)], "image_id long"))).count() == 1
    assert common.set_where(old, F.col("attempts") > 1, status="x").where("status = 'x'").count() == 1


def test_points_are_patched_and_removed(spark):
    points = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "image_id long, category string, n int")
    changes = spark.createDataFrame([(2, "z"), (3, None), (9, "q")], "image_id long, category string")
    assert sorted(tuple(r) for r in common.patch(points, changes, ["image_id"]).collect()) == [(1, "a", 1), (2, "z", 2), (3, None, 3)]
    assert [r["image_id"] for r in common.remove(points, changes, ["image_id"]).collect()] == [1]


def test_versions_are_published_whole(spark, tmp_path):
    root, one, two = str(tmp_path), spark.range(2), spark.range(5)
    common.publish(spark, {"a": one, "b": two}, root)
    assert common.published(spark, root, "b").count() == 5

    class Broken:
        write = property(lambda self: 1 / 0)

    with pytest.raises(ZeroDivisionError):
        common.publish(spark, {"a": two, "b": Broken()}, root)
    assert common.published(spark, root, "a").count() == 2
    common.publish(spark, {"a": two, "b": one}, root)
    assert common.published(spark, root, "a").count() == 5
    with pytest.raises(commits.Conflict):  # another writer has published since version 0
        common.publish(spark, {"a": one, "b": one}, root, after=0)
    assert common.published(spark, root, "a").count() == 5 and common.published(spark, root, "b", 0).count() == 5


def test_tenants_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    common.replace_tenant(spark.createDataFrame([(1, 10), (2, 20)], "user_id long, x long"), path)
    common.replace_tenant(spark.createDataFrame([(2, 21)], "user_id long, x long"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("user_id", "x").collect()) == [(1, 10), (2, 21)]


def test_order_by_all_but_return_live(spark):
    e = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "event_id long, title string")
    ei = spark.createDataFrame([(1, i) for i in range(5)] + [(2, i) for i in range(5, 8)], "event_id long, image_id long")
    im = spark.createDataFrame([(i, i < 4) for i in range(8)], "image_id long, deleted boolean")
    got = [(r["event_id"], r["n_all"], r["n_live"]) for r in library.by_image_count(e, ei, im, 3).collect()]
    assert got == [(1, 5, 1), (2, 3, 3), (3, 0, 0)]


def test_barrier(spark):
    rows = [(1, "HASH", "COMPLETED"), (1, "OCR", "FAILED"), (1, "CLUSTER", "RUNNING"), (2, "HASH", "COMPLETED"), (2, "OCR", "RUNNING")]
    got = library.barrier(spark.createDataFrame(rows, "image_id long, job_type string, status string"))
    assert {r["image_id"]: r["complete"] for r in got.collect()} == {1: True, 2: False}


def pairs(spark, rows):
    return spark.createDataFrame([(r, float(s)) for r, s in rows], "relevant boolean, score double")


def test_calibration(spark):
    stats = scoring.score_stats(pairs(spark, [(True, i) for i in range(10)])).first()
    assert (stats["p25"], stats["p50"], stats["p75"]) == (2, 5, 7)
    sweep = {r["threshold"]: r for r in scoring.threshold_sweep(pairs(spark, [(True, 0.1), (False, 0.3)]), [0.05, 0.2, 0.9]).collect()}
    assert sweep[0.9]["precision"] == 1 and sweep[0.9]["f1"] == 0 and sweep[0.05]["f1"] == pytest.approx(2 / 3)
    none = scoring.threshold_sweep(pairs(spark, [(False, 0.1)]), [0.5]).first()
    assert none["recall"] == 1 and none["precision"] == 1
    assert scoring.both_classes(pairs(spark, [(True, 0.1), (False, 0.3)])).count() == 2
    with pytest.raises(ValueError):
        scoring.both_classes(pairs(spark, [(False, 0.1)]))


def test_classification(spark):
    even = spark.createDataFrame([(1, s, 0.5) for s in range(14)], "image_id long, slug long, score double")
    assert {r["confidence"] for r in scoring.softmax(even, ["image_id"]).collect()} == {0.0714}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "image_id long, v array<double>")
    protos = spark.createDataFrame([("food", [1.0, 0.0]), ("pets", [0.0, 1.0]), ("other", [0.5, 0.5])], "slug string, centre array<double>")
    got = {(r["image_id"], r["slug"]) for r in scoring.classify(v, protos, 0.05, 0.4).collect()}
    assert got == {(1, "food"), (2, "other")}


def test_duplicates(spark):
    twins = [(1, "s", 0b1111), (2, "s", 0b1111), (3, "s", 0b1111)]
    got = duplicates.replay_groups(twins, 1)
    assert [(k, m) for k, _, _, m in got if m == 3] == [("EXACT", 3), ("NEAR", 3)]
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(5)]
    signed = [(i, 1, [h - 2**64 if h >= 2**63 else h]) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(signed, "image_id long, user_id long, h array<long>")
    want = {(i, j, d) for i in range(60) for j in range(i + 1, 60) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= 5}
    near = duplicates.near_pairs(df, 5, 1)
    assert {(r["a"], r["b"], r["distance"]) for r in near.collect()} == want
    label = {r["image_id"]: r["group_id"] for r in duplicates.group_pairs(near).collect()}
    assert all(label[a] == label[b] for a, b, _ in want)


def test_groups_in_arrival_order(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(9)]
    hashes = [b ^ sum({1 << rng.randrange(64) for _ in range(rng.choice([0, 0, 1, 3, 4]))}) for b in base for _ in range(6)]
    rng.shuffle(hashes)
    rows = [(i, i % 2, hashes[i]) for i in range(len(hashes))]
    df = spark.createDataFrame([(i, u, f"{h:x}", [h - 2**64 if h >= 2**63 else h]) for i, u, h in rows], "image_id long, user_id long, sha256 string, h array<long>")
    got = {tuple(r) for r in duplicates.arrival_groups(df, duplicates.near_pairs(df, 5, 1)).select("user_id", "kind", "representative", "image_id").collect()}
    want = set()
    for user in (0, 1):
        log = duplicates.replay_groups([(i, f"{h:x}", h) for i, u, h in rows if u == user], 5)
        founder = {}
        for kind, group, match, _ in log:
            founder.setdefault((kind, group), match)
        want |= {(user, kind, founder[kind, group], member) for kind, group, _, member in log}
    assert got == want and {k for _, k, _, _ in got} == {"EXACT", "NEAR"}


def test_blocks_compare_everything(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "image_id long, user_id long, v array<double>")

    def best(earlier):
        out = {}
        for i, u, v in rows:
            near = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, o, w in rows if o == u and (j < i if earlier else j != i))
            out[i] = [j for _, j in near[:4]]
        return out

    for block in (2_048, 7):
        for earlier in (False, True):
            got = {}
            for r in neighbours.nearest(df, df, 4, earlier=earlier, block=block).orderBy("a", "rn").collect():
                got.setdefault(r["a"], []).append(r["b"])
            assert got == {k: v for k, v in best(earlier).items() if v}
    some = [[rng.random() for _ in range(4)] for _ in range(40)]
    rows = [(i, i % 3, rng.choice(some)) for i in range(90)]
    df = spark.createDataFrame(rows, "image_id long, user_id long, v array<double>")
    clusters = {r["image_id"]: r["cluster_id"] for r in events.face_clusters_online(df, 0.97).collect()}
    for user in range(3):
        model = dict(events.assign_clusters([(i, v) for i, u, v in rows if u == user], [], 0.97))
        assert model == {i: c for i, c in clusters.items() if i % 3 == user}
    assert neighbours.nearest(df.limit(0), df.limit(0), 3).count() == 0


def test_forests_and_components(spark):
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(50)], "node long, root long")
    assert {r["root"] for r in links.roots(chain).collect()} == {0}
    edges = [(i, i + 1) for i in range(30)] + [(100 - i, 99 - i) for i in range(20)] + [(7, 7), (500, 400)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 80 for i in range(80, 101)}, 400: 400, 500: 400}


def test_summaries_cluster_like_whole_buckets(spark):
    """cluster() from summaries gives what the merges give with all images and faces at hand."""
    rng = random.Random(8)
    for undated in (0, 4):
        rows = [(i, None if i < undated else hours(rng.choice([0, 40, 90, 200, 400, 2_000, 2_050]) + rng.random() * 8), rng.choice([None, 10.0, 10.2])) for i in range(60)]
        images = spark.createDataFrame([(i, 1, t, "COMPLETED", False, p, p) for i, t, p in rows], "image_id long, user_id long, taken_at timestamp_ntz, status string, deleted boolean, lat double, lng double")
        vectors = {i: [rng.random(), rng.random() / 3] for i, _, _ in rows if i % 3}
        people = {i: {rng.randrange(9) for _ in range(2)} for i, _, _ in rows if i % 2}
        v = spark.createDataFrame([(i, x) for i, x in vectors.items()], "image_id long, v array<double>")
        f = spark.createDataFrame([(i, c) for i, cs in people.items() for c in cs], "image_id long, cluster_id long")
        for cosine in (0.99, 0.9):
            got = [r["images"] for r in events.cluster(images, v, f, cosine).orderBy("event").collect()]
            buckets = [r.asDict() for r in events.time_buckets(images).orderBy("bucket").collect()]
            want = events.merge_faces(events.merge_looks(events.merge_places(buckets), vectors, cosine), people)
            assert got == [b["images"] for b in want if len(b["images"]) >= 3]


def test_pages_and_years():
    assert [common.page_size(n, k) for n, k in ((None, "page"), (500, "search"), (0, "page"), (70, "people"), (300, "documents"), (11, "previews"))] == [50, 100, 1, 50, 200, 10]
    assert [common.page_offset(p, 20) for p in (-1, 1, 3)] == [0, 0, 40]
    assert common.known_year(2000, 2024) == 2000 and common.known_year(2025, 2024) == 2025
    for year in (1999, 2026):
        with pytest.raises(ValueError):
            common.known_year(year, 2024)


def test_page_totals(spark):
    got = [tuple(spark.range(1).select(*[c.alias(n) for n, c in common.page_totals(F.lit(41), p, 20).items()]).first()) for p in (2, 3)]
    assert got == [(3, True), (3, False)]


def test_loader_rules(spark):
    rows = spark.createDataFrame([("LOCAL", 1.0, None), ("LOCAL", 1.0, 2.0), ("NOWHERE", None, None)], "source string, lat double, lng double")
    assert sorted(r["fault"] for r in schema.faults(rows).collect()) == ["half a coordinate", "source outside its domain"]


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x" * 9)
    (tmp_path / "b.txt").write_bytes(b"hello")
    got = {r["path"][-5:]: (r["mime_type"], r["fault"]) for r in files.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("image/png", None), "b.txt": (None, "not an image")}
    assert files.upload(spark, str(tmp_path), 2).count() == 2
    with pytest.raises(ValueError):
        files.upload(spark, str(tmp_path), 1)
    (tmp_path / "l.json").write_text('[{"query": "x", "slug": "food"}, {"query": "y", "slug": "zoo"}]')
    assert files.labelled(spark, str(tmp_path / "l.json"), "query string, slug string").count() == 2
    with pytest.raises(ValueError):
        files.labelled(spark, str(tmp_path / "l.json"), "query string, slug string", {"slug": ["food"]})


def test_streamed_sessions_are_batch_sessions(spark, tmp_path):
    rows = [(1, hours(0)), (1, hours(5)), (1, hours(20)), (2, hours(1)), (3, hours(900))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    run = jobs.stream_sessions(source, "ts", "user_id").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {tuple(r) for r in spark.table("sessions").collect()}
    batch = {tuple(r) for r in jobs.batch_sessions(spark.read.parquet(str(tmp_path / "in")), "ts", "user_id").collect()}
    assert got == {r for r in batch if r[0] != 3} and len(got) == 3


def test_streamed_jobs(spark, tmp_path):
    rows = [("HASH", 1, "2024-01-01T00:00:00"), ("HASH", 1, "2024-01-01T00:00:05"), ("OCR", 1, "2024-01-01T00:00:01")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(f'{{"job_type":"{k}","image_id":{i},"queued_at":"{t}"}}' for k, i, t in rows))
    seen = []
    handlers = {"HASH": lambda b: seen.append(("HASH", b.count())), "OCR": lambda b: seen.append(("OCR", b.count()))}
    stream = jobs.distinct_jobs(files.job_stream(spark, str(tmp_path / "in")))
    stream.writeStream.foreachBatch(jobs.dispatch(handlers)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    totals = {k: sum(n for kind, n in seen if kind == k) for k in ("HASH", "OCR")}
    assert totals == {"HASH": 1, "OCR": 1}
    done = spark.createDataFrame([(1, "HASH", "COMPLETED"), (2, "HASH", "FAILED")], "image_id long, job_type string, status string")
    assert jobs.fan_out(done).count() == 4


def test_streamed_face_clusters(spark, tmp_path):
    faces = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.99, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0])], "user_id long, image_id long, v array<double>")
    faces.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(faces.schema).parquet(str(tmp_path / "in"))
    with arrivals.keyed_state(spark):
        run = jobs.online_clusters(source).writeStream.format("memory").queryName("clusters").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("clusters").collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 4, 4)]
