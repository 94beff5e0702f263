"""Merges into stored tables, resumable batches, and classes of equal hashes."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import duplicates, stored
from lumenlake.sources import keyset


def table(spark, n=400):
    return spark.range(n).select((F.col("id") % 20).alias("owner"), "id", (F.col("id") * 3).alias("x"))


def files(root):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("*.parquet")}


def test_a_merge_writes_only_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "t")
    assert stored.create(table(spark), root, ["owner", "id"], ["owner"], 8) == 0
    before = files(root)
    new = spark.createDataFrame([(3, 3, -1), (3, 9_003, -2)], "owner long, id long, x long")
    gone = spark.createDataFrame([(3, 23), (3, 77_777)], "owner long, id long")
    assert stored.merge(spark, root, new, gone) == 1
    after = files(root)
    assert before.items() <= after.items()
    buckets = {p.split("__bucket=")[1].split("/")[0] for p in after.keys() - before.keys()}
    assert len(buckets) == 1
    want = {(r["owner"], r["id"]): r["x"] for r in table(spark).collect()} | {(3, 3): -1, (3, 9_003): -2}
    del want[3, 23]
    assert {(r["owner"], r["id"]): r["x"] for r in stored.read(spark, root).collect()} == want
    assert stored.read(spark, root, 0).count() == 400  # an earlier version is still there
    assert stored.merge(spark, root, new.limit(0)) == 2 and stored.read(spark, root).count() == len(want)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    stored.create(table(spark), root, ["id"], buckets=4)
    one, two = (spark.createDataFrame([(0, 0, k)], "owner long, id long, x long") for k in (-1, -2))
    assert stored.merge(spark, root, one, version=0) == 1
    with pytest.raises(stored.Conflict):
        stored.merge(spark, root, two, version=0)
    assert stored.read(spark, root).where("id = 0").first()["x"] == -1
    assert stored.merge(spark, root, two) == 2 and stored.read(spark, root).where("id = 0").first()["x"] == -2
    with pytest.raises(FileNotFoundError):
        stored.read(spark, root, 9)


def test_all_rows_of_a_bucket_may_go_and_an_empty_table_may_grow(spark, tmp_path):
    root = str(tmp_path / "t")
    stored.create(table(spark).limit(0), root, ["id"], buckets=3)
    assert stored.read(spark, root).count() == 0
    stored.merge(spark, root, table(spark, 10))
    stored.merge(spark, root, gone=table(spark, 10))
    assert stored.read(spark, root).count() == 0 and stored.read(spark, root, 1).count() == 10


@pytest.mark.parametrize("most", [1, 2, None])
def test_a_stopped_run_goes_on(spark, tmp_path, most):
    df = table(spark, 1000).withColumn("id", F.when(F.col("id") >= 10, F.col("id"))).repartition(4)  # ten rows without a key
    path, seen, runs = str(tmp_path / "run"), [], 0

    def process(batch, number):
        if number == 2 and ("failed",) not in seen:
            seen.append(("failed",))
            raise OSError("lost")
        seen.append((number, sorted(r["x"] for r in batch.collect())))

    while True:
        runs += 1
        try:
            keyset.run(df, "id", path, process, 150, most)
            break
        except (keyset.Stopped, OSError):
            assert runs < 20
    batches = dict(s for s in seen if len(s) == 2)
    assert len(batches) == len(seen) - 1 >= 5  # each batch once
    assert sorted(x for xs in batches.values() for x in xs) == sorted(3 * k for k in range(1000))
    assert set(range(0, 30, 3)) <= set(batches[0]) and max(map(len, batches.values())) < 400
    assert keyset.run(df, "id", path, process, 150) == 0


def test_batches_reach_the_scan(spark, tmp_path):
    table(spark, 500).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(keyset.in_range("id", [100, 200], 1))._jdf.queryExecution().toString()
    assert "GreaterThan(id,100)" in plan and "LessThanOrEqual(id,200)" in plan
    assert keyset.bounds(df.limit(0), "id") == [] and keyset.run(df.limit(0), "id", str(tmp_path / "r"), lambda b, n: None) == 1


def test_equal_hashes_are_one_class(spark):
    blank = [0] * 16
    near, far = [7] + [0] * 15, [-1] * 16
    rows = [(0, k, blank) for k in range(300)] + [(0, 300, near), (0, 301, near), (0, 302, far), (1, 303, blank)]
    got = [tuple(r) for r in duplicates.near_classes(spark.createDataFrame(rows, "user_id long, image_id long, h array<long>"), 50, 16).select("user_id", "kind", "a", "b", "distance").collect()]
    pairs = [r for r in got if r[1] == "NEAR"]
    assert pairs == [(0, "NEAR", 0, 300, 3)] and len(got) == len(rows) + 1
    assert (0, "MEMBER", 300, 301, 0) in got and (1, "MEMBER", 303, 303, 0) in got and (0, "MEMBER", 0, 299, 0) in got
