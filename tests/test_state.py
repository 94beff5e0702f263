"""Streams with keyed state: the rows do not depend on how the input is cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import duplicates
from lumenlake.streaming import arrivals, requests

ITEMS = "user_id long, image_id long, sha256 string, h array<long>"


def hashes(n=90, words=2):
    rng = random.Random(7)
    base = [[rng.getrandbits(63) for _ in range(words)] for _ in range(8)]
    rows = []
    for k in range(n):
        h = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            h[rng.randrange(words)] ^= 1 << rng.randrange(63)
        rows.append((k % 2, k, f"s{hash(tuple(h)) % 1000 if rng.random() < 0.8 else k}", h))
    return rows


@pytest.mark.parametrize("cuts", [[90], [1, 40, 90]])
def test_any_cut_gives_the_groups_of_the_batch_form(spark, tmp_path, cuts):
    rows = hashes()
    items = spark.createDataFrame(rows, ITEMS)
    near = duplicates.near_pairs(items, 6, 2)
    want = sorted(map(tuple, duplicates.arrival_groups(items.select("user_id", "image_id", "sha256"), near).collect()))
    assert {r[1] for r in want} == {"EXACT", "NEAR"}
    folder, lo = str(tmp_path / "in"), 0
    for hi in cuts:
        spark.createDataFrame(rows[lo:hi], ITEMS).repartition(2).write.mode("append").parquet(folder)
        lo = hi
        arrivals.start(spark.readStream.schema(items.schema).parquet(folder), str(tmp_path), 6, 2).awaitTermination()
    assert sorted(map(tuple, arrivals.groups(spark, str(tmp_path)).collect())) == want


def plain_requests(rows, minutes):
    out, open_ = [], {}
    for user, event, at, ends in sorted(rows, key=lambda r: (r[2], r[1])):
        now = open_.get(user)
        if now and at > now[1]:
            now = None
        if ends:
            open_[user] = None
            continue
        reused = now is not None
        open_[user] = now = now or (event, at + timedelta(minutes=minutes))
        out.append((user, event, now[0], reused))
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 4])
def test_open_requests_are_reused_until_they_end_or_expire(spark, tmp_path, cuts):
    rng = random.Random(2)
    start = datetime(2024, 3, 1)
    rows = [(k % 4, k, start + timedelta(minutes=20 * k + rng.choice([0, 0, 60])), rng.random() < 0.15) for k in range(160)]
    rows.sort(key=lambda r: (r[2], r[1]))
    schema = "user_id long, event_id long, ts timestamp_ntz, ends boolean"
    want = plain_requests(rows, 120)
    assert {r[3] for r in want} == {True, False}
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    step = -(-len(rows) // cuts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(source)
        stream = requests.open_requests(spark.readStream.schema(schema).parquet(source), "ts", 120, late="1 day")
        with arrivals.keyed_state(spark):
            run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == want


def test_the_store_setting_is_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with arrivals.keyed_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_bands_cover_all_bits(spark):
    for bits, words in ((6, 2), (50, 16), (18, 1)):
        edges = [arrivals._edges(k, bits + 1, words * 64) for k in range(bits + 1)]
        assert edges[0][0] == 0 and edges[-1][1] == words * 64 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    row = spark.createDataFrame([([-1, 5],)], "h array<long>").select(*[arrivals._band(F.col("h"), k, 3, 2).alias(str(k)) for k in range(3)]).first()
    assert len(set(row)) == 3
