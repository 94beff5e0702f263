"""What the findings of round 4 named, on small tables."""

import datetime
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_fulltext import QUERIES, plain_search, records

from lumenlake.operators import fulltext, stored
from lumenlake.plans import catalogue


def shuffled(spark):
    """Rows that stages have written to shuffles until now."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_records_that_match_are_not_shuffled(spark, monkeypatch):
    """every record that matched a query was a row of two shuffles, as many as queries times records."""
    texts = spark.range(600).select(F.col("id").alias("image_id"), F.concat(F.lit("running houses "), F.repeat(F.lit("house "), (F.col("id") % 7).cast("int"))).alias("raw_text"))
    asked = spark.range(150).select(F.col("id").alias("query"), F.concat(F.lit("house run"), F.when(F.col("id") % 2 == 0, " hous").otherwise("")).alias("text"))
    monkeypatch.setattr(fulltext, "PART_WORDS", 1_500)
    for found in (fulltext.find_texts(texts, asked, 3), fulltext.find(fulltext.index(texts), asked, 3)):
        before = shuffled(spark)
        rows = found.collect()
        assert len(rows) == 450 and {r["image_id"] for r in rows} == {594, 587, 580}
        assert shuffled(spark) - before < 9_000  # 90,000 matches


def test_parts_find_what_a_plain_search_finds(spark, monkeypatch):
    rows = [(f"k{k}", t) for k, t in records(120)] + [(f"k{k}", "conn hop run") for k in range(5)] + [(None, "running")]
    plain, times = {}, {f"k{k}": k * 7 % 13 for k in range(60)}
    for k, t in rows:
        plain.setdefault(k, []).append(t)
    monkeypatch.setattr(fulltext, "PART_WORDS", 400)
    monkeypatch.setattr(fulltext, "PART_QUERIES", 4)
    frame = spark.createDataFrame(rows, "image_id string, raw_text string").repartition(3)
    order = spark.createDataFrame(list(times.items()), "image_id string, at int")
    got = {}
    for r in fulltext.find_texts(frame, spark.createDataFrame(list(enumerate(QUERIES)), "query int, text string"), 9, order=order).orderBy("query", "rn").collect():
        got.setdefault(r["query"], []).append((r["image_id"], round(r["rank"], 9)))
    once = [k for k, t in plain.items() if len(t) == 1]
    for n, q in enumerate(QUERIES):
        want = plain_search([(k, plain[k][0]) for k in once], q)
        best = sorted(want, key=lambda k: (round(want[k], 9), k in times, times.get(k, 0), k is not None, k or ""), reverse=True)
        mine = [(k, x) for k, x in got.get(n, []) if k in once]
        assert mine == [(k, round(want[k], 9)) for k in best][: len(mine)] and len(got.get(n, [])) >= min(9, len(want)), q
    assert fulltext.find_texts(frame.limit(0), spark.createDataFrame([(1, "run")], "query int, text string")).count() == 0


def test_pairs_of_places_are_added_in_any_cut(monkeypatch):
    postings = pa.table({"term": ["b", "a", "a", "b", "a", "b"], "k": [1, 1, 2, 2, 3, 3], "positions": pa.array([list(range(0, 400, 2)), list(range(1, 400, 2)), [0, 500], [500, 50], [0], [200]], pa.list_(pa.int32()))})
    part = fulltext._Part(postings, pa.table({"k": pa.array([2], pa.int64()), "__at": pa.array([5], pa.int32())}), "k")
    whole = part.first(("a", "b"), 9)
    near = 1 - (1 - 0.1 * np.sqrt(1 / (1.005 + 0.05 * np.exp(50 / 1.5 - 2))))
    assert part.keys.take(pa.array(whole[0])).to_pylist() == [1, 2, 3] and whole[1][0] == 1 and abs(whole[1][1] - near) < 1e-15 and whole[1][2] == 1e-20
    for pairs in (1, 7, 1_000):
        monkeypatch.setattr(fulltext, "PAIRS", pairs)
        cut = part.first(("a", "b"), 9)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()


def test_many_owners_are_replaced_without_a_folder_each(spark, tmp_path, monkeypatch):
    """each owner was a folder, which the driver put in place one by one; and an owner of no new rows kept the old."""
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, i % 300, "view", 1.0, "{}") for i in range(600)] + [(601, at, 1_000, "error", 1.0, "{}"), (700, at, None, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "in" / "events.parquet"))
    got = catalogue.queries()["replaced_tenants"](spark, str(tmp_path / "in"))
    want = [(u, i, "REBUILT" if u % 5 == 0 else "FAILED" if kind == "error" else "COMPLETED") for i, _, u, kind, *_ in rows if u is not None and (u % 5 or i % 2 == 0)]
    assert sorted(tuple(r) for r in got.select("user_id", "image_id", "status").collect()) == sorted(want)
    assert len({f.parent for f in tmp_path.rglob("*.parquet") if f.is_file()}) <= 1 + 2 * stored.BUCKETS


def test_a_replacement_touches_only_buckets_of_its_owners(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "owner long, id long"
    stored.create(spark.range(400).select((F.col("id") % 20).alias("owner"), "id").unionByName(spark.createDataFrame([(None, 1)], schema)), root, ["owner", "id"], ["owner"], 8)
    files = lambda: set((tmp_path / "t").rglob("*.parquet"))
    first = files()
    assert stored.replace(spark, root, spark.createDataFrame([(3, -1), (None, 2)], schema), spark.createDataFrame([(4, 0)], schema)) == 1
    assert len({f.parent for f in files() - first}) <= 3 and first <= files()
    want = [(i % 20, i) for i in range(400) if i % 20 not in (3, 4)] + [(3, -1), (None, 2)]
    assert sorted(((r["owner"], r["id"]) for r in stored.read(spark, root).collect()), key=str) == sorted(want, key=str)
    with pytest.raises(stored.Conflict):
        stored.replace(spark, root, spark.createDataFrame([(3, 5)], schema), version=0)
