"""What the findings of round 3 name, on small tables that showed the fault."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlake import fixtures as fx
from lumenlake.functions import english
from lumenlake.functions.vector import dot
from lumenlake.llm import jaccard
from lumenlake.operators import common, duplicates, events, fulltext, neighbours, scoring
from lumenlake.plans import catalogue, library, search


def test_labelled_rows_are_all_read_back(spark, tmp_path):
    """several arrays came to one file, and all but its first were lost."""
    spark.range(95_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    got = catalogue.queries()["labelled_rows"](spark, str(tmp_path))
    want = spark.read.parquet(str(tmp_path / "labels.parquet")).select("doc_id", "quality", "toxic")
    assert got.count() == 95_000 and got.exceptAll(want.withColumns({c: F.col(c).cast(got.schema[c].dataType) for c in got.columns})).isEmpty()


def test_hashes_that_share_most_bands_are_compared_by_blocks(spark):
    """hashes most of whose bits are alike met by nearly every band, many times each."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        word = sum(1 << b for b in rng.sample(range(64), 9))
        rows.append((k % 2, k, [word if word < 1 << 63 else word - (1 << 64)] + [0] * 15))
    items = spark.createDataFrame(rows, "user_id long, image_id long, h array<long>")
    near = duplicates.near_pairs(items, 12, 16)
    assert "Join" not in near._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]
    want = {(u, a, b, (ha[0] ^ hb[0]).bit_count() if ha[0] ^ hb[0] >= 0 else ((ha[0] ^ hb[0]) + (1 << 64)).bit_count()) for u, a, ha in rows for v, b, hb in rows if u == v and a < b}
    assert {tuple(r) for r in near.collect()} == {w for w in want if w[3] <= 12}
    small = neighbours.near_bits(items, 12, block=40)
    assert {tuple(r) for r in small.collect()} == {w for w in want if w[3] <= 12}


def test_all_pairs_of_an_owner_are_scored(spark):
    """pairs of vectors that are far apart in the order of ids count as well."""
    rng = random.Random(6)
    rows = [(k % 2, k, None if k % 50 == 9 else k % 3, [rng.gauss(0, 9 if k % 7 == 0 else 0.3) for _ in range(8)]) for k in range(160)]
    rows += [(2, 1_000 + k, 1, [0.5, 0.5, 0.5, 0.000001] + [0.0] * 4) for k in range(4)]
    items = spark.createDataFrame(rows, "user_id long, image_id long, category int, v array<double>")
    a, b = (items.select("user_id", *[F.col(c).alias(f"{c}_{x}") for c in ("image_id", "category", "v")]) for x in "ab")
    plain = a.join(b, "user_id").where("image_id_a < image_id_b").select((F.col("category_a") == F.col("category_b")).alias("relevant"), F.round(dot("v_a", "v_b"), 6).alias("score"))
    want = sorted(map(tuple, plain.groupBy("relevant", "score").count().collect()), key=str)
    assert sorted(map(tuple, neighbours.pair_scores(items).collect()), key=str) == want
    assert sorted(map(tuple, neighbours.pair_scores(items, block=30).collect()), key=str) == want
    for f in (scoring.score_stats, scoring.threshold_sweep):
        one, many = (sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(p).collect()], key=str) for p in (plain, neighbours.pair_scores(items, block=30)))
        assert one == many and len(one) > 2
    stats = catalogue.queries()["score_stats"](spark, "/root/testdata/sf0.001")
    assert stats.agg(F.sum("n")).first()[0] == 5 * 100 * 99 // 2


def stages(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_faces_are_not_multiplied_by_events(spark):
    """Each face of an image came once per event that has the image."""
    rng = random.Random(7)
    images = spark.createDataFrame([(i, i % 9 == 0, rng.choice(["a", "b", "c", "d", None])) for i in range(40)], "image_id long, deleted boolean, slug string")
    members = sorted({(rng.randrange(25), rng.randrange(45)) for _ in range(300)})
    faces = sorted({(rng.randrange(45), rng.randrange(12)) for _ in range(120)})
    events = spark.createDataFrame([(e, 1, "t", None) for e in range(27)], "event_id long, user_id long, title string, start_at timestamp_ntz")
    held = spark.createDataFrame(members, "event_id long, image_id long"), images, spark.createDataFrame(faces, "image_id long, cluster_id long")
    df = library.event_summaries(events, *held, sample=6)
    assert "cluster_id#" not in stages(df).split("ObjectHashAggregate")[0]  # above the arrays no row is a face
    slug = {r["image_id"]: r["slug"] for r in images.collect() if not r["deleted"]}
    for r in df.collect():
        own = [i for e, i in members if e == r["event_id"] and i in slug]
        first = [slug[i] for i in own[:6]]
        top = sorted(set(first), key=lambda s: (-first.count(s), first.index(s)))[:3]
        assert (r["n_images"], r["people"]) == (len(own), len({c for i, c in faces if i in own[:6]}))
        assert r["categories"] == ",".join(s for s in top if s is not None)


def test_tables_are_dealt_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    """a task's share grew with the table, as the number of tasks was fixed."""
    assert common.dealt(spark.range(10), 10, "id").rdd.getNumPartitions() == 1
    assert common.dealt(spark.range(10), 3 * common.TASK_ROWS + 1, "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    assert fx.faces(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 12
    trips = library.trips(fx.lib_events(spark, "/root/testdata/sf0.001"), fx.lib_event_images(spark, "/root/testdata/sf0.001"), fx.lib_images(spark, "/root/testdata/sf0.001"))
    assert trips.rdd.getNumPartitions() > 4


def test_texts_of_one_category_rank_its_images_once(spark):
    """F16: images were sorted once per text that names their category."""
    images = spark.createDataFrame([(i, False, "dogs" if i % 2 else "cats", i / 100) for i in range(100)], "image_id long, deleted boolean, slug string, confidence double")
    named = spark.createDataFrame([(q, "dogs", 1) for q in range(30)] + [(40, "cats", 2)], "query long, slug string, rn int")
    df = search.by_named_category(images, named, limit=5)
    assert {(r["query"], r["image_id"]) for r in df.collect()} == {(q, i) for q in range(30) for i in (99, 97, 95, 93, 91)}
    assert "windowspecdefinition(slug" in df._jdf.queryExecution().analyzed().toString()


def test_buckets_that_look_alike_carry_their_vectors_once(spark):
    """vectors were taken apart into rows, and pairs met in two cells."""
    rng = random.Random(10)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(7)]
    rows = [(k % 2, k, [100 * k + j for j in range(rng.randint(1, 13))], datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 24, 167, 168, 169]) * rng.randint(0, 5)) if k % 10 else None) for k in range(60)]
    buckets = spark.createDataFrame(rows, "user_id long, bucket long, images array<long>, start_at timestamp_ntz")
    df = events.look_pairs(buckets, spark.createDataFrame(vectors, "image_id long, v array<double>"), 0.3, 7, of=F.col("image_id") % 7)
    mean = {b: np.mean([vectors[i % 7][1] for i in images[: events.LOOK_IMAGES]], axis=0) for _, b, images, _ in rows}
    want = {}
    for u, b, _, t in rows:
        for w, c, _, x in rows:
            if u == w and b < c and t and x and abs(t - x) <= timedelta(days=7):
                cosine = mean[b] @ mean[c] / np.linalg.norm(mean[b]) / np.linalg.norm(mean[c])
                if cosine >= 0.3:
                    want[u, b, c] = round(float(cosine), 6)
    assert {(r[0], r[1], r[2]): round(r[3], 6) for r in df.collect()} == want and len(want) > 50 and df.count() == len(want)
    assert "posexplode(v" not in stages(df)


def test_a_query_is_split_once_for_all_event_words(spark):
    """every event word and month split the text anew."""
    q = spark.createDataFrame([("A Trip in May 2023 with anna and bob",), (None,), ("",)], "q string")
    got = q.select(*[c.alias(n) for n, c in search.intent_columns("q").items()])
    assert got.first()["month"] == 5 and got.first()["year"] == 2023 and got.first()["name"] == "anna"
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(array_contains(split" not in plan and "array_position(split" not in plan


def test_ranks_of_equal_places_are_equal(spark):
    """sums of doubles put records of equal rank in the order of their rounding errors."""
    rng = random.Random(3)
    gaps = [1, 2, 3, 5, 7, 11, 13]
    rows = []
    for k in range(12):
        rng.shuffle(gaps)
        # pairs 200 words apart do not meet, so the order of the gaps is all that differs
        rows.append((k, " ".join(("red " + "x " * (g - 1) + "blue " + "y " * 200) for g in gaps)))
    texts = spark.createDataFrame(rows, "image_id long, raw_text string")
    asked = spark.createDataFrame([(0, "red blue")], "query long, text string")
    got = fulltext.ranked(fulltext.index(texts), asked).collect()
    assert len(got) == 12 and len({r["rank"] for r in got}) == 1


def test_sets_that_sizes_or_equal_blocks_rule_out_make_no_rows(spark, monkeypatch):
    """op3_ngram_jaccard: a shingle that unlike sets share made a block, and a passage made one for each of its shingles."""
    rng = random.Random(33)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(20), []
    for k in range(12):  # of very different sizes
        texts.append(passage + words(22 * 2**k // 4 + 200))
    for _ in range(5):  # a family of copies with another of its size, and chains of copies of slowly changing sizes
        base = words(150)
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(150)] = words(1)[0]
            texts.append(copy + words(2 * k))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, tiles = [], jaccard._tiles
    monkeypatch.setattr(jaccard, "_tiles", lambda df, key, chunks: (key == "token" and rows.append(df.count()), tiles(df, key, chunks))[1])
    for num, den in ((90, 100), (8, 10), (1, 1)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs, 3, num, den, counted=False).collect()}
        sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
        want = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and want[a] != want[b]:
                    low, high = sorted((want[a], want[b]))
                    want = [low if w == high else w for w in want]
        assert got == dict(enumerate(want))
    # 119 where each shingle made a block
    assert len(rows) == 3 and rows[0] < 90


def test_many_tenants_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """a rebalance by size left thousands of small folders to one task."""
    path = str(tmp_path / "t")
    rows = spark.range(3_000).select((F.col("id") % 600).alias("user_id"), F.col("id").alias("x"))
    written = lambda: {f.name.split("-")[1] for f in (tmp_path / "t").rglob("*.parquet")}
    common.replace_tenant(rows, path)
    assert len(written()) >= 4
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    changed = rows.where("user_id = 7").unionByName(spark.range(2_000).select(F.lit(7).cast("long").alias("user_id"), (-1 - F.col("id")).alias("x")))
    before = {f for f in (tmp_path / "t").rglob("*.parquet") if "user_id=7/" not in str(f)}
    common.replace_tenant(changed, path)
    assert len(list((tmp_path / "t" / "user_id=7").glob("*.parquet"))) >= 2 and all(f.exists() for f in before)
    want = rows.where("user_id <> 7").unionByName(changed)
    got = spark.read.parquet(path).select(F.col("user_id").cast("long").alias("user_id"), "x")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    common.replace_tenant(rows.limit(0), path)
    assert spark.read.parquet(path).count() == want.count()


def test_an_index_is_built_by_one_shuffle_of_postings(spark, tmp_path):
    """every occurrence of a word was a row, shuffled three times, and every text was split twice."""
    rng = random.Random(9)
    vocabulary = [rng.choice(["run", "hop", "relat", "ski", "sky", "gener", "vis", "été", "x9"]) + rng.choice(["", "s", "ies", "ing", "ation", "edly", "y"]) for _ in range(60)] + ["the", "and", "dying", "news"]
    texts = [(i % 70, rng.choice(["", "- "]) + " ".join(rng.choices(vocabulary, k=rng.randrange(120))) + rng.choice(["", ".", " !"])) for i in range(90)] + [(200, None), (201, ""), (202, "..."), (203, "the and")]
    docs = spark.createDataFrame(texts, "image_id long, raw_text string").repartition(3)
    each = docs.select("image_id", F.posexplode(F.filter(F.split(F.lower("raw_text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")).alias("pos", "word")).where(~english.is_stop_word("word"))
    want = {}
    for r in each.select("image_id", "pos", english.stem("word").alias("term")).collect():
        want.setdefault((r["term"], r["image_id"]), []).append(r["pos"])
    want = {k: sorted(v) for k, v in want.items()}
    built = fulltext.index(docs)
    for found in (built, fulltext.write_index(docs, str(tmp_path / "index"))):
        rows = found.collect()
        assert {(r["term"], r["image_id"]): r["positions"] for r in rows} == want and len(rows) == len(want)
    plan = stages(fulltext.index(docs))
    assert plan.count("Exchange") == 2 and "posexplode" not in plan  # one of them is this test's own
    # what batches cut, and keys that are null
    schema = pa.schema([("term", pa.string()), ("k", pa.int64()), ("positions", pa.list_(pa.int32()))])
    rows = [("a", None, [4]), ("a", None, [1, 7]), ("a", 1, [3]), ("a", 1, [0]), ("a", 1, [2, 9]), ("b", 1, [5]), ("b", 2, [6])]
    joined = fulltext._joined(pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 2]], schema) for i in range(0, 7, 2))
    assert [tuple(r.values()) for b in joined for r in b.to_pylist()] == [("a", None, [1, 4, 7]), ("a", 1, [0, 2, 3, 9]), ("b", 1, [5]), ("b", 2, [6])]


def test_a_stem_is_the_same_in_a_task_as_in_a_column(spark):
    rng = random.Random(99)
    ends = "s sses ied ies us ss eed eedly ed edly ing ingly y ization ational fulness ousli ogi li ical ative ement ion al er ic e l".split()
    words = sorted({rng.choice(["", "y", "gener", "commun", "arsen", "sh"]) + "".join(rng.choices("aeiouybcdlnrstw", k=rng.randrange(6))) + rng.choice(ends) for _ in range(3_000)} | set(english.KNOWN) | {"é", "straße", "日本", "a1ing"})
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", english.stem("word").alias("term"))
    assert [(r["word"], r["term"]) for r in got.collect() if r["term"] != english.stem_of(r["word"])] == []


def test_cells_of_one_set_reach_no_join(spark, monkeypatch):
    """op3_ngram_jaccard: all cells were shuffled to be joined with those of several sets, once these were too many to broadcast."""
    rng = random.Random(3)
    sets = [[rng.randrange(10**15) for _ in range(20)] for _ in range(300)]
    sets += [s[:18] + [rng.randrange(10**15) for _ in range(2)] for s in sets[:20]]
    reps = spark.createDataFrame([(i, 100 + i % 3, s) for i, s in enumerate(sets)], "node long, n long, prefix array<long>")
    cells = jaccard._cells(reps, 90, 100)
    seen, kept = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: (seen.append((name, df)), kept(df, name))[1])
    got = {(r["token"], r["node"]): (r["size"], r["hub"]) for r in jaccard._blocks(cells).collect()}
    by = {}
    for r in cells.collect():
        by.setdefault(r["token"], []).append((r["node"], r["own"]))
    want, tokens = {}, {}
    for token, rows in by.items():
        if len(rows) > 1 and any(own for _, own in rows):
            nodes = tuple(sorted(n for n, _ in rows))
            tokens[nodes] = min(token, tokens.get(nodes, token))
    for nodes, token in tokens.items():
        want |= {(token, n): (len(nodes), nodes[0]) for n in nodes}
    assert got == want and len(tokens) == 20
    first = next(df for name, df in seen if name == "blocks")
    assert "MapInArrow picked" in first._jdf.queryExecution().optimizedPlan().toString()
    # the filter alone lets little else through
    size = 16
    bits = jaccard._id_filter(spark.createDataFrame([(t,) for t in tokens.values()], "token long"), size)
    held = jaccard._held(bits, np.array(list(by), np.int64), size).to_numpy(zero_copy_only=False)
    assert held[[t in set(tokens.values()) for t in by]].all() and held.sum() < len(by) / 20
