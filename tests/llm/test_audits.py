"""Source divergence and filter interactions against plain versions."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from lumenlake.llm import divergence, interactions

DOCS = "doc_id long, text string, lang string, source string"


def documents(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}x" for i in range(25)] + ["Été", "ÉTÉ", "A1B", "naïve", "a b", "İx", "KelvinK", "x\x00y", "-", "42", "#tag", "UPPER CASE"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(words[: rng.choice([6, 20, len(words)])]) for _ in range(rng.randint(0, 260)))
        rows.append((i, rng.choice([text, text, text, None, "", "A A A"]), rng.choice(["en", "en", "en", "de", None, "", "xx"]), rng.choice(["s1", "s1", "s2", "s3", None, "", "ß"])))
    rows += [rows[k] for k in (3, 3, 7)] + [(900 + k, rows[5][1], "de", "s1") for k in range(4)] + [(None, rows[5][1], "en", "s1"), (None, None, None, None)]
    return rows + [(1000, "only words here", "lone", "one"), (1001, "...", "two", "a"), (1002, None, "two", "b")]


def plain_divergence(rows, min_df, top):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, whole, groups = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            df.update(terms.keys())
            whole.update(terms)
            groups[source].update(terms)
        kept = sorted(t for t in df if df[t] >= min_df)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[r][t]) for t in kept), r) for r in groups if r != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("tile,block", [(256, 10_000), (2, 7)])
def test_divergence_equals_a_plain_version(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as p", "2 as term", "3 as n", "4 as rank").repartition(5)
    got = divergence.audit(df, min_df=4, top_terms=5)
    want = plain_divergence(rows, 4, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[2] for r in want} == {"pair", "term"}
    assert any(r[2] == "pair" and r[4] == 0 for r in want)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    one = spark.createDataFrame([(1, None, None, None)], DOCS)
    assert divergence.audit(one).collect() == []


def test_vectors_are_those_of_the_count_vectoriser(spark):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in documents() if r[0] is not None], DOCS).withColumn("terms", F.lit(1)).dropDuplicates(["doc_id"])
    vectors = divergence.document_vectors(df).cache()
    sums = divergence.group_sums(df)
    for lang in ("en", "de"):
        some = vectors.where(F.col("lang") == lang).withColumn("words", F.flatten(F.transform(F.arrays_zip("terms", "counts"), lambda x: F.array_repeat(x["terms"], x["counts"].cast("int")))))
        model = CountVectorizer(inputCol="words", outputCol="v", minDF=4, vocabSize=divergence.VOCAB_SIZE).fit(some)
        assert sorted(model.vocabulary) == sorted(r.term for r in divergence.vocabulary(sums, 4).where(F.col("lang") == lang).collect())
        for r in model.transform(some).collect():
            mine = {t: c for t, c in zip(r.terms, r.counts) if t in model.vocabulary}
            assert mine == {model.vocabulary[int(i)]: int(x) for i, x in zip(r.v.indices, r.v.values)}
    top = divergence.vocabulary(sums, 1, 3).where("lang = 'en'").collect()
    counts = {r.term: r.lang_n for r in divergence.vocabulary(sums, 1).where("lang = 'en'").collect()}
    assert {r.term for r in top} == set(sorted(counts, key=lambda t: (-counts[t], t.encode()))[:3])


def plain_interactions(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], quality == 1), max(marks[i][1], toxic == 1)]
    docs = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), i is not None and first[text] < i)) if x}
        docs.append((lang or "", fails, *(marks[i] if i in marks else (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(order):
                lost = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + lost
                total[f] += len(lost)
                alone = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, order, k + 1] = [len(left), len(lost), redundant, alone, sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return [(*k, *v) for k, v in out.items()]


def test_interactions_equal_a_plain_version(spark):
    rows = documents(200, 5)
    rng = random.Random(1)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(150)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5000, 1, 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as mask", "2 as digest", "3 as good").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    got = interactions.audit(df, marks)
    want = plain_interactions(rows, labels)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert all(sum(r[k] for r in want) for k in range(3, 10))


def test_interactions_of_nothing_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(spark.createDataFrame([], DOCS), none).collect() == []
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (3, long + " |", "en", "s")]
    assert sorted(map(tuple, interactions.audit(spark.createDataFrame(rows, DOCS), none).collect())) == sorted(plain_interactions(rows, []))


def test_fields_do_not_run_over():
    most = 2**63 - 1
    masks = [interactions._outcomes(m)["removed"] for m in range(32)]
    total = sum(masks) * (most // 32)
    assert (interactions._unpacked(total) == sum(interactions._unpacked(m) for m in masks) * (most // 32)).all()
    full = interactions._packed([True] * 600) * most
    assert (interactions._unpacked(full) == most).all()
