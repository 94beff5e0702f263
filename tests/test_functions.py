"""Expressions and plain helpers on values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import geo, text, vector
from lumenlake.plans import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_vectors(spark):
    assert one(spark, vector.dot(vec(1, 2), vec(3, 4))) == 11
    assert one(spark, vector.cosine(vec(1, 0), vec(0, 0))) == 0
    assert one(spark, vector.cosine(vec(1, 1), vec(2, 2))) == pytest.approx(1)
    assert one(spark, vector.l2_normalize(vec(3, 4))) == [0.6, 0.8]
    assert one(spark, vector.l2_normalize(vec(0, 0))) == [0, 0]
    assert one(spark, vector.midpoint(vec(0, 2), vec(2, 4))) == [1, 3]


@pytest.mark.parametrize("a,b,want", [("ff" * 8, "ff" * 8, 0), ("00ff", "00fe", 1), ("0f", "0f0f", None), ("f" * 256, "0" * 256, 1024)])
def test_hamming(spark, a, b, want):
    assert one(spark, vector.hamming(F.lit(a), F.lit(b))) == want


def test_average_hash(spark):
    assert one(spark, vector.average_hash(vec(*[5] * 16))) == "ffff"
    assert one(spark, vector.average_hash(vec(0, 1, 1, 1, 0, 0, 0, 1))) == "71"


def test_haversine(spark):
    km = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert km == pytest.approx(math.pi * 6371 / 180) == geo.haversine(0, 0, 0, 1)
    assert one(spark, geo.missing(F.lit(0.0), F.lit(5.0))) and not one(spark, geo.missing(F.lit(1.0), F.lit(5.0)))


@pytest.mark.parametrize("value,want", [("hospital invoice", "invoice"), ("bank certificate", "certificate"), ("", "other"), (None, "other"), ("PAN card", "id")])
def test_document_type(spark, value, want):
    assert one(spark, text.document_type(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("hours,want", [(0, 1), (35, 1), (36, 2), (None, None)])
def test_duration(spark, hours, want):
    end = F.lit(None).cast("timestamp_ntz") if hours is None else F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + INTERVAL {hours} HOURS")
    assert one(spark, text.duration_days(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), end)) == want


def test_titles_and_urls(spark):
    none = F.lit(None).cast("timestamp_ntz")
    may = F.expr("TIMESTAMP_NTZ'2024-05-03 00:00:00'")
    assert one(spark, text.title(F.lit("travel"), may, F.lit(0), F.lit(1))) == "May 2024 Vacation"
    assert one(spark, text.title(F.lit("dogs"), none, F.lit(2), F.lit(0))) == "Moments"
    assert one(spark, text.title(F.lit("people"), none, F.lit(1), F.lit(0))) == "Solo Moments"
    assert one(spark, text.sized_url(F.lit("h/upload/a/upload/b"), "w_9")) == "h/upload/w_9/a/upload/b"
    assert one(spark, text.human_bytes(F.lit(1536))) == "1.5 KB"


@pytest.mark.parametrize(
    "query,want",
    [
        ("dec jan trip", {"month": 1}),
        ("with John at the beach", {"name": "john"}),
        ("with John Smith", {"name": "john smith"}),
        ("tourist photo", {"event_words": ["tour"]}),
        ("show my photos", {"semantic": "show my photos", "ocr_terms": []}),
        ("birthday party 2021", {"year": 2021, "event_words": ["party", "birthday party", "birthday"]}),
    ],
)
def test_intent(spark, query, want):
    got = search.read_intent(spark, query)
    assert {k: getattr(got, k) for k in want} == want


def scores(spark, *values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "image_id long, score double")


def test_categories_of_texts(spark):
    texts = spark.createDataFrame([(1, " Puppies", [1.0, 0.0]), (2, "a dinner", [1.0, 0.0]), (3, "anything", [0.5, 0.5]), (4, "puppys", [0.0, 0.0])], "query long, text string, v array<double>")
    prototypes = spark.createDataFrame([("food", [1.0, 0.0]), ("pets", [-1.0, 0.0]), ("other", [0.0, 1.0])], "slug string, centre array<double>")
    got = [(r["query"], r["slug"], round(r["confidence"], 2), r["rn"]) for r in search.classify_text(texts, prototypes).orderBy("query", "rn").collect()]
    assert got == [(1, "dogs", 1.0, 1), (2, "food", 0.87, 1), (3, "food", 0.47, 1)]
    assert [one(spark, search.category_of(F.lit(t))) for t in ("puppies", "selfies", "puppys", "other", "ARCHITECTURE ")] == ["dogs", "selfie", None, None, "buildings"]


def test_headings_and_ages(spark):
    now = F.expr("TIMESTAMP_NTZ'2024-05-20 12:00:00'")
    ages = {"2024-05-20 11:59:30": "just now", "2024-05-20 11:15:00": "45m ago", "2024-05-19 13:00:00": "23h ago", "2024-05-14 00:00:00": "6d ago", "2024-05-01 00:00:00": "May 1, 2024"}
    assert {t: one(spark, text.ago(F.expr(f"TIMESTAMP_NTZ'{t}'"), now)) for t in ages} == ages
    assert one(spark, text.month_key(now)) == "2024-05" and one(spark, text.month_name(now)) == "May 2024"
    assert one(spark, text.month_name(F.lit(None).cast("timestamp_ntz"))) is None


def test_relative_cutoff(spark):
    assert search.relative_cutoff(scores(spark, 0.40, 0.39, 0.38, 0.25)).count() == 3
    assert search.relative_cutoff(scores(spark, 0.25)).count() == 1


def test_fusion(spark):
    signals = {"face": scores(spark, 1.0), "semantic": scores(spark, 0.5)}
    row = search.fuse(signals).first()
    assert row["score"] == pytest.approx(0.25) and row["signals"] == "semantic,face"


def test_text_score_and_date_filter(spark):
    ocr = spark.createDataFrame([(1, "alpha only", False), (2, "none", False), (3, "alpha beta", True)], "image_id long, raw_text string, deleted boolean")
    intent = search.Intent("", ocr_terms=["alpha", "beta"], year=2023)
    assert [(r["image_id"], r["score"]) for r in search.by_text(ocr, intent).collect()] == [(1, pytest.approx(0.4))]
    times = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2023-12-31 23:59:59.500'), (TIMESTAMP_NTZ'2023-12-31 23:59:59'), (CAST(NULL AS TIMESTAMP_NTZ)) t(taken_at)")
    assert times.where(search.date_filter(intent)).count() == 1
    assert times.where(search.date_filter(search.Intent("", month=12), as_of_year=2024)).count() == 1


def test_a_written_index_finds_the_same(spark, tmp_path):
    texts = ["The theory of winter", "with the", "Wine and thyme, wine", "", None, "thé wi", "deleted with the"]
    ocr = spark.createDataFrame([(i, t, i == 6) for i, t in enumerate(texts)], "image_id long, raw_text string, deleted boolean")
    search.text_index(ocr).orderBy("term").write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    for query in ("Th wi", "the", "wine", "zzz", "", "th the"):
        want = [(r["image_id"], round(r["rank"], 9)) for r in search.full_text(ocr, query).collect()]
        assert [(r["image_id"], round(r["rank"], 9)) for r in search.search_index(index, query).collect()] == want
    plan = search.search_index(index, "wi")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,wi)" in plan


def test_recognised_text_and_errors(spark):
    rows = spark.createDataFrame([(1, "a", "deu", 87.0), (2, " ", None, 0.5), (3, "", "eng", 90.0), (4, None, "eng", 1.0), (5, "b", "", None), (6, "c", "fra", 1.0)], "id int, raw_text string, language string, confidence double")
    got = {r["id"]: (r["language"], r["confidence"]) for r in text.recognised(rows).collect()}
    assert got == {1: ("deu", 0.87), 2: ("eng", 0.5), 5: ("eng", 0.0), 6: ("fra", 1.0)}
    assert one(spark, text.error_text(F.lit("é" * 1_500))) == "é" * 1_000 and one(spark, text.error_text(F.lit(None).cast("string"))) is None
