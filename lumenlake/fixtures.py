"""Library-shaped frames from the star-schema test tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.common import dealt

# Category slugs in their order; ids count from 1.
SLUGS = ["people", "selfie", "documents", "food", "travel", "dogs", "cats", "birds", "pets", "nature", "screenshots", "vehicles", "buildings", "other"]
EVENT_BASES = ["Trip", "Vacation", "Gathering", "Meetup", "Drive", "Documents", "City Visit", "Moments"]
JOB_TYPES = ["HASH", "OCR", "EMBEDDING", "CATEGORY", "FACE"]
JOB_STATES = ["QUEUED", "RUNNING", "COMPLETED", "FAILED"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _city(prefix_null: Column, city: Column, step: Column) -> tuple[Column, Column]:
    lat = F.when(~prefix_null, (F.lit(10) + 5 * city).cast("double") + step.cast("double") / 100)
    lng = F.when(~prefix_null, (F.lit(20) + 7 * city).cast("double") + step.cast("double") / 100)
    return lat, lng


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    lat, lng = _city(F.col("k") % 4 == 0, F.col("k") % 10, F.col("event_id") % 10)
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PROCESSING").otherwise("COMPLETED")
    return e.select(
        F.col("event_id").alias("image_id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("taken_at"),
        status.alias("status"),
        (F.col("event_id") % 20 == 7).alias("deleted"),
        lat.alias("lat"),
        lng.alias("lng"),
        F.when(F.col("event_id") % 3 == 0, "GOOGLE_PHOTOS").otherwise("LOCAL").alias("source"),
    )


def photo_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    kinds = {"view": "travel", "click": "documents", "purchase": "food", "signup": "people", "error": "other"}
    slug = F.lit(None).cast("string")
    for kind, name in kinds.items():
        slug = F.when(F.col("event_type") == kind, name).otherwise(slug)

    def confidence(m: int) -> Column:
        return ((F.col("event_id") * m) % 951 + 50).cast("double") / 1000

    first = e.select(F.col("event_id").alias("image_id"), slug.alias("slug"), confidence(37).alias("confidence"))
    return first.unionByName(e.where("event_id % 3 = 0").select(F.col("event_id").alias("image_id"), F.lit("nature").alias("slug"), confidence(53).alias("confidence")))


def lib_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("image_id"),
        F.col("p_name").alias("filename"),
        (key % 17 == 0).alias("deleted"),
        F.when(key % 11 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(key % 29 != 0, F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 3650 AS INT))")).alias("taken_at"),
        _pick(SLUGS, key % 14).alias("slug"),
        (((key * 37) % 951 + 50).cast("double") / 1000).alias("confidence"),
    )


def lib_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    lat, lng = _city(key % 3 == 0, key % 12, key % 10)
    start = F.when(key % 40 != 0, F.col("o_orderdate"))
    o = o.withColumn("start_at", start)
    return o.select(
        key.alias("event_id"),
        F.col("o_custkey").alias("user_id"),
        "start_at",
        F.expr("start_at + make_dt_interval(CAST(o_orderkey % 9 AS INT))").alias("end_at"),
        _pick(EVENT_BASES, key % 8).alias("title"),
        lat.alias("lat"),
        lng.alias("lng"),
    )


def lib_event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return dealt(items.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("image_id")), items.count(), "image_id").distinct()


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return dealt(items.select(F.col("l_partkey").alias("image_id"), F.col("l_suppkey").alias("cluster_id")), items.count(), "image_id").distinct()


def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("cluster_id"), F.col("s_nationkey").alias("user_id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("label"))


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    confidence = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.25)
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"),
        (F.col("doc_id") % 10).alias("user_id"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("language"),
        (F.col("doc_id") % 20 == 7).alias("deleted"),
        confidence.alias("confidence"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image_id"),
        (F.col("vec_id") % 5).alias("user_id"),
        F.col("label").alias("category"),
        F.expr("TIMESTAMP_NTZ'2023-01-01 00:00:00' + make_dt_interval(CAST(vec_id AS INT))").alias("taken_at"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five jobs per photo; a third of the photos have nothing but finished ones."""
    p = _table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"))
    types = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(t).alias("job_type")) for i, t in enumerate(JOB_TYPES)])).alias("x")
    each = p.select("image_id", types).select("image_id", "x.j", "x.job_type")
    state = F.when(F.col("image_id") % 3 == 0, 2 + (F.col("image_id") + F.col("j")) % 2).otherwise((F.col("image_id") + F.col("j")) % 4)
    return each.select("image_id", "job_type", "j", _pick(JOB_STATES, state).alias("status"))


def _sql_city(null: str, city: str, step: str) -> str:
    return f"CASE WHEN NOT ({null}) THEN CAST(10 + 5*({city}) AS DOUBLE) + CAST({step} AS DOUBLE)/100 END AS lat, CASE WHEN NOT ({null}) THEN CAST(20 + 7*({city}) AS DOUBLE) + CAST({step} AS DOUBLE)/100 END AS lng"


def _sql_pick(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS BIGINT) + 1]"


_SQL = {
    "photos": "SELECT event_id AS image_id, user_id, ts AS created_at, CASE WHEN event_id % 50 <> 0 THEN ts END AS taken_at, "
    "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, event_id % 20 = 7 AS deleted, "
    + _sql_city("k % 4 = 0", "k % 10", "event_id % 10")
    + ", CASE WHEN event_id % 3 = 0 THEN 'GOOGLE_PHOTOS' ELSE 'LOCAL' END AS source FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)",
    "photo_categories": "SELECT event_id AS image_id, CASE event_type WHEN 'view' THEN 'travel' WHEN 'click' THEN 'documents' WHEN 'purchase' THEN 'food' WHEN 'signup' THEN 'people' WHEN 'error' THEN 'other' END AS slug, "
    "CAST((event_id*37) % 951 + 50 AS DOUBLE)/1000 AS confidence FROM events UNION ALL SELECT event_id, 'nature', CAST((event_id*53) % 951 + 50 AS DOUBLE)/1000 FROM events WHERE event_id % 3 = 0",
    "lib_images": "SELECT p_partkey AS image_id, p_name AS filename, p_partkey % 17 = 0 AS deleted, CASE WHEN p_partkey % 11 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, "
    "CASE WHEN p_partkey % 29 <> 0 THEN TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(p_partkey % 3650 AS INTEGER)) END AS taken_at, "
    + _sql_pick(SLUGS, "p_partkey % 14")
    + " AS slug, CAST((p_partkey*37) % 951 + 50 AS DOUBLE)/1000 AS confidence FROM part",
    "lib_events": "SELECT o_orderkey AS event_id, o_custkey AS user_id, start_at, start_at + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS end_at, "
    + _sql_pick(EVENT_BASES, "o_orderkey % 8")
    + " AS title, "
    + _sql_city("o_orderkey % 3 = 0", "o_orderkey % 12", "o_orderkey % 10")
    + " FROM (SELECT *, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate END AS start_at FROM orders)",
    "lib_event_images": "SELECT DISTINCT l_orderkey AS event_id, l_partkey AS image_id FROM lineitem",
    "faces": "SELECT DISTINCT l_partkey AS image_id, l_suppkey AS cluster_id FROM lineitem",
    "face_clusters": "SELECT s_suppkey AS cluster_id, s_nationkey AS user_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS label FROM supplier",
    "ocr": "SELECT d.doc_id AS image_id, d.doc_id % 10 AS user_id, text AS raw_text, lang AS language, d.doc_id % 20 = 7 AS deleted, "
    "CAST(CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.25 END AS DOUBLE) AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "vec": "SELECT vec_id AS image_id, vec_id % 5 AS user_id, label AS category, TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(vec_id AS INTEGER)) AS taken_at, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "jobs": "SELECT image_id, job_type, j, "
    + _sql_pick(JOB_STATES, "CASE WHEN image_id % 3 = 0 THEN 2 + (image_id + j) % 2 ELSE (image_id + j) % 4 END")
    + f" AS status FROM (SELECT event_id AS image_id, unnest([0,1,2,3,4]) AS j, unnest({JOB_TYPES!r}) AS job_type FROM events)",
}


def sql(body: str, *names: str, **more: str) -> str:
    """body under WITH clauses for the named adapters and for further ones given by name."""
    parts = [f"{n} AS MATERIALIZED ({_SQL[n]})" for n in names] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
