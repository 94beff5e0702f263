"""Schemas of the library tables, and the checks that a loader makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the library tables.
TABLES = {
    "users": (
        "id string NOT NULL, email string NOT NULL, password_hash string, name string NOT NULL, avatar_url string, created_at timestamp_ntz NOT NULL, "
        "updated_at timestamp_ntz NOT NULL"
    ),
    "images": (
        "id string NOT NULL, user_id string NOT NULL, filename string NOT NULL, cloudinary_id string NOT NULL, cloudinary_url string NOT NULL, width "
        "int, height int, file_size bigint, mime_type string, sha256_hash string, phash string, source string NOT NULL, google_photos_id string, "
        "taken_at timestamp_ntz, location_lat decimal(9,6), location_lng decimal(9,6), metadata string, processing_status string NOT NULL, created_at "
        "timestamp_ntz NOT NULL, updated_at timestamp_ntz NOT NULL, deleted_at timestamp_ntz"
    ),
    "categories": (
        "id int NOT NULL, slug string NOT NULL, label string NOT NULL"
    ),
    "image_categories": (
        "image_id string NOT NULL, category_id int NOT NULL, confidence decimal(4,3)"
    ),
    "ocr_records": (
        "id string NOT NULL, image_id string NOT NULL, raw_text string NOT NULL, language string, confidence decimal(4,3), created_at timestamp_ntz "
        "NOT NULL, updated_at timestamp_ntz NOT NULL"
    ),
    "face_clusters": (
        "id string NOT NULL, user_id string NOT NULL, label string, cover_face_id string, created_at timestamp_ntz NOT NULL, updated_at timestamp_ntz "
        "NOT NULL"
    ),
    "faces": (
        "id string NOT NULL, image_id string NOT NULL, cluster_id string, bbox_x double NOT NULL, bbox_y double NOT NULL, bbox_w double NOT NULL, "
        "bbox_h double NOT NULL, detection_score decimal(4,3), embedding_id string, qdrant_id string NOT NULL, created_at timestamp_ntz NOT NULL, "
        "updated_at timestamp_ntz NOT NULL"
    ),
    "events": (
        "id string NOT NULL, user_id string NOT NULL, title string NOT NULL, cover_image_id string, start_at timestamp_ntz, end_at timestamp_ntz, "
        "location_lat decimal(9,6), location_lng decimal(9,6), metadata string, created_at timestamp_ntz NOT NULL, updated_at timestamp_ntz NOT NULL"
    ),
    "event_images": (
        "event_id string NOT NULL, image_id string NOT NULL"
    ),
    "duplicate_groups": (
        "id string NOT NULL, user_id string NOT NULL, type string NOT NULL, representative_image_id string, created_at timestamp_ntz NOT NULL, "
        "updated_at timestamp_ntz NOT NULL"
    ),
    "duplicate_group_members": (
        "group_id string NOT NULL, image_id string NOT NULL"
    ),
    "processing_jobs": (
        "id string NOT NULL, image_id string NOT NULL, job_type string NOT NULL, status string NOT NULL, attempts int NOT NULL, error string, "
        "queued_at timestamp_ntz NOT NULL, started_at timestamp_ntz, completed_at timestamp_ntz"
    ),
    "event_jobs": (
        "id string NOT NULL, user_id string NOT NULL, status string NOT NULL, error string, image_count int, event_count int, queued_at timestamp_ntz "
        "NOT NULL, started_at timestamp_ntz, completed_at timestamp_ntz"
    ),
}

# The domains of the enumerated columns.
DOMAINS = {
    "processing_status": ("PENDING", "PROCESSING", "COMPLETED", "FAILED"),
    "source": ("LOCAL", "GOOGLE_PHOTOS"),
    "job_type": ("HASH", "OCR", "EMBEDDING", "CATEGORY", "FACE", "DUPLICATE", "CLUSTER"),
    "status": ("QUEUED", "RUNNING", "COMPLETED", "FAILED"),
    "type": ("EXACT", "NEAR"),
}


def load(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def faults(df: DataFrame) -> DataFrame:
    """Rows of df that break a rule, with `fault`: a value outside its domain, or one coordinate of two."""
    found = [F.when(~F.col(c).isin(*values), F.lit(f"{c} outside its domain")) for c, values in DOMAINS.items() if c in df.columns]
    for lat, lng in (("location_lat", "location_lng"), ("lat", "lng")):
        if lat in df.columns and lng in df.columns:
            found.append(F.when(F.col(lat).isNull() != F.col(lng).isNull(), F.lit("half a coordinate")))
    if not found:
        return df.limit(0).withColumn("fault", F.lit(""))
    return df.withColumn("fault", reduce(lambda a, b: F.coalesce(a, b), found)).where("fault is not null")
