"""File sources: labelled JSON, binary images with type sniffing, and job streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted types and the bytes that such files begin with, in hex; brands of the container behind
# "ftyp", and the two byte orders of another.
MAGIC = {"image/jpeg": ["FFD8FF"], "image/png": ["89504E470D0A1A0A"], "image/gif": ["474946"], "image/tiff": ["49492A00", "4D4D002A"]}
BRANDS = {"heic": "image/heic", "heix": "image/heic", "mif1": "image/heif"}
MOST_BYTES, MOST_FILES = 25 << 20, 20


def sniff(content: Column | str) -> Column:
    """The MIME type that a file's first bytes show; null for others."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(c, 1, 12))
    chain = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for mime, starts in MAGIC.items():
        chain = chain.when(reduce(lambda a, b: a | b, (F.startswith(head, F.lit(m)) for m in starts)), mime)
    for brand, mime in BRANDS.items():
        chain = chain.when(F.substring(head, 9, 16) == (b"ftyp" + brand.encode()).hex().upper(), mime)
    return chain


def images(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under path with mime_type, sha256 and `fault` (null for files that pass)."""
    return checked(spark.read.format("binaryFile").load(path), most_bytes)


def checked(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files (content, length, ...) with mime_type, sha256 and `fault`, which tells those that fail from those that pass."""
    told = files.withColumns({"mime_type": sniff("content"), "sha256": F.sha2("content", 256)})
    return told.withColumn("fault", F.when(F.col("length") > most_bytes, "too large").when(F.col("mime_type").isNull(), "not an image"))


def upload(spark: SparkSession, path: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """images() of one upload; raises ValueError if it has more files than one may have."""
    found = images(spark, path, most_bytes)
    if found.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"{path} holds more than {most_files} files")
    return found


def labelled(spark: SparkSession, path: str, schema: str, domain: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of a JSON array; raises ValueError if there is none or a value lies outside its domain."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no rows")
    for column, values in (domain or {}).items():
        bad = rows.where(~F.col(column).isin(*values)).limit(1).collect()
        if bad:
            raise ValueError(f"{column}: {bad[0][column]!r} is not known")
    return rows


def job_stream(spark: SparkSession, path: str, schema: str = "job_type string, image_id long, queued_at timestamp", files_per_trigger: int = 10) -> DataFrame:
    """A stream of job messages, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def query(spark: SparkSession, text: str, **values) -> DataFrame:
    """A parameterised SQL query."""
    return spark.sql(text, args=values)
