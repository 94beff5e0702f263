"""A corpus from raw documents to token records, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and hands the written table to the next one.  All but the last return the columns of documents.

Every stage takes null and empty texts, repeated rows, an empty table and further columns, whatever their
names, and processes long texts whole; what it does with them stands in the docstring of its operator.
"""

from __future__ import annotations

import gc
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import decontam, jaccard, mixing, nbsvm, records
from lumenlake.llm._store import materialize, recorded, set_aside, trim


def _stage(f):
    """The stage f, which first drops what the stages before it wrote on their way and gives back the memory that they
    freed on the driver; their results, which are the input of this one, stay."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gc.collect()
        trim()
        with recorded(spark):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labelled ones among them, does not reject."""
    model = nbsvm.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, restored = set_aside(docs, "doc_id", "text")
    return nbsvm.score(docs, model).where("predicted = 1").select(*restored)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike by 0.8 or more."""
    return jaccard.dedupe(docs, k=5, num=8, den=10)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of the benchmark."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


@_stage
def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token records hold, read back."""
    import public_tokenizers

    return records.encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token records", token_records),
]

#: No stage of these can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
