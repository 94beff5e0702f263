"""The opN_ queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, divergence, interactions, jaccard, licences, mixing, nbsvm, records, rules, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, _table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.flagged(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).select("doc_id", "sentence_ids", "n_sentences", "licences", "n_licences", "unknown")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return records.encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.table_turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), order="turn")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(chat.PROBE).alias("record"))
    return chat.format_and_read(turns.unionByName(chat.json_turns(probe)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": decontam.oracle(),
        "op6_licence_sentences": licences.oracle(),
        "op10_warc_archive": warc.oracle(),
        "op11_source_divergence": divergence.oracle(),
        "op12_filter_interactions": interactions.oracle(),
        "op13_chat_formatting": chat.oracle(),
    }
