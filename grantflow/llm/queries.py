"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grantflow.llm import (ann, exact, filter_audit, langid, merkle, mixing, packing, repair, repeats, simhash,
                           token_counts, toxicity, warc)
from grantflow.llm.store import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.prefix_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", budget=512)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > 512).alias("over_limit"), "fit_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return out.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, index = warc.normalise(spark, warc.write_monolithic(spark, pages))
    kind = pages.schema["page_id"].dataType
    return warc.read_records(folder, index).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, manifest = repair.write_shards(docs, "word_bpe_49k.json", end_id=1)
    return repair.read_shards(folder, manifest, docs.schema["doc_id"].dataType.simpleString()) \
        .withColumnRenamed("id", "doc_id")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=1)
    return out.withColumnRenamed("id", "doc_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_of_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"), width=400)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                      F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_repair_shards": op6_repair_shards,
    "op7_nearest": op7_nearest,
    "op8_language": op8_language,
    "op9_pack_windows": op9_pack_windows,
    "op10_mix_sources": op10_mix_sources,
    "op11_merkle": op11_merkle,
    "op12_repeats": op12_repeats,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE_SQL,
    "op4_exact_dedup": exact.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
