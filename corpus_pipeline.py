"""A corpus from raw documents to packed training windows.

Five stages, each one operator over all that the stage before kept; every
stage's rows are written to the shared folder and read back, so that no later
stage depends on an executor that held an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantflow.llm import exact, langid, mixing, packing, simhash
from grantflow.llm.store import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without any letter go."""
    told = langid.identify(docs, carry=True)
    return told.where(told["lang_pred"] != langid.UNKNOWN).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest id stays."""
    return simhash.one_of_each(docs, width=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target; a document taken n times has n rows."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs, "byte_bpe_50k.json", end_id=1).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates),
          ("mix", mix), ("pack", pack)]

#: A trained network, 64-bit XXH64 fingerprints and tokens have no SQL form;
#: tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
