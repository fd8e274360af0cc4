"""Incremental landing ingest with Structured Streaming.

New landed files are picked up by a file-source stream; each micro-batch is
read, conformed, validated and written to two tables under its batch id: rows
without quarantine reasons to ``grants``, the others, with what could not be
read at all, to ``quarantine``.  ``foreachBatch`` is at-least-once, so both
writes use dynamic partition overwrite of ``batch_id`` and a replayed batch
overwrites exactly what it wrote before.  The batch's row in ``ingest_runs``
comes last: :func:`committed` shows the rows of batches that have one, so both
tables change together.  The stream's checkpoint (in the shared checkpoint
folder) replaces per-source "last download" markers: it records which files
were already ingested.

Formats: ``parquet`` rows come as they are; ``json`` lines and ``csv`` files
are read tolerantly, file layouts may differ, and a line that is no JSON or a
record longer than its header is quarantined with its whole text.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantflow.operators.conform import conform
from grantflow.operators.quality import validate
from grantflow.operators.serve import PARTITION_COL, publish_grants
from grantflow.sources.csv_tolerant import OVERFLOW, read_tolerant_csv

Transform = Callable[[DataFrame], DataFrame]
#: Text of a landed record that could not be read.
UNREAD = "__unread"
LISTING = "path string, modificationTime timestamp, length long, content binary"
REASONS = "quarantine_reasons"


def default_transform(batch: DataFrame) -> DataFrame:
    """Conform the prototype layout, validate, keep lineage ``source_id``."""
    return validate(conform(batch, keep=["source_id"]))


def read_csv_files(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Files with headers of their own -> the columns of ``schema`` (all
    strings; what a file lacks is null) and the text of over-long records."""
    rows = read_tolerant_csv(spark, files)
    return rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n)
                         for n in schema.names], F.col(OVERFLOW).alias(UNREAD))


def read_json_files(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Lines of JSON objects -> the columns of ``schema`` and the text of
    lines that are none."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(UNREAD, T.StringType())])) \
        .option("columnNameOfCorruptRecord", UNREAD).option("mode", "PERMISSIVE").json(files)


READERS = {"csv": read_csv_files, "json": read_json_files}


def ingest_landing(spark: SparkSession, landing: str, schema: T.StructType, out: str, checkpoint: str, runs_table: str,
                   transform: Transform = default_transform, files_per_trigger: int | None = None,
                   fmt: str = "parquet", quarantine: str | None = None, pattern: str | None = None) -> None:
    """Process every landed file not yet ingested, then stop (AvailableNow).

    ``quarantine`` defaults to a table beside ``out``, ``pattern`` (of the file
    names of a tolerant format) to its extension.  ``files_per_trigger`` bounds
    the list of files a batch of a tolerant format hands to its reader.
    """
    quarantine = quarantine or beside(out)
    tolerant = fmt in READERS
    reader = spark.readStream.schema(LISTING if tolerant else schema).format("binaryFile" if tolerant else fmt)
    if files_per_trigger or tolerant:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger or 1000)
    if tolerant:
        reader = reader.option("pathGlobFilter", pattern or f"*.{fmt}").option("recursiveFileLookup", "true")
    stream = reader.load(landing)

    def read(batch: DataFrame) -> DataFrame:
        if not tolerant:
            return batch.withColumn(UNREAD, F.lit(None).cast("string"))
        files = [r.path for r in batch.select("path").collect()]       # at most files_per_trigger; no content is read
        return READERS[fmt](spark, files, T.StructType(schema.fields))

    def publish(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = read(batch).persist()
        unread = F.col(UNREAD).isNotNull()
        result = transform(rows.where(~unread).drop(UNREAD)).withColumn("batch_id", F.lit(batch_id)) \
            .withColumn("record", F.lit(None).cast("string")).persist()
        lost = rows.where(unread).select(
            F.coalesce("source_id", F.lit("")).alias(PARTITION_COL), F.array(F.lit("unreadable")).alias(REASONS),
            F.col(UNREAD).alias("record"), F.lit(batch_id).alias("batch_id"))
        good, bad = F.size(REASONS) == 0, F.size(REASONS) > 0
        publish_grants(result.where(good).drop("record"), out, partitions=("batch_id", PARTITION_COL))
        publish_grants(result.where(bad).unionByName(lost, allowMissingColumns=True), quarantine,
                       partitions=("batch_id", PARTITION_COL))
        # Counted by partition values alone: no column of the tables is read back.
        counts = [spark.read.schema(s.schema).parquet(p).where(F.col("batch_id") == batch_id)
                  .groupBy(PARTITION_COL, "batch_id").agg(F.count(F.lit(1)).alias(n))
                  for s, p, n in ((result.drop("record"), out, "n_published"), (result, quarantine, "n_quarantined"))]
        n = {c: F.coalesce(c, F.lit(0)) for c in ("n_published", "n_quarantined")}
        stats = counts[0].join(counts[1], [PARTITION_COL, "batch_id"], "full").select(
            PARTITION_COL, "batch_id", (n["n_published"] + n["n_quarantined"]).alias("n_rows"),
            n["n_quarantined"].alias("n_quarantined"), F.current_timestamp().alias("ingested_at"))
        (stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(runs_table))
        result.unpersist()
        rows.unpersist()

    q = (stream.writeStream.foreachBatch(publish)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def committed(spark: SparkSession, table: str, runs_table: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of ``table`` whose batch is complete in both tables; a table without
    a row needs its ``schema``."""
    done = spark.read.parquet(runs_table).select("batch_id").distinct()
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(table).join(done, "batch_id", "left_semi")


def beside(out: str) -> str:
    return os.path.join(os.path.dirname(out.rstrip("/")), "quarantine")


def paths(root: str) -> dict[str, str]:
    return {k: os.path.join(root, k) for k in ("landing", "grants", "quarantine", "checkpoint", "ingest_runs")}
