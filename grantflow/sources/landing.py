"""Raw landing zone: ``root/source_name=/action=/run_ts=/files``.

Landing is a partitioned append; "latest run" and "which file to read"
are queries over a file listing (``binaryFile`` without its content
column, so no file body is read), not pointers kept on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.ids import run_label
from grantflow.operators.runs import latest_per_key

PARTITIONS = ["source_name", "action", "run_ts"]

# File kinds in order of preference within a run (lower wins).
EXT_RANK = {"csv": 0, "xlsx": 1, "xls": 1, "json": 2}


def land(df: DataFrame, root: str, fmt: str = "json", **options) -> None:
    """Append rows under their (source_name, action, run_ts) folder.

    ``run_ts`` should already be the run label (``YYYYmmdd_HHMMSS``).
    """
    w = df.write.mode("append").partitionBy(*PARTITIONS)
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(root)


def with_run_label(df: DataFrame, ts: str = "run_ts") -> DataFrame:
    return df.withColumn(ts, run_label(ts))


def list_landed(spark: SparkSession, root: str) -> DataFrame:
    """One row per landed file: path, size, partition values, extension."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))

    def part(name: str) -> Column:
        return F.nullif(F.regexp_extract("path", f"/{name}=([^/]+)/", 1), F.lit(""))

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path", F.col("length").alias("bytes"),
        part("source_name").alias("source_name"), part("action").alias("action"),
        part("run_ts").alias("run_ts"), name.alias("file_name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"),
    )


def latest_run_files(listing: DataFrame) -> DataFrame:
    """Files of the newest run per (source_name, action).

    Dot-names and a literal ``latest`` folder never count as runs.
    """
    runs = (listing.filter(F.col("run_ts").isNotNull() & (F.col("run_ts") != "latest")
                           & ~F.col("run_ts").startswith("."))
            .select("source_name", "action", "run_ts").distinct())
    newest = latest_per_key(runs, ["source_name", "action"], ["run_ts"])
    return listing.join(newest, ["source_name", "action", "run_ts"], "left_semi")


def pick_files(listing: DataFrame) -> DataFrame:
    """Within each run keep the preferred kind: CSV, else Excel, else JSON
    (``metadata.json`` is never data).  Other files are ignored."""
    rank = F.create_map(*[x for k, v in EXT_RANK.items() for x in (F.lit(k), F.lit(v))])
    ranked = (listing.filter(F.col("file_name") != "metadata.json")
              .withColumn("__rank", F.element_at(rank, F.col("ext")))
              .filter(F.col("__rank").isNotNull()))
    best = ranked.groupBy(*PARTITIONS).agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [*PARTITIONS, "__rank"], "left_semi").drop("__rank")
