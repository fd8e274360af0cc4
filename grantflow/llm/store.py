"""Tables in, staged tables and files in the shared folder.

Every staged table lives below ``spark.checkpoint.dir``, which the driver and
all executors of a cluster share.  A session without that setting (unit
tests on ``local[n]``) gets one temporary folder per process; a session on a
real cluster without it is refused, since a machine-local folder would lose
rows silently.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from grantflow.session import until_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _test_root() -> str:
    return tempfile.mkdtemp(prefix="grantflow-llm-")


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _test_root()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and
    values such as ``spark_partition_id()`` are fixed from here on.  The folder
    goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(url: str):
    """``(filesystem, path)`` of a shared-folder URL, for tasks that read or
    write files that are not tables (archives, token shards)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(url if "://" in url else f"file://{url.removeprefix('file:')}")
