"""Session helpers: a local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings every job here assumes.

    On a cluster the session comes from the platform; only the SQL settings
    (UTC, AQE, skew join) matter and are set idempotently by
    :func:`configure`.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("grantflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings: UTC, AQE with partition coalescing and skew split."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@functools.lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="grantflow-ckpt-")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a ``local[n]`` session (tests, bench) that does not name one gets a
    temporary folder; a cluster without it is an error, since files in a
    machine-local folder are missed by other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _test_folder()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """The name of a new folder under the shared root; writers create it."""
    return f"{checkpoint_root(spark).rstrip('/')}/grantflow/{name}-{uuid.uuid4().hex[:12]}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Let the file system remove ``path`` when the driver ends: what is staged
    is of no use to another run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared root and read it back:
    computed once, columns still pruned, nothing to recompute after a loss.
    The folder goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
