"""What the two classifiers share: the fold of a row and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from grantflow.llm.store import staged

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(id as text) mod 4 is 2; they teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (column ``id``) of every label, by hash of
    the id.  Each label is thinned to little more than that number by a hash
    threshold first, so the window that takes the rest sees bounded groups.
    Both small tables are staged: Spark knows their size when it joins them."""
    total = staged(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.join(total, label).where(part < 1.2 * per_label / F.col("n"))
    order = W.partitionBy(label).orderBy(F.xxhash64("id"), "id")
    return staged(thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).drop("r", "n"),
                  "label-sample")
