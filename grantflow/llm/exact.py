"""Exact duplicates by a tree-merge of digest runs.

Each input partition becomes one run of (digest, smallest row).  Runs
are exchanged and merged, by aggregation on the digest, in rounds of ``FAN_IN`` neighbours (run ``r`` joins
run ``r >> FAN_IN_BITS``), every merge keeping the smallest row and the count
of a digest; after ``log(runs)`` rounds one run is left, and the winners go
back down the same tree.  A text that fills a third of all rows is one row per
run after the first level, at most ``FAN_IN`` rows of a key meet in any merge
or join above it, and below it the rows of one run.

Digests are checked on every level: rows merge only where SHA-256, byte
length and XXH64 of the normalised text all agree.

Defined cases: null text counts as empty; of rows that share text and smallest
id (repeated rows) exactly one is kept; null ids come after all others, and
``keep_id`` is null only where all ids of the group are; an empty table gives
an empty result; further columns are ignored.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grantflow.llm.store import staged

FAN_IN_BITS = 4
KEY = ["sha", "n_bytes", "xx"]


def normalised(text: Column) -> Column:
    """Null as empty, every run of blank characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest key, row number and run."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select(
        "id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("xx"), F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"))
    return staged(rows, "exact-runs")


def _joined(low: DataFrame, high: DataFrame, run: Column) -> DataFrame:
    on = (F.col("h.run") == run)
    for c in KEY:
        on = on & (F.col(f"l.{c}") == F.col(f"h.{c}"))
    return low.alias("l").join(high.alias("h"), on)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = digest_runs(docs, id_col, text_col)
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep")
    levels = [staged(rows.groupBy(*KEY, "run").agg(smallest, F.count(F.lit(1)).alias("n")), "exact-level0")]
    last = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    while last > 0:
        last >>= FAN_IN_BITS
        merged = levels[-1].groupBy(*KEY, F.shiftright("run", FAN_IN_BITS).alias("run")) \
            .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        levels.append(staged(merged, f"exact-level{len(levels)}"))
    won = levels.pop()
    while levels:
        low = levels.pop()
        won = _joined(low, won, F.shiftright("l.run", FAN_IN_BITS)) \
            .select(*[f"l.{c}" for c in KEY], "l.run", "h.keep", "h.n")
    return _joined(rows, won, F.col("l.run")).select(
        "l.id", F.col("h.keep.id").alias("keep_id"), F.col("h.n").alias("group_size"),
        (F.col("l.row") == F.col("h.keep.row")).alias("kept"),
        F.lower(F.hex("l.sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``.  Rows meet their
    decision on id and digest; of rows that repeat both, any one stays."""
    kept = duplicates(docs, id_col, text_col).where("kept").select("id", F.unhex("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                       F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    return (rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id"))
                                 & (F.col("r.sha") == F.col("k.sha")), "left_semi")
            .dropDuplicates(["id", "sha"]).select("row.*"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
