"""Grant-shaped frames derived from the driver tables, each with the
equivalent SQL (a CTE body) for the DuckDB oracle.

* ``landing_frame`` (G): orders ⋈ customer ⋈ nation rendered as a wide,
  all-string grant landing dataset with deterministic damage.
* ``run_files`` (L) / ``runs`` (R): events rendered as landed files and the
  fetch runs they belong to.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------- landing G

LANDING_COLUMNS = [
    "Research Project Title", "Project Title (English)", "Project/Area Number",
    "Project Period (FY)", "Principal Investigator", "Research Institution",
    "Total Cost (Overall)", "Keywords",
]


def landing_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: one landed grant row per order (all strings) + ``row_no``, ``source_id``.

    Damage, by order key: title missing (%5), period with a hyphen (%17),
    unpadded dates (%13), amount text ``TBD`` (%23); one-token names (%11 of
    customer keys).
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey))
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    end = F.date_add(start, 365)

    def fmt(d, pattern):
        return F.date_format(d, pattern)

    period = (
        F.when(k % 17 == 0, F.concat(fmt(start, "yyyy-MM-dd"), F.lit(" - "), fmt(end, "yyyy-MM-dd")))
        .when(k % 13 == 0, F.concat(fmt(start, "yyyy-M-d"), F.lit(" – "), fmt(end, "yyyy-M-d")))
        .otherwise(F.concat(fmt(start, "yyyy-MM-dd"), F.lit(" – "), fmt(end, "yyyy-MM-dd")))
    )
    person = F.when(F.col("c_custkey") % 11 == 0, F.replace("c_name", F.lit("#"), F.lit(""))) \
              .otherwise(F.replace("c_name", F.lit("#"), F.lit(" ")))
    amount = F.when(k % 23 == 0, F.lit("TBD")) \
              .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return j.select(
        k.alias("row_no"),
        F.concat(F.lit("mkt_"), F.lower("c_mktsegment")).alias("source_id"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat_ws(" ", "o_orderpriority", "c_mktsegment"))
         .alias("Research Project Title"),
        F.concat(F.col("c_mktsegment"), F.lit(" study")).alias("Project Title (English)"),
        k.cast("string").alias("Project/Area Number"),
        period.alias("Project Period (FY)"),
        person.alias("Principal Investigator"),
        F.col("n_name").alias("Research Institution"),
        amount.alias("Total Cost (Overall)"),
        F.col("o_orderstatus").alias("Keywords"),
    )


LANDING_SQL = """
    SELECT o.o_orderkey AS row_no,
           'mkt_' || lower(c.c_mktsegment) AS source_id,
           CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
                ELSE o.o_orderpriority || ' ' || c.c_mktsegment END AS "Research Project Title",
           c.c_mktsegment || ' study' AS "Project Title (English)",
           CAST(o.o_orderkey AS VARCHAR) AS "Project/Area Number",
           CASE WHEN o.o_orderkey % 17 = 0
                  THEN strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') || ' - '
                       || strftime(CAST(o.o_orderdate AS DATE) + 365, '%Y-%m-%d')
                WHEN o.o_orderkey % 13 = 0
                  THEN strftime(CAST(o.o_orderdate AS DATE), '%Y-%-m-%-d') || ' – '
                       || strftime(CAST(o.o_orderdate AS DATE) + 365, '%Y-%-m-%-d')
                ELSE strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') || ' – '
                     || strftime(CAST(o.o_orderdate AS DATE) + 365, '%Y-%m-%d')
           END AS "Project Period (FY)",
           CASE WHEN c.c_custkey % 11 = 0 THEN replace(c.c_name, '#', '')
                ELSE replace(c.c_name, '#', ' ') END AS "Principal Investigator",
           n.n_name AS "Research Institution",
           CASE WHEN o.o_orderkey % 23 = 0 THEN 'TBD'
                ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END
             AS "Total Cost (Overall)",
           o.o_orderstatus AS "Keywords"
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# Conformed G in SQL (both policies share everything but project_title).
def conformed_sql(policy: str = "first_column") -> str:
    title = ('"Research Project Title"' if policy == "first_column"
             else 'coalesce("Research Project Title", "Project Title (English)")')
    return f"""
    SELECT row_no, source_id,
           "Project/Area Number" AS grant_id,
           {title} AS project_title,
           "Keywords" AS project_description,
           CASE WHEN len(pp) = 2 THEN CAST(try_strptime(pp[1], '%Y-%m-%d') AS DATE) END AS start_date,
           CASE WHEN len(pp) = 2 THEN CAST(try_strptime(pp[2], '%Y-%m-%d') AS DATE) END AS end_date,
           TRY_CAST("Total Cost (Overall)" AS DECIMAL(20,2)) AS amount,
           "Research Institution" AS organization_name,
           CASE WHEN len(np) > 1 THEN np[1] END AS investigator_given_name,
           CASE WHEN len(np) > 1 THEN np[2] END AS investigator_family_name,
           pp, "Total Cost (Overall)" AS amount_raw
    FROM (SELECT *, string_split("Project Period (FY)", ' – ') AS pp,
                 string_split("Principal Investigator", ' ') AS np
          FROM ({LANDING_SQL}) g0) g1
"""


def quarantine_sql_expr() -> str:
    """SQL for the comma-joined quarantine reasons of a conformed row (cg)."""
    return """concat_ws(',',
        CASE WHEN len(pp) <> 2 THEN 'period_format' END,
        CASE WHEN len(pp) = 2 AND start_date IS NULL THEN 'start_date_invalid' END,
        CASE WHEN len(pp) = 2 AND end_date IS NULL THEN 'end_date_invalid' END,
        CASE WHEN amount_raw IS NOT NULL AND amount IS NULL THEN 'amount_invalid' END)"""


# ------------------------------------------------------------- runs L and R

def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: each event is a landed file of a daily run of (source_name, action)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source_name"),
        F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("action"),
        F.date_trunc("day", "ts").alias("run_ts"),
        F.col("ts").alias("downloaded_at"),
        F.floor(F.col("value") * 1048576).cast("bigint").alias("bytes"),
        (F.col("event_type") != "error").alias("ok"),
        "value",
    )


RUN_FILES_SQL = """
    SELECT event_id,
           'src_' || CAST(user_id AS VARCHAR) AS source_name,
           'a' || CAST(event_id % 3 AS VARCHAR) AS action,
           date_trunc('day', ts) AS run_ts,
           ts AS downloaded_at,
           CAST(floor(value * 1048576) AS BIGINT) AS bytes,
           event_type <> 'error' AS ok,
           value
    FROM events
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: one row per run (source_name, action, run_ts) with outcome and size."""
    f = run_files(spark, sf_dir)
    return (f.groupBy("source_name", "action", "run_ts")
             .agg(F.max("downloaded_at").alias("timestamp"),
                  F.count(F.lit(1)).alias("file_count"),
                  F.sum("bytes").alias("total_bytes"),
                  F.bool_or(~F.col("ok")).alias("any_failed"),
                  F.max("value").alias("max_value"))
             .select("source_name", "action", "run_ts",
                     F.concat_ws("-", "source_name", "action").alias("source_id"),
                     F.when(F.col("any_failed"), "failed")
                      .when(F.col("max_value") < 5, "skipped")
                      .otherwise("success").alias("status"),
                     "timestamp", "file_count", "total_bytes"))


RUNS_SQL = f"""
    SELECT source_name, action, run_ts, source_name || '-' || action AS source_id,
           CASE WHEN bool_or(NOT ok) THEN 'failed'
                WHEN max(value) < 5 THEN 'skipped'
                ELSE 'success' END AS status,
           max(downloaded_at) AS "timestamp",
           count(*) AS file_count,
           CAST(sum(bytes) AS BIGINT) AS total_bytes
    FROM ({RUN_FILES_SQL}) l
    GROUP BY source_name, action, run_ts
"""
