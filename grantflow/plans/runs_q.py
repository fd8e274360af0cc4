"""Queries over fetch runs: latest run, freshness, outcomes, status report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.dates import as_of_literal, display_ts, parse_ts
from grantflow.functions.ids import run_label
from grantflow.operators import runs as R
from grantflow.plans.frames import AS_OF, RUN_FILES_SQL, RUNS_SQL, run_files, runs, table
from grantflow.plans.registry import register
from grantflow.session import scratch_dir
from grantflow.sources.landing import list_landed

FRESH_DAYS = 2.0
AGE_SQL = f"(date_diff('microsecond', {{ts}}, TIMESTAMP '{AS_OF}') / 86400000000.0)"

LATEST_SQL = f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY source_name, action ORDER BY run_ts DESC) AS rn
      FROM ({RUNS_SQL}) r) x WHERE rn = 1
"""


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_per_key(runs(spark, sf_dir), ["source_name", "action"], ["run_ts"])


@register("latest_run", f"""
    SELECT source_name, action, strftime(run_ts, '%Y%m%d_%H%M%S') AS run_label,
           status, file_count, total_bytes
    FROM ({LATEST_SQL}) l
""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_runs(spark, sf_dir).select(
        "source_name", "action", run_label("run_ts").alias("run_label"),
        "status", "file_count", "total_bytes")


DOWNLOADS_SQL = f"""
    SELECT source_name, action, max("timestamp") FILTER (WHERE status = 'success') AS "timestamp"
    FROM ({RUNS_SQL}) r GROUP BY source_name, action
"""


@register("freshness", f"""
    SELECT source_name, action, round({AGE_SQL.format(ts='"timestamp"')}, 1) AS age_days,
           coalesce({AGE_SQL.format(ts='"timestamp"')} <= {FRESH_DAYS}, false) AS fresh
    FROM ({DOWNLOADS_SQL}) l
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the last successful run; without one a source is never fresh."""
    r = runs(spark, sf_dir)
    latest = R.latest_per_key(R.successful(r).select("source_name", "action", "timestamp"),
                              ["source_name", "action"], ["timestamp"])
    known = r.select("source_name", "action").distinct().join(latest, ["source_name", "action"], "left")
    return R.with_freshness(known, "timestamp", as_of_literal(AS_OF), FRESH_DAYS) \
            .select("source_name", "action", "age_days", "fresh")


@register("fetch_summary", f"""
    SELECT CAST(count_if(status = 'success') AS BIGINT) AS n_success,
           CAST(count_if(status = 'skipped') AS BIGINT) AS n_skipped,
           CAST(count_if(status = 'failed') AS BIGINT) AS n_failed,
           count(*) AS n_total
    FROM ({RUNS_SQL}) r
""")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_counts(runs(spark, sf_dir))


@register("fetch_outcomes", f"""
    SELECT DISTINCT status AS outcome, source_name || '_' || action AS id FROM ({LATEST_SQL}) l
""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_runs(spark, sf_dir).withColumn(
        "run_key", F.concat_ws("_", "source_name", "action"))
    return R.outcome_rows(latest, "run_key")


REQUESTED_SQL = "SELECT 'src_' || CAST(c_custkey AS VARCHAR) AS source_name FROM customer"


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src_"), F.col("c_custkey").cast("string")).alias("source_name"))


@register("select_sources", f"""
    SELECT source_name FROM ({REQUESTED_SQL}) q
    WHERE source_name IN (SELECT source_name FROM ({RUN_FILES_SQL}) l)
""")
def select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = R.select_known(_requested(spark, sf_dir), run_files(spark, sf_dir), "source_name")
    return found


@register("unknown_sources", f"""
    SELECT source_name FROM ({REQUESTED_SQL}) q
    WHERE source_name NOT IN (SELECT source_name FROM ({RUN_FILES_SQL}) l)
""")
def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unknown = R.select_known(_requested(spark, sf_dir), run_files(spark, sf_dir), "source_name")
    return unknown


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src_"), F.col("c_custkey").cast("string")).alias("source_id"),
        F.explode(F.array(F.lit("a0"), F.lit("a1"), F.lit("a2"))).alias("action"),
        F.col("c_name").alias("funder"), F.lower("c_mktsegment").alias("format"))


def status_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_status(_catalog(spark, sf_dir), runs(spark, sf_dir), as_of_literal(AS_OF))


STATUS_SQL = f"""
    WITH r AS ({RUNS_SQL}),
    last AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY source_name, action ORDER BY "timestamp" DESC, run_ts DESC) AS rn
        FROM r WHERE status = 'success') x WHERE rn = 1),
    cat AS (SELECT 'src_' || CAST(c_custkey AS VARCHAR) AS source_id, a.action, c_name AS funder,
                   lower(c_mktsegment) AS format FROM customer, (VALUES ('a0'), ('a1'), ('a2')) a(action))
    SELECT cat.source_id, cat.action, funder, format,
           last.source_name IS NOT NULL AS downloaded,
           strftime(last."timestamp", '%Y-%m-%d %H:%M:%S') AS last_download,
           round({AGE_SQL.format(ts='last."timestamp"')}, 1) AS age_days,
           CASE WHEN last.source_name IS NOT NULL THEN 'raw/' || last.source_name || '/'
                || last.action || '/' || strftime(last.run_ts, '%Y%m%d_%H%M%S') END AS download_path,
           coalesce(last.file_count, 0) AS file_count,
           coalesce(round(last.total_bytes / 1048576.0, 2), 0.0) AS size_mb
    FROM cat LEFT JOIN last ON cat.source_id = last.source_name AND cat.action = last.action
"""


@register("source_status", STATUS_SQL)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sort_status(status_frame(spark, sf_dir))


#: Landed lines of a run and the folder each lies in, one file per folder.
LANDED_SQL = """
    SELECT 'src_' || CAST(user_id % 7 AS VARCHAR) AS source_name, 'a' || CAST(event_id % 2 AS VARCHAR) AS action,
           date_trunc('week', ts) AS run_ts, event_type AS part, ts,
           event_id || '|' || user_id || '|' || props AS line
    FROM events
"""


@register("landed_status", f"""
    WITH l AS ({LANDED_SQL}),
    r AS (SELECT source_name, action, run_ts, max(ts) AS "timestamp", count(DISTINCT part) AS file_count,
                 sum(strlen(line) + 1) AS total_bytes,
                 CASE WHEN count(*) % 4 = 0 THEN 'failed' ELSE 'success' END AS status
          FROM l GROUP BY 1, 2, 3),
    last AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY source_name, action ORDER BY "timestamp" DESC, run_ts DESC) AS rn
        FROM r WHERE status = 'success') x WHERE rn = 1),
    cat AS (SELECT 'src_' || CAST(n_nationkey AS VARCHAR) AS source_id, a.action, n_name AS funder
            FROM nation, (VALUES ('a0'), ('a1')) a(action))
    SELECT cat.source_id, cat.action, funder, 'text' AS format, last.source_name IS NOT NULL AS downloaded,
           strftime(last."timestamp", '%Y-%m-%d %H:%M:%S') AS last_download,
           round({AGE_SQL.format(ts='last."timestamp"')}, 1) AS age_days,
           CASE WHEN last.source_name IS NOT NULL THEN 'raw/' || last.source_name || '/'
                || last.action || '/' || strftime(last.run_ts, '%Y%m%d_%H%M%S') END AS download_path,
           coalesce(last.file_count, 0) AS file_count,
           coalesce(round(last.total_bytes / 1048576.0, 2), 0.0) AS size_mb
    FROM cat LEFT JOIN last ON cat.source_id = last.source_name AND cat.action = last.action
""")
def landed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status report with counts and sizes of the files that lie in the
    folder of each source's last run."""
    root, keys = scratch_dir(spark, "landed"), ["source_name", "action", "run_ts"]
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src_"), (F.col("user_id") % 7).cast("string")).alias("source_name"),
        F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")).alias("action"),
        F.date_trunc("week", "ts").alias("run_ts"), F.col("event_type").alias("part"), "ts",
        F.concat_ws("|", "event_id", "user_id", "props").alias("line"))
    landed = e.withColumn("run_ts", run_label("run_ts")).select(*keys, "part", "line")
    landed.repartition(*keys, "part").write.partitionBy(*keys, "part").text(root)
    r = e.groupBy(*keys).agg(F.max("ts").alias("timestamp"),
                             F.when(F.count(F.lit(1)) % 4 == 0, "failed").otherwise("success").alias("status"))
    catalog = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src_"), F.col("n_nationkey").cast("string")).alias("source_id"),
        F.explode(F.array(F.lit("a0"), F.lit("a1"))).alias("action"), F.col("n_name").alias("funder"),
        F.lit("text").alias("format"))
    return R.source_status(catalog, R.with_landed_sizes(r, list_landed(spark, root)), as_of_literal(AS_OF))


@register("status_totals", f"""
    SELECT CAST(count_if(downloaded) AS BIGINT) AS n_downloaded, count(*) AS n_sources,
           round(sum(size_mb), 2) AS total_size_mb
    FROM ({STATUS_SQL}) s
""")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_totals(status_frame(spark, sf_dir))


@register("status_display", f"""
    SELECT source_id AS "Source ID", action AS "Action", funder AS "Funder", format AS "Format",
           downloaded AS "Downloaded", last_download AS "Last Download",
           age_days AS "Age (days)", file_count AS "Files", size_mb AS "Size (MB)"
    FROM ({STATUS_SQL}) s
""")
def status_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_display(R.sort_status(status_frame(spark, sf_dir)))


@register("status_json", f"""
    SELECT CAST(json_object('source_id', source_id, 'action', action, 'funder', funder, 'format', format,
                            'downloaded', downloaded, 'last_download', last_download,
                            'age_days', age_days, 'download_path', download_path,
                            'file_count', file_count, 'size_mb', size_mb) AS VARCHAR) AS json
    FROM ({STATUS_SQL}) s
""")
def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_json(status_frame(spark, sf_dir))


@register("run_extras", f"""
    SELECT event_id, source_name || '_' || action AS run_key,
           strftime(run_ts, '%Y%m%d_%H%M%S') AS run_label,
           CASE WHEN ok THEN 'success' ELSE 'Downloaded' END AS status,
           json_extract_string(props, '$.k') AS k,
           CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS type,
           source_name, strftime(downloaded_at, '%Y-%m-%d %H:%M:%S') AS "timestamp",
           CAST(8 + len(list_filter(json_keys(props), lambda x: x NOT IN
                ('source_id', 'funder', 'source_name', 'country', 'type', 'status', 'format', 'timestamp')))
                AS BIGINT) AS n_keys
    FROM (SELECT l.*, e.props, e.event_type FROM ({RUN_FILES_SQL}) l JOIN events e USING (event_id)) x
""")
def run_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base fields of every load, with the load's own fields over them."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.nullif("event_type", F.lit("error")).alias("type"))
    files = run_files(spark, sf_dir).join(e, "event_id").select(
        "event_id", "source_name", "action", "run_ts", "props", "type",
        F.when(F.col("ok"), "success").alias("status"), display_ts("downloaded_at").alias("timestamp"))
    x = F.col("extra")
    return R.run_metadata(files, "props", keep=["event_id"]).select(
        "event_id", "run_key", "run_label", x["status"].alias("status"), x["k"].alias("k"),
        x["type"].alias("type"), x["source_name"].alias("source_name"), x["timestamp"].alias("timestamp"),
        F.size("extra").cast("bigint").alias("n_keys"))


@register("last_download", f"""
    SELECT source_name, action, status,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS last_download,
           strftime(run_ts, '%Y%m%d_%H%M%S') AS run_label
    FROM (SELECT *, row_number() OVER (PARTITION BY source_name, action
                                       ORDER BY "timestamp" DESC) AS rn
          FROM ({RUNS_SQL}) r WHERE status = 'success') x WHERE rn = 1
""")
def last_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended to an ``ingest_runs`` table in two loads (timestamps as
    ISO text, as run metadata stores them), read back, latest per key."""
    path = scratch_dir(spark, "ingest_runs")
    r = runs(spark, sf_dir).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    r.filter(F.col("run_ts") < cut).write.mode("append").parquet(path)
    r.filter(F.col("run_ts") >= cut).write.mode("append").parquet(path)
    landed = spark.read.parquet(path).withColumn("timestamp", parse_ts("timestamp"))
    latest = R.latest_per_key(R.successful(landed).select("source_name", "action", "timestamp", "status", "run_ts"),
                              ["source_name", "action"], ["timestamp"])
    return latest.select("source_name", "action", "status",
                         display_ts("timestamp").alias("last_download"),
                         run_label("run_ts").alias("run_label"))
