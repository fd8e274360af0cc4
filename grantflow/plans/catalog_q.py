"""Queries over source catalogs: ids, parser types, scan, last-wins, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.ids import clean_source_id, parser_type, source_id_by_funder, source_id_by_name
from grantflow.operators import catalog as CO
from grantflow.plans.frames import table
from grantflow.plans.registry import register
from grantflow.schema import NA_TOKENS, TRUTHY
from grantflow.session import scratch_dir
from grantflow.sources import catalog as SC

FORMATS = ["csv", "excel", "xlsx", "xls", "api", "html", "pdf"]


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows (all strings, reader header names) from supplier ⋈ nation."""
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows by definition
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    k = F.col("s_suppkey")
    fmt = F.get(F.array(*[F.lit(f) for f in FORMATS]), (k % len(FORMATS)).cast("int"))
    return j.select(
        k.alias("s_suppkey"),
        F.concat(F.lit("Fundació "), F.col("n_name")).alias("Funder"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Auxílios "), F.col("s_name"), F.lit(" ²"))).alias("Source_name"),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit("NA"))
         .otherwise(F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))).alias("Country"),
        F.when(k % 5 == 0, "Aggregator").otherwise("Funder").alias("Type"),
        F.concat(F.lit("https://data.example.org/"),
                 F.when(k % 11 == 0, "openaire/").otherwise(""),
                 k.cast("string"), F.lit("/dump")).alias("Link to dump"),
        fmt.alias("Format"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .when(k % 4 == 1, F.concat(F.lit("Ajuts "), k.cast("string")))
         .when(k % 4 == 2, F.concat(F.lit("call-"), k.cast("string")))
         .otherwise(F.lit("")).alias("Action"),
        F.when(k % 3 == 0, "Done").alias("Status"),
        F.when(k % 2 == 0, "n/a").otherwise("ok").alias("Notes"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("Yes").alias("Skip SSL Verify"),
    )


FORMATS_SQL = "[" + ", ".join(f"'{f}'" for f in FORMATS) + "]"
CATALOG_ROWS_SQL = f"""
    SELECT s_suppkey,
           'Fundació ' || n_name AS "Funder",
           CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE 'Auxílios ' || s_name || ' ²' END AS "Source_name",
           CASE WHEN s_nationkey % 5 = 0 THEN 'NA' ELSE 'C' || CAST(s_nationkey AS VARCHAR) END AS "Country",
           CASE WHEN s_suppkey % 5 = 0 THEN 'Aggregator' ELSE 'Funder' END AS "Type",
           'https://data.example.org/' || CASE WHEN s_suppkey % 11 = 0 THEN 'openaire/' ELSE '' END
             || CAST(s_suppkey AS VARCHAR) || '/dump' AS "Link to dump",
           {FORMATS_SQL}[s_suppkey % {len(FORMATS)} + 1] AS "Format",
           CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ajuts ' || CAST(s_suppkey AS VARCHAR)
                WHEN 2 THEN 'call-' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS "Action",
           CASE WHEN s_suppkey % 3 = 0 THEN 'Done' END AS "Status",
           CASE WHEN s_suppkey % 2 = 0 THEN 'n/a' ELSE 'ok' END AS "Notes",
           CASE s_suppkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'Yes' END AS "Skip SSL Verify"
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def clean_sql(x: str) -> str:
    return f"regexp_replace(replace(coalesce({x}, ''), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def under_sql(x: str) -> str:
    return f"replace(coalesce({x}, ''), ' ', '_')"


def parser_sql(fmt: str) -> str:
    f = f"lower(coalesce({fmt}, ''))"
    return (f"CASE WHEN {f} = 'csv' THEN 'standard_csv' WHEN {f} IN ('excel', 'xlsx', 'xls') THEN 'excel' "
            f"WHEN {f} = 'api' THEN 'api' WHEN {f} = 'html' THEN 'html' ELSE 'standard_csv' END")


@register("source_id_clean", f"""
    SELECT s_suppkey, {clean_sql('"Source_name"')} || '-' || {clean_sql('"Action"')} AS source_id
    FROM ({CATALOG_ROWS_SQL}) c
""")
def source_id_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog_rows(spark, sf_dir)
    return c.select("s_suppkey", source_id_by_name("Source_name", "Action").alias("source_id"))


RULE2_SQL = f"""CASE WHEN lower(coalesce("Type", '')) = 'aggregator' THEN {under_sql('"Source_name"')}
                     WHEN coalesce("Action", '') <> '' THEN {under_sql('"Funder"')} || '-' || {under_sql('"Action"')}
                     ELSE {under_sql('"Funder"')} END"""


@register("source_id_funder", f"""
    SELECT s_suppkey, {RULE2_SQL} AS source_id, {parser_sql('"Format"')} AS parser
    FROM ({CATALOG_ROWS_SQL}) c
""")
def source_id_funder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog_rows(spark, sf_dir)
    return c.select("s_suppkey",
                    source_id_by_funder("Funder", "Source_name", "Type", "Action").alias("source_id"),
                    parser_type("Format").alias("parser"))


def _na_sql(x: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"(CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END)"


def _scan_sql() -> str:
    sn, ac = _na_sql('"Source_name"'), _na_sql('"Action"')
    truthy = ", ".join(f"'{t}'" for t in TRUTHY)

    def out(x: str) -> str:
        return f"coalesce(nullif({x}, 'nan'), '')"
    return f"""
    SELECT {clean_sql(sn)} || '-' || {clean_sql(ac)} AS source_id,
           {out(_na_sql('"Funder"'))} AS funder, {out(ac)} AS action, {out(sn)} AS source_name,
           {out('"Country"')} AS country, {out(_na_sql('"Type"'))} AS type,
           {out(_na_sql('"Status"'))} AS status, '' AS web_link,
           {out(_na_sql('"Link to dump"'))} AS data_link,
           {out('lower(' + _na_sql('"Format"') + ')')} AS format, '' AS size,
           {out(_na_sql('"Notes"'))} AS notes,
           coalesce(lower({_na_sql('"Skip SSL Verify"')}) IN ({truthy}), false) AS skip_ssl_verify,
           {parser_sql(_na_sql('"Format"'))} AS parser
    FROM ({CATALOG_ROWS_SQL}) c
    WHERE {clean_sql(sn)} <> '' OR {clean_sql(ac)} <> ''
    """


CATALOG_HEADERS = ["Funder", "Source_name", "Country", "Type", "Link to dump", "Format",
                   "Action", "Status", "Notes", "Skip SSL Verify"]


def _write_catalog_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "catalog_csv")
    (catalog_rows(spark, sf_dir).select(*[F.col(f"`{c}`") for c in CATALOG_HEADERS])
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def scanned_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = SC.read_catalog(spark, _write_catalog_csv(spark, sf_dir))
    missing = SC.missing_required(raw.columns)
    if missing:
        raise ValueError(f"catalog is missing required columns: {', '.join(missing)}")
    return SC.output_strings(SC.catalog_from_rows(raw))


@register("catalog_scan", _scan_sql())
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_catalog(spark, sf_dir)


@register("catalog_publish", _scan_sql())
def catalog_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog written as the ``source_catalog`` table (parquet) and read back."""
    path = scratch_dir(spark, "source_catalog")
    scanned_catalog(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("catalog_last_wins", """
    SELECT 'src_' || CAST(user_id AS VARCHAR) AS source_id,
           arg_max(event_type, event_id) AS funder, arg_max(value, event_id) AS value
    FROM events GROUP BY user_id
""")
def catalog_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("funder"), "value", F.col("event_id").alias("__ord"))
    return SC.last_wins(e)


REQUIRED_TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


@register("catalog_required", f"""
    SELECT user_id, day, array_to_string(m, ',') AS missing, CAST(len(m) AS INTEGER) AS n_missing
    FROM (SELECT user_id, day, list_filter({REQUIRED_TYPES!r}, lambda x: NOT list_contains(p, x)) AS m
          FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS p
                FROM events GROUP BY 1, 2) a) b
""")
def catalog_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    present = e.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("present"))
    m = SC.missing_required_col(F.col("present"), REQUIRED_TYPES)
    return present.select("user_id", "day", F.array_join(m, ",").alias("missing"),
                          F.size(m).alias("n_missing"))


LINK_SQL = ("CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN NULL "
            "ELSE 'https://data.example.org/' || CAST(user_id AS VARCHAR) || '/' || event_type END")


def _link() -> Column:
    return (F.when((F.col("event_type") == "error") | (F.col("user_id") % 10 == 0),
                   F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("https://data.example.org/"), F.col("user_id").cast("string"),
                                F.lit("/"), F.col("event_type"))))


@register("action_expand", f"""
    WITH pairs AS (SELECT DISTINCT user_id, event_type AS name, {LINK_SQL} AS link FROM events),
    valid AS (SELECT user_id, name AS action_name, link AS action_link FROM pairs
              WHERE name <> '' AND link IS NOT NULL)
    SELECT * FROM valid
    UNION ALL
    SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE '' END,
           'https://data.example.org/' || CAST(user_id AS VARCHAR)
    FROM events WHERE user_id NOT IN (SELECT user_id FROM valid)
""")
def action_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pairs = e.select("user_id", F.struct(F.col("event_type").alias("name"),
                                         _link().alias("data_link")).alias("a")).distinct()
    per_user = pairs.groupBy("user_id").agg(F.collect_list("a").alias("actions")).select(
        "user_id", "actions",
        F.when(F.col("user_id") % 2 == 0, "main").otherwise("").alias("single_action"),
        F.concat(F.lit("https://data.example.org/"), F.col("user_id").cast("string")).alias("data_link"))
    return CO.expand_actions(per_user, "actions", "single_action", "data_link").select(
        "user_id", "action_name", "action_link")


FUNDER_SQL = "'Fundació ' || CAST(user_id % 12 AS VARCHAR)"


@register("funder_actions", f"""
    SELECT DISTINCT replace({FUNDER_SQL}, ' ', '_') AS funder_key, event_type AS name,
           'https://data.example.org/f' || CAST(user_id % 12 AS VARCHAR) || '/' || event_type AS data_link
    FROM events
""")
def funder_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("Fundació "), (F.col("user_id") % 12).cast("string")).alias("funder"),
        "event_type",
        F.concat(F.lit("https://data.example.org/f"), (F.col("user_id") % 12).cast("string"),
                 F.lit("/"), F.col("event_type")).alias("link"))
    return CO.group_actions(e, "funder", "event_type", "link")


def _settings_sql() -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        return "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in CO.PARSER_SETTINGS)
    return (f"(SELECT * FROM (VALUES {rows}) AS t(parser, encoding, delimiter, quotechar, "
            f"date_format, sheet_name, pagination, rate_limit, wait_time))")


@register("parser_join", f"""
    SELECT s_suppkey, c.parser, encoding, delimiter, CAST(sheet_name AS INTEGER) AS sheet_name,
           pagination, CAST(rate_limit AS INTEGER) AS rate_limit, CAST(wait_time AS INTEGER) AS wait_time
    FROM (SELECT s_suppkey, {parser_sql('"Format"')} AS parser FROM ({CATALOG_ROWS_SQL}) r) c
    LEFT JOIN {_settings_sql()} p ON c.parser = p.parser
""")
def parser_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog_rows(spark, sf_dir).select("s_suppkey", parser_type("Format").alias("parser"))
    j = CO.with_parser_settings(spark, c)
    return j.select("s_suppkey", "parser", "encoding", "delimiter", "sheet_name", "pagination",
                    "rate_limit", "wait_time")


DOC_FORMATS = ["csv", "excel", "xlsx", "api", "html", "pdf"]


@register("format_dispatch", f"""
    SELECT doc_id, route, CASE WHEN route = 'unsupported' THEN 'failed' ELSE 'queued' END AS status
    FROM (SELECT doc_id,
                 CASE WHEN fmt IN ('csv', 'excel', 'xlsx', 'xls') THEN 'file'
                      WHEN fmt = 'api' AND (lower(sid) LIKE '%openaire%' OR lower(url) LIKE '%openaire%') THEN 'project_api'
                      WHEN fmt = 'api' THEN 'api' WHEN fmt = 'html' THEN 'html'
                      ELSE 'unsupported' END AS route
          FROM (SELECT doc_id, {DOC_FORMATS!r}[doc_id % 6 + 1] AS fmt,
                       source || '-' || CAST(doc_id AS VARCHAR) AS sid,
                       CASE WHEN doc_id % 5 = 0 THEN 'https://api.OpenAIRE.eu/projects/' ELSE 'https://api.example.org/' END
                         || CAST(doc_id AS VARCHAR) AS url
                FROM documents) a) b
""")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    fmt = F.get(F.array(*[F.lit(f) for f in DOC_FORMATS]), (F.col("doc_id") % 6).cast("int"))
    sid = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    url = F.concat(F.when(F.col("doc_id") % 5 == 0, "https://api.OpenAIRE.eu/projects/")
                   .otherwise("https://api.example.org/"), F.col("doc_id").cast("string"))
    route = CO.dispatch(fmt, sid, url)
    return d.select("doc_id", route.alias("route"),
                    F.when(route == "unsupported", "failed").otherwise("queued").alias("status"))


__all__ = ["catalog_rows", "clean_source_id"]
