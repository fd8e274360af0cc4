"""Queries over sources and sinks: JSON shapes, project-API pages, landing,
tolerant CSV, round-trips, incremental ingest.

Files are written under the session's shared checkpoint folder (a fresh
sub-folder per run) and read back with this package's readers.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.ids import raw_path, run_label
from grantflow.operators.runs import LoadCounts
from grantflow.plans.frames import LANDING_SQL, landing_frame, table
from grantflow.plans.grants_q import CONFORMED_OUT, _conformed_out_sql
from grantflow.plans.registry import register
from grantflow.plans.report import portable
from grantflow.session import scratch_dir, staged
from grantflow.sources import csv_tolerant as CT
from grantflow.sources import json_shapes as J
from grantflow.sources import landing as L
from grantflow.streaming.ingest import committed, default_transform, ingest_landing, paths

# --------------------------------------------------------------- API pages

def _api_body() -> Column:
    e, p = F.col("event_id"), F.col("props")
    return (F.when(e % 9 == 0, F.concat(F.lit('{"data": [], "results": ['), p, F.lit("]}")))
            .when(e % 4 == 0, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]")))
            .when(e % 4 == 1, F.concat(F.lit('{"data": ['), p, F.lit('], "next": "page2"}')))
            .when(e % 4 == 2, F.concat(F.lit('{"results": ['), p, F.lit('], "has_more": false}')))
            .otherwise(p))


API_BODY_SQL = """CASE WHEN event_id % 9 = 0 THEN '{"data": [], "results": [' || props || ']}'
                       WHEN event_id % 4 = 0 THEN '[' || props || ', ' || props || ']'
                       WHEN event_id % 4 = 1 THEN '{"data": [' || props || '], "next": "page2"}'
                       WHEN event_id % 4 = 2 THEN '{"results": [' || props || '], "has_more": false}'
                       ELSE props END"""

FALSY_SQL = "('null', 'false', '0', '0.0', '\"\"', '[]', '{}', '')"


@register("json_unwrap", f"""
    SELECT event_id, CAST(pos - 1 AS INTEGER) AS pos, rec->>'k' AS k, has_more
    FROM (SELECT event_id, has_more, unnest(recs) AS rec, generate_subscripts(recs, 1) AS pos
          FROM (SELECT event_id,
                       CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]')
                            WHEN json_type(b -> 'data') = 'ARRAY' THEN json_extract(b, '$.data[*]')
                            WHEN json_type(b -> 'results') = 'ARRAY' THEN json_extract(b, '$.results[*]')
                            WHEN json_type(b) = 'OBJECT' THEN [CAST(b AS JSON)] END AS recs,
                       json_type(b) = 'OBJECT'
                         AND (coalesce(CAST(b -> 'next' AS VARCHAR) NOT IN {FALSY_SQL}, false)
                              OR coalesce(CAST(b -> 'has_more' AS VARCHAR) NOT IN {FALSY_SQL}, false)) AS has_more
                FROM (SELECT event_id, {API_BODY_SQL} AS b FROM events) x) y) z
""")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _api_body().alias("body"))
    return e.select("event_id", J.api_has_more("body").alias("has_more"),
                    F.posexplode_outer(J.api_records("body")).alias("pos", "rec")) \
            .filter(F.col("pos").isNotNull()) \
            .select("event_id", "pos", F.get_json_object("rec", "$.k").alias("k"), "has_more")


def _file_doc() -> Column:
    e, p = F.col("event_id"), F.col("props")
    k = F.get_json_object(p, "$.k")
    return (F.when(e % 4 == 0, F.concat(F.lit("["), p, F.lit("]")))
            .when(e % 4 == 1, F.concat(F.lit('{"meta": {"n": 2}, "empty": [], "items": ['), p,
                                       F.lit(", "), p, F.lit("]}")))
            .when(e % 4 == 2, F.concat(F.lit('{"empty": [], "x": '), k, F.lit("}")))
            .otherwise(k))


FILE_DOC_SQL = """CASE WHEN event_id % 4 = 0 THEN '[' || props || ']'
                       WHEN event_id % 4 = 1 THEN '{"meta": {"n": 2}, "empty": [], "items": [' || props || ', ' || props || ']}'
                       WHEN event_id % 4 = 2 THEN '{"empty": [], "x": ' || (props->>'k') || '}'
                       ELSE props->>'k' END"""


@register("json_file_records", f"""
    SELECT event_id, CAST(pos - 1 AS INTEGER) AS pos,
           CASE WHEN json_type(rec) = 'OBJECT' THEN coalesce(rec->>'k', rec->>'x') ELSE CAST(rec AS VARCHAR) END AS value
    FROM (SELECT event_id, unnest(recs) AS rec, generate_subscripts(recs, 1) AS pos
          FROM (SELECT event_id,
                       CASE WHEN json_type(d) = 'ARRAY' THEN json_extract(d, '$[*]')
                            WHEN event_id % 4 = 1 THEN json_extract(d, '$.items[*]')
                            ELSE [CAST(d AS JSON)] END AS recs
                FROM (SELECT event_id, {FILE_DOC_SQL} AS d FROM events) x) y) z
""")
def json_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event rendered as one landed JSON document of a varying shape."""
    e = table(spark, sf_dir, "events").select("event_id", _file_doc().alias("doc"))
    r = e.select("event_id", F.posexplode_outer(J.file_records("doc")).alias("pos", "rec")) \
         .filter(F.col("pos").isNotNull())
    is_obj = F.substring(F.trim("rec"), 1, 1) == "{"
    return r.select("event_id", "pos", F.when(is_obj, F.coalesce(
        F.get_json_object("rec", "$.k"), F.get_json_object("rec", "$.x"))).otherwise(F.col("rec"))
        .alias("value"))


@register("json_flatten", """
    SELECT event_id AS "event.id", event_type AS "event.type",
           CAST(props->>'k' AS BIGINT) AS "props.k", '["a","b"]' AS tags, value
    FROM events
""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON lines landed as text, read without a declared schema and
    flattened to dotted columns."""
    path = scratch_dir(spark, "nested_json")
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit('{"event": {"id": '), F.col("event_id").cast("string"),
                    F.lit(', "type": "'), F.col("event_type"), F.lit('"}, "props": '), F.col("props"),
                    F.lit(', "value": '), F.col("value").cast("string"),
                    F.lit(', "tags": ["a", "b"]}'))
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    return J.read_json_flat(spark, path)


#: Events in one landed document, at most.
DOCUMENT_EVENTS = 500


@register("json_documents", f"""
    WITH e AS (SELECT *, event_id // {DOCUMENT_EVENTS} AS doc FROM events),
    n AS (SELECT doc, count(*) AS n FROM e GROUP BY 1)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY event_id) - 1 AS INTEGER) AS row_no,
           event_id AS "event.id", event_type AS "event.type",
           CASE WHEN doc % 4 = 0 THEN value END AS value, CASE WHEN doc % 4 = 1 THEN CAST(props->>'k' AS BIGINT) END AS "props.k",
           CASE WHEN doc % 4 = 1 THEN '[' || user_id || ',null]' END AS users, NULL AS n, NULL AS record
    FROM e WHERE doc % 4 < 2
    UNION ALL SELECT doc, 0, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc % 4 = 2 THEN n END,
                     CASE WHEN doc % 4 = 3 THEN n::VARCHAR END FROM n WHERE doc % 4 >= 2
""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a file, in four shapes with different fields: a list,
    an object that holds one, an object without any, a number.  The fields of
    all files are found, not declared."""
    root = scratch_dir(spark, "documents_json")
    e = table(spark, sf_dir, "events").withColumn("doc", F.floor(F.col("event_id") / DOCUMENT_EVENTS))
    event = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    shape = F.col("doc") % 4
    record = F.when(shape == 0, F.to_json(F.struct(event.alias("event"), "value"))).otherwise(F.concat(
        F.lit('{"event": '), F.to_json(event), F.lit(', "props": '), F.col("props"), F.lit(', "users": ['),
        F.col("user_id").cast("string"), F.lit(", null]}")))
    own = F.array_sort(F.collect_list(F.struct("event_id", record.alias("r"))))       # DOCUMENT_EVENTS at most
    docs = e.groupBy("doc").agg(F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: x["r"]), ", "), F.lit("]"))
                                .alias("list"), F.count(F.lit(1)).cast("string").alias("n"))
    line = (F.when(shape == 0, F.col("list"))
            .when(shape == 1, F.concat(F.lit('{"meta": {"n": 2}, "empty": [], "items": '), F.col("list"), F.lit("}")))
            .when(shape == 2, F.concat(F.lit('{"empty": [], "n": '), F.col("n"), F.lit("}"))).otherwise(F.col("n")))
    docs.select("doc", line.alias("line")).write.partitionBy("doc").text(root)
    records = staged(J.read_json_files(spark, root).select(
        F.regexp_extract("path", "doc=([0-9]+)/", 1).cast("long").alias("doc"), "row_no", "record"), "json-records")
    flat = J.flatten_records(records)
    names = ["doc", "row_no", "event.id", "event.type", "value", "props.k", "users", "n"]
    return flat.select(*[F.col(f"`{c}`") if c in flat.columns else F.lit(None).cast("string").alias(c) for c in names],
                       F.col("__record").alias("record"))


# ------------------------------------------------------------ project API

PROJECT_ROWS_PER_PAGE = 300


def _q(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _dollar(x: Column) -> Column:
    return F.concat(F.lit('{"$": "'), x, F.lit('"}'))


def _project_json(k: Column) -> Column:
    ks = k.cast("string")
    start = F.to_date("o_orderdate")
    code = F.when(k % 3 == 0, _dollar(ks)).when(k % 3 == 1, ks).otherwise(_q(ks))
    acr = F.concat(F.lit("P"), ks)
    acronym = F.when(k % 2 == 0, _dollar(acr)).otherwise(_q(acr))
    sd = F.when(k % 4 != 0, F.concat(F.lit(', "startdate": '), _dollar(F.date_format(start, "yyyy-MM-dd")))) \
          .otherwise(F.lit(""))
    ed = F.when(k % 4 != 1, F.concat(F.lit(', "enddate": '), _q(F.date_format(F.date_add(start, 365), "yyyy-MM-dd")))) \
          .otherwise(F.lit(""))
    funder = F.when(k % 5 == 0, F.lit('{"shortname": {"$": "EC"}}')).otherwise(
        F.concat(F.lit('[{"shortname": {"$": "EC"}}, {"shortname": ""}, {"shortname": "'),
                 F.col("o_orderstatus"), F.lit('"}]')))
    inner = F.concat(F.lit('{"code": '), code, F.lit(', "acronym": '), acronym,
                     F.lit(', "title": '), _q(F.col("o_orderpriority")), sd, ed,
                     F.lit(', "fundingtree": {"funder": '), funder, F.lit("}}"))
    return F.when(k % 2 == 0, F.concat(F.lit('{"metadata": {"oaf:entity": {"oaf:project": '), inner,
                                       F.lit("}}}"))) \
            .otherwise(F.concat(F.lit('{"metadata": '), inner, F.lit("}")))


def _total_json(total: Column, page: Column) -> Column:
    t = total.cast("string")
    return (F.when(page % 4 == 0, t).when(page % 4 == 1, _q(t))
            .when(page % 4 == 2, _dollar(t))
            .otherwise(F.concat(F.lit('{"count": '), t, F.lit("}"))))


def project_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as landed project-API pages ``(source, page, body)``.

    Orders group into pages by key range (at most 300 per page, bounded by
    construction); each source ends with an empty page followed by a stray
    copy of its first page, and has a page 0 whose only project has no
    metadata.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority",
                                               "o_orderdate")
    k = F.col("o_orderkey")
    items = o.select(F.concat(F.lit("proj_"), F.lower("o_orderstatus")).alias("source"),
                     (F.floor(k / PROJECT_ROWS_PER_PAGE) + 1).cast("bigint").alias("page"),
                     k.alias("k"), _project_json(k).alias("item"))
    pages = staged(items.groupBy("source", "page").agg(
        F.sort_array(F.collect_list(F.struct("k", "item"))).alias("its")), "project-items")
    totals = pages.groupBy("source").agg(
        F.sum(F.size("its")).alias("total"), F.max("page").alias("last_page"))
    pages = pages.join(totals, "source")
    arr = F.transform("its", lambda x: x["item"])
    result = F.when(F.size(arr) == 1, F.get(arr, 0)) \
              .otherwise(F.concat(F.lit("["), F.array_join(arr, ", "), F.lit("]")))

    def body(total_page: Column, results: Column) -> Column:
        return F.concat(F.lit('{"response": {"header": {"total": '),
                        _total_json(F.col("total"), total_page), F.lit('}, "results": '),
                        results, F.lit("}}"))

    data = pages.select("source", "page", body(F.col("page"), F.concat(
        F.lit('{"result": '), result, F.lit("}"))).alias("body"))
    empty = totals.select("source", (F.col("last_page") + 1).alias("page"),
                          body(F.col("last_page") + 1, F.lit("{}")).alias("body"))
    stray = data.filter(F.col("page") == 1).join(totals, "source").select(
        "source", (F.col("last_page") + 2).alias("page"), "body")
    bare = totals.select("source", F.lit(0).cast("bigint").alias("page"), body(F.lit(0), F.concat(
        F.lit('{"result": {"id": "'), F.col("source"), F.lit('", "metadata": "gone"}}'))).alias("body"))
    return data.unionByName(empty).unionByName(stray).unionByName(bare)


PROJECT_BASE_SQL = f"""
    SELECT 'proj_' || lower(o_orderstatus) AS source,
           CAST(o_orderkey // {PROJECT_ROWS_PER_PAGE} + 1 AS BIGINT) AS page, o_orderkey AS k, *
    FROM orders
"""


@register("project_flatten", f"""
    WITH b AS ({PROJECT_BASE_SQL}),
    landed AS (SELECT * FROM b UNION ALL BY NAME
               SELECT b.* REPLACE ((SELECT max(page) + 2 FROM b x WHERE x.source = b.source) AS page)
               FROM b WHERE page = 1)
    SELECT source, page, CAST(row_number() OVER (PARTITION BY source, page ORDER BY k) - 1 AS INTEGER) AS pos,
           CAST(k AS VARCHAR) AS code, 'P' || CAST(k AS VARCHAR) AS acronym, o_orderpriority AS title,
           CASE WHEN k % 4 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS start_date,
           CASE WHEN k % 4 <> 1 THEN strftime(CAST(o_orderdate AS DATE) + 365, '%Y-%m-%d') END AS end_date,
           CASE WHEN k % 5 = 0 THEN 'EC' ELSE 'EC; ' || o_orderstatus END AS funder, NULL AS raw_id
    FROM landed
    UNION ALL
    SELECT DISTINCT source, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, source FROM b
""")
def project_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.flatten_projects(project_landing(spark, sf_dir))


@register("project_pages", f"""
    WITH b AS ({PROJECT_BASE_SQL}),
    per AS (SELECT source, page, count(*) AS n FROM b GROUP BY source, page),
    tot AS (SELECT source, count(*) AS total, max(page) AS last_page FROM b GROUP BY source),
    allp AS (SELECT source, page, n FROM per
             UNION ALL SELECT source, 0, 1 FROM tot
             UNION ALL SELECT source, last_page + 1, 0 FROM tot
             UNION ALL SELECT t.source, t.last_page + 2, p.n FROM tot t JOIN per p
                       ON p.source = t.source AND p.page = 1)
    SELECT a.source, a.page, CAST(a.n AS INTEGER) AS n_items, t.total,
           CASE WHEN f.source IS NOT NULL THEN CAST(ceil(t.total / 100.0) AS BIGINT) END AS expected_pages,
           a.page > t.last_page + 1 AS after_empty,
           coalesce(f.source IS NOT NULL AND t.total > 0 AND a.page > ceil(t.total / 100.0), false) AS beyond_announced
    FROM allp a JOIN tot t USING (source) LEFT JOIN (SELECT source FROM per WHERE page = 1) f USING (source)
""")
def project_pages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.project_pages(project_landing(spark, sf_dir))


# ------------------------------------------------------------- round trips

# Full microsecond precision (the writers' default keeps milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("roundtrip_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "events_json")
    e = table(spark, sf_dir, "events")
    e.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).json(path)
    return (spark.read.schema(e.schema).option("timestampNTZFormat", TS_FORMAT).json(path)
            .select(*EVENT_COLS))


@register("roundtrip_csv", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "orders_csv")
    o = table(spark, sf_dir, "orders")
    o.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path)
    return (spark.read.schema(o.schema).option("header", True)
            .option("timestampNTZFormat", TS_FORMAT).csv(path))


@register("roundtrip_pages", """
    SELECT page_id, 'page' || CAST(page_id AS VARCHAR) AS source_id, url, md5(html) AS html_md5,
           CAST(length(html) AS INTEGER) AS html_chars
    FROM pages
""")
def roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grantflow.sources.html_pages import read_pages, write_pages
    path = scratch_dir(spark, "pages")
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("source_id"),
        "url", "html")
    write_pages(p, path)
    back = read_pages(spark, path)
    return back.select("page_id", "source_id", "url", F.md5("html").alias("html_md5"),
                       F.length("html").alias("html_chars"))


# ------------------------------------------------------------------ landing

LANDING_ROOT = "raw"


def land_events(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Events landed as runs: weekly runs per (source, action); every run
    as JSON, and the runs of two sources also as CSV."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        F.concat(F.lit("src_"), (F.col("user_id") % 5).cast("string")).alias("source_name"),
        F.concat(F.lit("a"), (F.col("event_id") % 2).cast("string")).alias("action"),
        run_label(F.date_trunc("week", "ts")).alias("run_ts"))
    L.land(e, root, "json")
    L.land(e.filter(F.col("source_name").isin("src_0", "src_1")), root, "csv", header=True)


@register("landing_latest", f"""
    WITH e AS (SELECT 'src_' || CAST(user_id % 5 AS VARCHAR) AS source_name,
                      'a' || CAST(event_id % 2 AS VARCHAR) AS action,
                      strftime(date_trunc('week', ts), '%Y%m%d_%H%M%S') AS run_ts FROM events),
    latest AS (SELECT source_name, action, max(run_ts) AS run_ts FROM e GROUP BY 1, 2)
    SELECT source_name, action, run_ts AS run_label,
           CASE WHEN source_name IN ('src_0', 'src_1') THEN 'csv' ELSE 'json' END AS format,
           (SELECT count(*) FROM e WHERE e.source_name = l.source_name AND e.action = l.action
                                     AND e.run_ts = l.run_ts) AS n_records,
           '{LANDING_ROOT}/' || source_name || '/' || action AS raw_path
    FROM latest l
""")
def landing_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "landing")
    land_events(spark, sf_dir, root)
    chosen = L.pick_files(L.latest_run_files(staged(L.list_landed(spark, root), "listing")))
    keys = ["source_name", "action", "run_ts"]
    chosen_runs = staged(chosen.select(*keys, F.col("ext").alias("format")).distinct(), "chosen-runs")
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string"
    js = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(root)
    cs = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(root)
    rows = (js.withColumn("format", F.lit("json")).unionByName(cs.withColumn("format", F.lit("csv")))
            .select(*[F.col(c).cast("string") for c in keys], "format"))
    picked = rows.join(chosen_runs, [*keys, "format"], "left_semi")
    counts = picked.groupBy(*keys, "format").agg(F.count(F.lit(1)).alias("n_records"))
    return counts.select("source_name", "action", F.col("run_ts").alias("run_label"), "format",
                         "n_records", raw_path(LANDING_ROOT, F.col("source_name"), F.col("action"))
                         .alias("raw_path"))


# ------------------------------------------------------- ragged page union

RAGGED = [["event_id", "ts", "user_id"], ["event_type"], ["value"], ["props"]]


def _ragged_cols(p: int) -> list[str]:
    return [c for group in RAGGED[: p + 1] for c in group]


RAGGED_SCHEMA = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four pages with growing column sets; null where a page lacks a column."""
    e = table(spark, sf_dir, "events").withColumn("page", (F.col("event_id") % 4).cast("int"))
    late = {c: p for p, group in enumerate(RAGGED) for c in group}
    return e.select("page", *[F.when(F.col("page") >= late[c], F.col(c)).alias(c) for c in EVENT_COLS])


def _write_ragged(rows: DataFrame, root: str) -> str:
    """All pages in one job: fields that a page lacks are left out of its JSON lines."""
    (rows.write.partitionBy("page").option("ignoreNullFields", True)
     .option("timestampNTZFormat", TS_FORMAT).json(root))
    return root


def _land_ragged(spark: SparkSession, sf_dir: str) -> str:
    return _write_ragged(_ragged(spark, sf_dir), scratch_dir(spark, "ragged"))


@register("load_counts", """
    SELECT CAST(event_id % 4 AS INTEGER) AS page, count(*) AS n_records,
           CAST(3 + event_id % 4 AS INTEGER) AS n_columns
    FROM events GROUP BY 1, 3
""")
def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and columns of every page, observed while they are landed."""
    rows = _ragged(spark, sf_dir)
    counts = LoadCounts(rows, "page", range(len(RAGGED)), EVENT_COLS)
    _write_ragged(counts.rows, scratch_dir(spark, "ragged"))
    return counts.result().where("n_records > 0").select(F.col("load").cast("int").alias("page"), "n_records", "n_columns")


@register("union_pages", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id,
           CASE WHEN event_id % 4 >= 1 THEN event_type END AS event_type,
           CASE WHEN event_id % 4 >= 2 THEN value END AS value,
           CASE WHEN event_id % 4 = 3 THEN props END AS props
    FROM events
""")
def union_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(RAGGED_SCHEMA).json(_land_ragged(spark, sf_dir)).drop("page")


@register("source_continuation", f"""
    WITH p AS (SELECT 'src_' || CAST(user_id AS VARCHAR) AS source, event_id AS page, {API_BODY_SQL} AS body
               FROM events),
    m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page DESC) AS rn,
                 count(*) OVER (PARTITION BY source) AS n_pages FROM p)
    SELECT source, n_pages, page AS last_page,
           coalesce(json_type(body) = 'OBJECT'
             AND (coalesce(CAST(body -> 'next' AS VARCHAR) NOT IN {FALSY_SQL}, false)
                  OR coalesce(CAST(body -> 'has_more' AS VARCHAR) NOT IN {FALSY_SQL}, false)), false) AS incomplete
    FROM m WHERE rn = 1
""")
def source_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose last landed page still announces more."""
    pages = table(spark, sf_dir, "events").select(
        F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_id").alias("page"), _api_body().alias("body"))
    return J.sources_with_more(pages)


# ------------------------------------------------------------- damaged CSV

DOC_HEADER = "doc_id,lang,source,n_chars,text"


def _csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def write_lines(df: DataFrame, header: str | None, path: str, encoding: str = "UTF-8") -> None:
    """Pre-formatted lines (column ``line``) written as-is, ``header`` first
    in every file (added per partition, so each output file starts with it)."""
    lines = df.select("line")
    if header is not None:
        # The lower bits of this id count the rows of a partition.
        of_file = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        lines = lines.withColumn("nth", of_file).select(F.explode(
            F.when(F.col("nth") == 0, F.array(F.lit(header), "line")).otherwise(F.array("line"))).alias("line"))
    if encoding.upper().replace("-", "") == "UTF8":
        lines.write.mode("overwrite").text(path)
        return
    # Other encodings: the CSV writer with separator/quote characters that
    # never occur, so each line is written verbatim in ``encoding``.
    (lines.write.mode("overwrite").option("sep", "\u0001").option("quote", "\u0002")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", encoding).csv(path))


def _damaged_docs(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "docs_csv")
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    full = F.concat_ws(",", k.cast("string"), "lang", "source", F.col("n_chars").cast("string"),
                       _csv_quote(F.col("text")))
    line = (F.when(k % 7 == 0, F.concat(full, F.lit(",EXTRA")))
            .when(k % 11 == 0, F.concat_ws(",", k.cast("string"), "lang"))
            .otherwise(full))
    write_lines(d.select(line.alias("line")), DOC_HEADER, path)
    return path


def _na_sql(x: str) -> str:
    from grantflow.schema import NA_TOKENS
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"(CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END)"


@register("csv_tolerant", f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_na_sql('lang')} AS lang,
           CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {_na_sql('source')} END AS source,
           CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS n_chars,
           CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {_na_sql('text')} END AS text
    FROM documents WHERE doc_id % 7 <> 0
""")
def csv_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CT.read_tolerant_csv(spark, _damaged_docs(spark, sf_dir))
    kept, _ = CT.split_overflow(rows)
    return kept.drop("__file")


@register("csv_quarantine", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id,
           concat_ws(',', CAST(doc_id AS VARCHAR), lang, source, CAST(n_chars AS VARCHAR),
                     '"' || replace(text, '"', '""') || '"', 'EXTRA') AS overflow
    FROM documents WHERE doc_id % 7 = 0
""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-long rows with their whole record."""
    rows = CT.read_tolerant_csv(spark, _damaged_docs(spark, sf_dir))
    _, bad = CT.split_overflow(rows)
    return bad.select("doc_id", F.col(CT.OVERFLOW).alias("overflow"))


@register("csv_verify", """
    SELECT 'strict' AS kind, 'strict' AS verdict, count(*) AS n_rows, 0 AS n_overflow FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT 'extra', 'skip_bad', count(*), count(*) FROM documents WHERE doc_id % 5 = 1
    UNION ALL SELECT 'quote', 'quote_none', count(*), 0 FROM documents WHERE doc_id % 5 = 2
    UNION ALL SELECT 'semicolon', 'sniffed', count(*), 0 FROM documents WHERE doc_id % 5 = 3
    UNION ALL SELECT 'blank', 'unparsed_nonempty', 0, 0
""")
def csv_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of files, one per rung of the ladder, rows summed per verdict."""
    root = scratch_dir(spark, "verify")
    d = table(spark, sf_dir, "documents")
    k, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    short = F.concat_ws(",", k, "lang", "source")
    full = F.concat_ws(",", k, "lang", _csv_quote(F.col("text")))
    kinds = [("strict", 0, full, "doc_id,lang,text"), ("extra", 1, F.concat(full, F.lit(",EXTRA")), "doc_id,lang,text"),
             ("quote", 2, short, 'doc_id,lang,"source'), ("semicolon", 3, F.concat_ws(";", k, "lang", "source"),
                                                          "doc_id;lang;source"),
             ("blank", 4, F.lit(""), "doc_id,lang,source")]
    for name, rest, line, header in kinds:
        write_lines(d.filter(kind == rest).select(line.alias("line")), header, f"{root}/{name}")
    verdicts = CT.verify_files(spark, f"{root}/*")
    return (verdicts.groupBy(F.regexp_extract("path", "([a-z]+)/[^/]*$", 1).alias("kind"), "verdict")
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_overflow").alias("n_overflow")))


@register("csv_mixed_headers", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
           CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS "name.1" FROM customer
""")
def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder with two column orders and a repeated header; a
    data row equal to the header and a row without values are kept."""
    root = scratch_dir(spark, "mixed_headers")
    c = table(spark, sf_dir, "customer")
    key, rest = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    for i, (cols, header) in enumerate([((key, "c_name"), "id,name"), (("c_name", key), "name,id"),
                                        ((key, "c_name", "c_mktsegment"), "id,name,name")]):
        write_lines(c.filter(rest == i).select(F.concat_ws(",", *cols).alias("line")), header, f"{root}/{i}")
    return CT.split_overflow(CT.read_tolerant_csv(spark, f"{root}/*", multiline=False))[0].drop("__file")


@register("csv_quote_none", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, '"' || c_name AS name FROM customer
""")
def csv_quote_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that start with a quote that never closes."""
    path = scratch_dir(spark, "quote_none")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name")
    write_lines(table(spark, sf_dir, "customer").select(line.alias("line")), "id,name", path)
    return CT.split_overflow(CT.read_tolerant_csv(spark, path, quote="", multiline=False))[0].drop("__file")


@register("csv_empty_header", """
    SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0
""")
def csv_empty_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first line is empty have no columns to map and are skipped."""
    root = scratch_dir(spark, "empty_header")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("line"))
    write_lines(c.filter("c_custkey % 2 = 0").select("line"), "id", f"{root}/named")
    write_lines(c.filter("c_custkey % 2 = 1").select("line"), "", f"{root}/bare")
    return CT.split_overflow(CT.read_tolerant_csv(spark, f"{root}/*", multiline=False))[0].drop("__file")


def _latin1_customers(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "customers_latin1")
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"),
                       F.concat(F.col("c_name"), F.lit(" Müller-Núñez")), "c_mktsegment")
    odd = c.filter(F.col("c_custkey") % 2 == 1).select(line.alias("line"))
    even = c.filter(F.col("c_custkey") % 2 == 0).select(line.alias("line"))
    write_lines(odd, "c_custkey,c_näme,c_mktsegment", os.path.join(path, "latin1"), "ISO-8859-1")
    write_lines(even, "c_custkey,c_näme,c_mktsegment", os.path.join(path, "utf8"), "UTF-8")
    return path


@register("csv_latin1", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' Müller-Núñez' AS "c_näme", c_mktsegment
    FROM customer
""")
def csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the files in ISO-8859-1, half in UTF-8: invalid UTF-8 files are re-read as Latin-1."""
    root = _latin1_customers(spark, sf_dir)
    rows = CT.read_tolerant_csv(spark, os.path.join(root, "*"), multiline=False)
    kept, _ = CT.split_overflow(rows)
    return kept.drop("__file")


@register("csv_sniff", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, o_orderpriority
    FROM orders
""")
def csv_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed with ';' (and ``|`` for a third of them); each file's
    delimiter is sniffed from all of its records, and the files are read per
    dialect."""
    path = scratch_dir(spark, "orders_sniff")
    o = table(spark, sf_dir, "orders")
    cols = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderpriority")]
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    third = F.col("o_orderkey") % 3 == 0
    write_lines(o.filter(~third).select(F.concat_ws(";", *cols).alias("line")), ";".join(names),
                os.path.join(path, "semi"))
    write_lines(o.filter(third).select(F.concat_ws("|", *cols).alias("line")), "|".join(names),
                os.path.join(path, "pipe"))
    rows, _ = CT.read_sniffed(spark, os.path.join(path, "*"))
    return CT.split_overflow(rows)[0].drop("__file")


@register("csv_dialects", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
           CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '; ') WHEN doc_id % 3 = 1 THEN replace(text, ' ', '|')
                ELSE replace(text, '. ', chr(10) || '; ') END AS text
    FROM documents
""")
def csv_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three dialects, quoted fields full of other delimiters and
    of line breaks: ``;`` and ``"``, ``|`` and ``'``, ``,`` and ``"``."""
    root = scratch_dir(spark, "dialects")
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    texts = [F.replace("text", F.lit(" "), F.lit("; ")), F.replace("text", F.lit(" "), F.lit("|")),
             F.replace("text", F.lit(". "), F.lit("\n; "))]
    for i, (sep, quote, text) in enumerate(zip(";|,", "\"'\"", texts)):
        quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        write_lines(d.where(F.col("doc_id") % 3 == i).select(F.concat_ws(sep, k, "lang", quoted).alias("line")),
                    sep.join(["doc_id", "lang", "text"]), f"{root}/{i}")
    rows, unknown = CT.read_sniffed(spark, f"{root}/*")
    lost = unknown.select(F.concat(F.lit("unread "), F.col("path")).alias("doc_id"), F.lit(None).cast("string").alias("lang"),
                          F.lit(None).cast("string").alias("text"))
    return CT.split_overflow(rows)[0].drop("__file").unionByName(lost)


@register("csv_multiline", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, ' ', chr(10)) || '"' AS text, lang FROM documents
""")
def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a quoted field on a line of its own, in files that are
    cut wherever a split ends."""
    path = scratch_dir(spark, "multiline")
    text = F.concat(F.replace("text", F.lit(" "), F.lit("\n")), F.lit('"'))
    d = table(spark, sf_dir, "documents")
    write_lines(d.select(F.concat_ws(",", F.col("doc_id").cast("string"), _csv_quote(text), "lang").alias("line")),
                "doc_id,text,lang", path)
    return CT.split_overflow(CT.read_tolerant_csv(spark, path, na_exempt=("text",)))[0].drop("__file")


def _land_layouts(spark: SparkSession, sf_dir: str) -> str:
    """Customers of each nation under a title and a header of their own."""
    root = scratch_dir(spark, "layouts")
    c = table(spark, sf_dir, "customer").withColumn("layout", F.col("c_nationkey"))
    k, n = F.col("c_custkey").cast("string"), F.col("layout").cast("string")
    own, turned = F.concat(F.lit("seg"), n), F.col("layout") % 2 == 1
    rows = c.select("layout", F.lit(2).alias("place"), F.when(turned, F.concat_ws(",", "c_name", k, "c_mktsegment"))
                    .otherwise(F.concat_ws(",", k, "c_name", "c_mktsegment")).alias("line"))
    heads = c.select("layout", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.lit('Customers of "nation '), n).alias("line")),
        F.struct(F.lit(1).alias("place"), F.when(turned, F.concat_ws(",", F.lit("name"), F.lit("id"), own))
                 .otherwise(F.concat_ws(",", F.lit("id"), F.lit("name"), own)).alias("line")))).alias("h")).distinct()
    (rows.unionByName(heads.select("layout", "h.*")).repartition("layout").sortWithinPartitions("layout", "place")
     .select("layout", "line").write.partitionBy("layout").text(root))
    return root


@register("csv_layouts", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'seg' || c_nationkey AS own_column, c_mktsegment AS own_value
    FROM customer
""")
def csv_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout per nation below a title line: one scan, values by name."""
    rows = CT.read_mapped(spark, _land_layouts(spark, sf_dir), header_row=1)
    own = F.filter(F.map_keys("values"), lambda n: n.startswith("seg"))[0]
    return rows.select(F.col("values")["id"].alias("id"), F.col("values")["name"].alias("name"), own.alias("own_column"),
                       F.element_at("values", own).alias("own_value"))


@register("csv_layout_columns", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
           CASE WHEN c_nationkey = 3 THEN c_mktsegment END AS seg3, CASE WHEN c_nationkey = 4 THEN c_mktsegment END AS seg4,
           (SELECT 2 + count(DISTINCT c_nationkey) FROM customer) AS n_columns
    FROM customer
""")
def csv_layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as the columns of all layouts."""
    rows = CT.read_tolerant_csv(spark, _land_layouts(spark, sf_dir), header_row=1)
    kept = CT.split_overflow(rows)[0].drop("__file", "layout")
    return kept.select("id", "name", "seg3", "seg4", F.lit(len(kept.columns)).cast("long").alias("n_columns"))


@register("header_offset", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer
""")
def header_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose header sits on line 2 under a title line."""
    path = scratch_dir(spark, "customers_offset")
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    write_lines(c.select(line.alias("line")), "Customer export\nc_custkey,c_name,c_mktsegment", path)
    rows = CT.read_tolerant_csv(spark, path, header_row=1, multiline=False)
    kept, _ = CT.split_overflow(rows)
    return kept.drop("__file")


# --------------------------------------------------------------- streaming

#: Most rows of a landed file of the stream, and its micro-batches, about.
STREAM_FILE_ROWS, STREAM_BATCHES = 100_000, 4


STREAM_OUT_SQL = _conformed_out_sql("first_column").replace("SELECT grant_id,", "SELECT source_id, grant_id,", 1)


def _ingested(spark: SparkSession, p: dict[str, str], schema, **options) -> None:
    """Ingest what lies in the landing folder, in several batches of files."""
    files = len(spark.read.format("binaryFile").load(p["landing"]).inputFiles())
    ingest_landing(spark, p["landing"], schema, p["grants"], p["checkpoint"], p["ingest_runs"],
                   files_per_trigger=max(1, -(-files // STREAM_BATCHES)), **options)


def _streamed(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    p = paths(scratch_dir(spark, "stream"))
    g = landing_frame(spark, sf_dir).drop("row_no")
    g.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(p["landing"])
    _ingested(spark, p, g.schema)
    return p


@register("stream_ingest", STREAM_OUT_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed grant files ingested incrementally (AvailableNow): ``grants`` and
    ``quarantine`` together have the batch conform of all rows."""
    p = _streamed(spark, sf_dir)
    columns = default_transform(landing_frame(spark, sf_dir).drop("row_no")).withColumn("batch_id", F.lit(0)).schema
    good, bad = (committed(spark, p[t], p["ingest_runs"], columns) for t in ("grants", "quarantine"))
    return portable(good.unionByName(bad).select("source_id", *CONFORMED_OUT, "quarantine_reasons"))


@register("stream_quarantine", f"""
    SELECT x.*, n_rows, n_quarantined FROM ({STREAM_OUT_SQL}) x
    JOIN (SELECT source_id AS s, count(*) AS n_rows, count_if(quarantine_reasons <> '')::BIGINT AS n_quarantined
          FROM ({STREAM_OUT_SQL}) y GROUP BY 1) n ON x.source_id = n.s
    WHERE quarantine_reasons <> ''
""")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the same stream that were kept out of ``grants``, with the
    counts that its batches recorded for their source."""
    p = _streamed(spark, sf_dir)
    counts = spark.read.parquet(p["ingest_runs"]).groupBy("source_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_quarantined").alias("n_quarantined"))
    out = committed(spark, p["quarantine"], p["ingest_runs"])
    return portable(out.select("source_id", *CONFORMED_OUT, "quarantine_reasons").join(counts, "source_id"))


STREAM_COLUMNS = ["Project/Area Number", "Project Period (FY)", "Total Cost (Overall)", "source_id"]


def _text_stream(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """G landed as text with records that can't be read, ingested; both tables."""
    p = paths(scratch_dir(spark, f"stream-{fmt}"))
    g = landing_frame(spark, sf_dir)
    fields = F.struct(*[F.col(f"`{c}`") for c in STREAM_COLUMNS])
    if fmt == "csv":
        line = F.concat(F.to_csv(fields, {"quoteAll": "true"}), F.when(F.col("row_no") % 19 == 0, ",x").otherwise(""))
        write_lines(g.select(line.alias("line")), ",".join(STREAM_COLUMNS), p["landing"])
    else:
        line = F.to_json(fields)
        cut = F.when(F.col("row_no") % 19 == 0, F.substring(line, 1, 40)).otherwise(line)
        write_lines(g.select(cut.alias("line")), None, p["landing"])
    _ingested(spark, p, g.select(*[f"`{c}`" for c in STREAM_COLUMNS]).schema, fmt=fmt, pattern="*.txt")
    good = committed(spark, p["grants"], p["ingest_runs"]).withColumn("record", F.lit(None).cast("string"))
    bad = committed(spark, p["quarantine"], p["ingest_runs"])
    both = good.withColumn("table", F.lit("grants")).unionByName(bad.withColumn("table", F.lit("quarantine")))
    return portable(both.select("table", "grant_id", "start_date", "amount", "quarantine_reasons", "record"))


def _text_stream_sql(record: str) -> str:
    return f"""
    SELECT CASE WHEN lost OR quarantine_reasons <> '' THEN 'quarantine' ELSE 'grants' END AS "table",
           CASE WHEN NOT lost THEN grant_id END AS grant_id, CASE WHEN NOT lost THEN start_date END AS start_date,
           CASE WHEN NOT lost THEN amount END AS amount,
           CASE WHEN lost THEN 'unreadable' ELSE quarantine_reasons END AS quarantine_reasons,
           CASE WHEN lost THEN {record} END AS record
    FROM (SELECT c.*, g."Project Period (FY)" AS period, g."Total Cost (Overall)" AS cost, g.row_no % 19 = 0 AS lost
          FROM ({STREAM_OUT_SQL}) c JOIN ({LANDING_SQL}) g ON c.grant_id = g."Project/Area Number") x
    """


@register("stream_csv", _text_stream_sql(
    """'"' || grant_id || '","' || period || '","' || cost || '","' || source_id || '",x'"""))
def stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV landings with over-long records as a stream."""
    return _text_stream(spark, sf_dir, "csv")


@register("stream_json", _text_stream_sql(
    """left('{"Project/Area Number":"' || grant_id || '","Project Period (FY)":"' || period, 40)"""))
def stream_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON landings with truncated lines as a stream."""
    return _text_stream(spark, sf_dir, "json")


__all__ = ["LANDING_SQL"]
