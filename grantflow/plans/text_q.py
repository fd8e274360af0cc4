"""Queries over text: model responses, HTML pages, URLs, small parsers, prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions import html as H
from grantflow.functions import text as T
from grantflow.functions.ids import source_description, truthy, url_filename
from grantflow.functions.prompts import (
    EXTRACT_BODY, EXTRACT_HEAD, MAPPING_COLUMNS, MAPPING_HEAD, MAPPING_TAIL, MAPPING_VOCAB,
    column_lines, extract_prompt, mapping_prompt, vocabulary_lines,
)
from grantflow.operators import inference as INF
from grantflow.operators import mapping as M
from grantflow.plans.frames import LANDING_COLUMNS, LANDING_SQL, landing_frame, table
from grantflow.plans.registry import register
from grantflow.sources.html_pages import page_text, scrape_blocks, text_chunks


def sql_str(s: str) -> str:
    """A SQL string literal (single quotes doubled; newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


# ----------------------------------------------------------- model responses

@register("response_envelope", """
    SELECT conv_id, turn,
           coalesce(json_extract_string(env, '$.choices[0].message.content'), '') AS content
    FROM (SELECT conv_id, turn,
                 CASE WHEN turn % 3 = 0 THEN '{"choices": []}'
                      ELSE CAST(json_object('choices', [json_object('message',
                                json_object('role', role, 'content', text))]) AS VARCHAR) END AS env
          FROM conversations) x
""")
def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    env = F.when(F.col("turn") % 3 == 0, F.lit('{"choices": []}')).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.struct(
            F.col("role").alias("role"), F.col("text").alias("content")).alias("message")))
            .alias("choices"))))
    return conv.select("conv_id", "turn", T.response_text(env).alias("content"))


# The whole text as a JSON string (quotes included): one escaping for both engines.
PLAIN_SQL = ("replace(replace(regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g'), chr(92), '/'), "
             "chr(34), chr(39))")
WORD_SQL = f"({PLAIN_SQL})"


def _word() -> Column:
    """The whole text in a form that needs no JSON escapes."""
    return F.replace(F.replace(F.regexp_replace("text", r"[\x00-\x1f]", " "), F.lit("\\"), F.lit("/")),
                     F.lit('"'), F.lit("'"))


def _wrap(payload: Column, braces: bool) -> Column:
    """Five response shapes by conv_id % 5: json fence, bare fence, bare
    body (braces missing when ``braces``), whitespace padding, prose around
    a json fence."""
    body = F.concat(F.lit("{"), payload, F.lit("}")) if braces else payload
    v = F.col("conv_id") % 5
    return (F.when(v == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(v == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
            .when(v == 2, payload)
            .when(v == 3, F.concat(F.lit(" \n"), body, F.lit("\n\t")))
            .otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))))


def _wrap_sql(payload: str, braces: bool) -> str:
    body = f"'{{' || {payload} || '}}'" if braces else payload
    return f"""CASE conv_id % 5
        WHEN 0 THEN '```json' || chr(10) || {body} || chr(10) || '```'
        WHEN 1 THEN '```' || chr(10) || {body} || chr(10) || '```'
        WHEN 2 THEN {payload}
        WHEN 3 THEN ' ' || chr(10) || {body} || chr(10) || chr(9)
        ELSE 'Here it is:' || chr(10) || '```json' || chr(10) || {body} || chr(10) || '```' || chr(10) || 'Done.' END"""


def _mapping_payload() -> Column:
    return F.concat(F.lit('"'), F.col("role"), F.lit('": "'), _word(), F.lit('", "turn": "'),
                    F.col("turn").cast("string"), F.lit('"'))


MAPPING_PAYLOAD_SQL = (f"""'"' || role || '": "' || {WORD_SQL} || '", "turn": "' """
                       """|| CAST(turn AS VARCHAR) || '"'""")


def _records_payload() -> Column:
    return F.concat(
        F.lit('[{"project_title": "'), _word(), F.lit('", "institution": "'), F.col("role"),
        F.lit('", "funding_year": '), F.col("turn").cast("string"),
        F.lit(', "extra_note": "x"}, {"description": "c'), F.col("conv_id").cast("string"),
        F.lit('"}]'))


RECORDS_PAYLOAD_SQL = (f"""'[{{"project_title": "' || {WORD_SQL} || '", "institution": "' || role """
                       """|| '", "funding_year": ' || CAST(turn AS VARCHAR) """
                       """|| ', "extra_note": "x"}, {"description": "c' || CAST(conv_id AS VARCHAR) || '"}]'""")

WS = T.WS_CLASS


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def _fence_sql(x: str) -> str:
    s = _strip_sql(x)
    s = f"regexp_replace({s}, '\\A```(json)?', '')"
    s = f"regexp_replace({s}, '```\\z', '')"
    return _strip_sql(s)


def _braces_sql(x: str) -> str:
    s = _fence_sql(x)
    s = f"(CASE WHEN starts_with({s}, '{{') THEN {s} ELSE '{{' || {s} END)"
    return f"(CASE WHEN ends_with({s}, '}}') THEN {s} ELSE {s} || '}}' END)"


@register("fence_strip", f"""
    SELECT conv_id, turn, {_fence_sql('w')} AS stripped,
           nullif(regexp_extract(w, '(?s)```json\\n(.*?)\\n```', 1), '') AS fenced_json
    FROM (SELECT conv_id, turn, {_wrap_sql(MAPPING_PAYLOAD_SQL, True)} AS w FROM conversations) x
""")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    w = _wrap(_mapping_payload(), braces=True)
    return conv.select("conv_id", "turn", T.strip_fences(w).alias("stripped"),
                       T.extract_fenced_json(w).alias("fenced_json"))


@register("mapping_parse", f"""
    SELECT conv_id, turn, k AS source_col,
           coalesce(json_extract_string(c, '$."' || k || '"'), 'null') AS target_col
    FROM (SELECT conv_id, turn, c, unnest(json_keys(c)) AS k
          FROM (SELECT conv_id, turn, {_braces_sql('w')} AS c
                FROM (SELECT conv_id, turn, {_wrap_sql(MAPPING_PAYLOAD_SQL, False)} AS w
                      FROM conversations) x) y
          WHERE json_valid(c) AND json_type(c) = 'OBJECT') z
""")
def mapping_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    m = T.parse_mapping(T.strip_fences_braces(_wrap(_mapping_payload(), braces=False)))
    return conv.select("conv_id", "turn", F.explode_outer(m).alias("source_col", "target_col")) \
               .filter(F.col("source_col").isNotNull())


def _records_sql() -> str:
    fields = ", ".join(f"rec->>'{f}' AS {f}" for f in T.RECORD_FIELDS)
    return f"""
    SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, {fields},
           CAST(len(list_filter(json_keys(rec), lambda k: k NOT IN
               ({', '.join(repr(f) for f in T.RECORD_FIELDS)}))) AS INTEGER) AS n_other_fields
    FROM (SELECT conv_id, turn, unnest(recs) AS rec, generate_subscripts(recs, 1) AS pos
          FROM (SELECT conv_id, turn,
                       CASE WHEN json_valid(s) AND json_type(s) = 'ARRAY'
                            THEN json_extract(s, '$[*]') END AS recs
                FROM (SELECT conv_id, turn, {_fence_sql('w')} AS s
                      FROM (SELECT conv_id, turn, {_wrap_sql(RECORDS_PAYLOAD_SQL, False)} AS w
                            FROM conversations) a) b) c
          WHERE recs IS NOT NULL) d
    """


@register("records_parse", _records_sql())
def records_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    recs = T.parse_records(T.strip_fences(_wrap(_records_payload(), braces=False)))
    ex = conv.select("conv_id", "turn", F.posexplode_outer(recs).alias("pos", "rec")) \
             .filter(F.col("pos").isNotNull())
    known = F.array(*[F.lit(f) for f in T.RECORD_FIELDS])
    return ex.select(
        "conv_id", "turn", "pos",
        *[F.col("rec")[f].alias(f) for f in T.RECORD_FIELDS],
        F.size(F.array_except(F.map_keys("rec"), known)).alias("n_other_fields"))


# ------------------------------------------------------------------- pages

URL_PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@register("url_filename", f"""
    SELECT page_id, CASE WHEN f <> '' THEN f ELSE 'page' || CAST(page_id AS VARCHAR) || '.html' END AS filename
    FROM (SELECT page_id, regexp_extract({URL_PATH_SQL}, '[^/]*$', 0) AS f FROM pages) x
""")
def url_filename_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    sid = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    return p.select("page_id", url_filename("url", sid, F.lit(""), F.lit("html")).alias("filename"))


def html_text_sql(h: str = "html") -> str:
    x = h
    for pat in (H.SCRIPT_RE, H.STYLE_RE, H.COMMENT_RE, H.DOCTYPE_RE):
        x = f"regexp_replace({x}, '{pat}', '<x>', 'g')"
    dec = "t"
    for pat, rep in H.ENTITIES:
        rep_sql = "chr(160)" if rep == "\u00a0" else "'" + rep.replace("'", "''") + "'"
        dec = f"regexp_replace({dec}, '{pat}', {rep_sql}, 'g')"
    strip = f"regexp_replace({dec}, '\\A{WS}+|{WS}+\\z', '', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split_regex({x}, '{H.TAG_RE.replace("'", "''")}'), "
            f"lambda t: {strip}), lambda t: t <> ''), chr(10))")


@register("html_text", f"SELECT page_id, {html_text_sql()} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.html_to_text("html").alias("text"))


TRUNC_CHARS = 2000


@register("html_truncated", f"""
    SELECT page_id, CAST(length(text) AS INTEGER) AS text_chars, length(text) > {TRUNC_CHARS} AS truncated,
           substring(text, 1, {TRUNC_CHARS}) AS text_for_model
    FROM (SELECT page_id, {html_text_sql()} AS text FROM pages) x
""")
def html_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_text(table(spark, sf_dir, "pages"), TRUNC_CHARS)
    return t.select("page_id", F.length("text").alias("text_chars"), "truncated", "text_for_model")


HOST_SQL = "regexp_extract(url, '://([^/?#:]+)', 1)"
LANG_SQL = f"regexp_extract({URL_PATH_SQL}, '^/([^/]+)/', 1)"


CHUNK_CHARS, SHORT_CHARS = 32000, 600


def chunks_sql(limit: int) -> str:
    """Chunks by cutting one after the other off the rest of the text: all of
    it if it fits, else up to the last line end among the first ``limit``
    characters, else that many."""
    last_line = f"length(list_last(string_split(substring(rest, 1, {limit}), chr(10))))"
    size = (f"CASE WHEN length(rest) <= {limit} OR {last_line} = {limit} THEN {limit} "
            f"ELSE {limit} - {last_line} END")
    return f"""
    WITH RECURSIVE t AS (
      SELECT page_id, {html_text_sql()} AS text,
             CASE WHEN {LANG_SQL} <> '' THEN {HOST_SQL} || ' - ' || {LANG_SQL} ELSE {HOST_SQL} END AS src FROM pages),
    c(page_id, src, chunk_no, chunk, rest) AS (
      SELECT page_id, src, -1, '', text FROM t
      UNION ALL
      SELECT page_id, src, chunk_no + 1, substring(rest, 1, {size}), substring(rest, 1 + {size})
      FROM c WHERE chunk_no = -1 OR rest <> '')
    SELECT page_id, src, chunk_no, chunk FROM c WHERE chunk_no >= 0
    """


CHUNKS_SQL = chunks_sql(CHUNK_CHARS)


@register("text_chunks", f"""
    SELECT page_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM ({chunks_sql(SHORT_CHARS)}) c
""")
def text_chunks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text in chunks so short that most pages have several."""
    return text_chunks(table(spark, sf_dir, "pages"), SHORT_CHARS).select("page_id", "chunk_no", "chunk")


def _page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per chunk of a page's text: the whole text reaches the model."""
    t = text_chunks(table(spark, sf_dir, "pages"), CHUNK_CHARS)
    host = F.regexp_extract("url", "://([^/?#:]+)", 1)
    lang = F.regexp_extract(F.try_parse_url("url", F.lit("PATH")), "^/([^/]+)/", 1)
    desc = source_description(host, lang)
    return t.select("page_id", "chunk_no", desc.alias("source_desc"),
                    extract_prompt(desc, F.col("chunk")).alias("prompt"))


@register("extract_prompt", f"""
    SELECT page_id, CAST(chunk_no AS INTEGER) AS chunk_no, src AS source_desc,
           {sql_str(EXTRACT_HEAD)} || src || {sql_str(EXTRACT_BODY)} || chunk AS prompt
    FROM ({CHUNKS_SQL}) c
""")
def extract_prompt_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_prompts(spark, sf_dir)


def title_model(prompts):
    """Stand-in model: every non-empty line of the text that starts with a
    capital T is one project title; a text without any raises."""
    out = []
    for p in prompts:
        titles = [x for x in p.split("Text:\n", 1)[1].split("\n") if x.startswith("T")]
        if not titles:
            raise RuntimeError("nothing found")
        body = json.dumps([{"project_title": t, "funding_year": len(t)} for t in titles], ensure_ascii=False)
        out.append(f"```json\n{body}\n```")
    return out


@register("extract_records", f"""
    SELECT page_id, CAST(chunk_no AS INTEGER) AS chunk_no, t AS project_title,
           CAST(length(t) AS VARCHAR) AS funding_year
    FROM (SELECT page_id, chunk_no, unnest(list_filter(string_split(chunk, chr(10)), lambda t: starts_with(t, 'T'))) AS t
          FROM ({CHUNKS_SQL}) c) x
""")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured extraction end to end: chunk, prompt, call, strip, parse."""
    records, _ = INF.extract_records(_page_prompts(spark, sf_dir), "prompt", title_model)
    return records.select("page_id", "chunk_no", "project_title", "funding_year")


@register("extract_failures", f"""
    SELECT page_id, CAST(chunk_no AS INTEGER) AS chunk_no, 'RuntimeError: nothing found' AS error
    FROM ({CHUNKS_SQL}) c
    WHERE len(list_filter(string_split(chunk, chr(10)), lambda t: starts_with(t, 'T'))) = 0
""")
def extract_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failed = INF.extract_records(_page_prompts(spark, sf_dir), "prompt", title_model)
    return failed.select("page_id", "chunk_no", "error")


@register("scrape_blocks", """
    SELECT page_id, CAST(pos - 1 AS INTEGER) AS block_no,
           regexp_replace(b, '\\A\\s+|\\s+\\z', '', 'g') AS text
    FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos
          FROM (SELECT page_id, regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) AS bs
                FROM pages) x) y
""")
def scrape_blocks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return scrape_blocks(spark, pages, "ad")


# ------------------------------------------------------------ small parsers

BREAKDOWN_SQL = ("CAST(year(o_orderdate) AS VARCHAR) || ':' || CAST(CAST(floor(o_totalprice * 0.4) AS BIGINT) AS VARCHAR)"
                 " || ' ' || CAST(year(o_orderdate) + 1 AS VARCHAR) || ':' || "
                 "CAST(CAST(floor(o_totalprice) AS BIGINT) - CAST(floor(o_totalprice * 0.4) AS BIGINT) AS VARCHAR)")


@register("cost_breakdown", f"""
    SELECT o_orderkey, split_part(e, ':', 1) AS year, split_part(e, ':', 2) AS amount
    FROM (SELECT o_orderkey, unnest(string_split({BREAKDOWN_SQL}, ' ')) AS e FROM orders) x
""")
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    first = F.floor(F.col("o_totalprice") * 0.4).cast("bigint")
    rest = F.floor("o_totalprice").cast("bigint") - first
    s = F.concat(y.cast("string"), F.lit(":"), first.cast("string"), F.lit(" "),
                 (y + 1).cast("string"), F.lit(":"), rest.cast("string"))
    return o.select("o_orderkey", F.explode_outer(T.cost_breakdown(s)).alias("year", "amount")) \
            .filter(F.col("year").isNotNull())


KEYWORDS_SQL = "o_orderpriority || ' / ' || o_orderstatus || ' / ' || CAST(year(o_orderdate) AS VARCHAR)"


@register("keyword_list", f"""
    SELECT o_orderkey, CAST(pos - 1 AS INTEGER) AS pos, kw AS keyword
    FROM (SELECT o_orderkey, unnest(ks) AS kw, generate_subscripts(ks, 1) AS pos
          FROM (SELECT o_orderkey, string_split({KEYWORDS_SQL}, ' / ') AS ks FROM orders) x) y
""")
def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.concat_ws(" / ", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", F.posexplode_outer(T.keyword_list(s)).alias("pos", "keyword")) \
            .filter(F.col("pos").isNotNull())


FLAG_SQL = """CASE WHEN event_id % 7 = 0 THEN NULL
                   WHEN event_type = 'signup' THEN 'Yes' WHEN event_type = 'purchase' THEN 'TRUE'
                   WHEN event_type = 'error' THEN 'no' WHEN event_type = 'click' THEN 't'
                   ELSE '0' END"""


def _flag_text() -> Column:
    t = F.col("event_type")
    return (F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
            .when(t == "signup", "Yes").when(t == "purchase", "TRUE")
            .when(t == "error", "no").when(t == "click", "t").otherwise("0"))


@register("truthy_flag", f"""
    SELECT event_id, f AS flag_text, coalesce(lower(f) IN ('true', '1', 'yes', 'y', 't'), false) AS flag
    FROM (SELECT event_id, {FLAG_SQL} AS f FROM events) x
""")
def truthy_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    f = _flag_text()
    return e.select("event_id", f.alias("flag_text"), truthy(f).alias("flag"))


# ------------------------------------------------------- examples and prompts

def _examples_sql() -> str:
    firsts = ", ".join(f'"{c}"' for c in LANDING_COLUMNS)
    nn = ", ".join(f'arg_min("{c}", row_no) FILTER (WHERE "{c}" IS NOT NULL) AS nn{i}'
                   for i, c in enumerate(LANDING_COLUMNS))
    arms = []
    for i, c in enumerate(LANDING_COLUMNS):
        prefix = " AND ".join(f"(f).f{j} IS NOT NULL" for j in range(i + 1))
        arms.append(f"SELECT source_id, '{c}' AS column_name, CAST({i} AS BIGINT) AS ord, "
                    f"nn{i} AS example_first_non_null, "
                    f"CASE WHEN {prefix} THEN (f).f{i} END AS example_reference FROM agg")
    struct = ", ".join(f'f{i} := "{c}"' for i, c in enumerate(LANDING_COLUMNS))
    del firsts
    return (f"WITH g AS ({LANDING_SQL}), agg AS (SELECT source_id, "
            f"arg_min(struct_pack({struct}), row_no) AS f, {nn} FROM g GROUP BY source_id) "
            + " UNION ALL ".join(arms))


EXAMPLES_SQL = _examples_sql()


def examples_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.column_examples(landing_frame(spark, sf_dir), "source_id", "row_no", LANDING_COLUMNS)


@register("column_examples", EXAMPLES_SQL)
def column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples_frame(spark, sf_dir)


def _hash_sql() -> str:
    lits = ", ".join(sql_str(c) for c in LANDING_COLUMNS)
    return f"md5(array_to_string(list_sort([{lits}]), ','))"


@register("mapping_prompt", f"""
    WITH e AS ({EXAMPLES_SQL}),
    lines AS (
      SELECT source_id, string_agg(CASE WHEN example_first_non_null IS NOT NULL
                                        THEN '* ' || column_name || ': ' || example_first_non_null
                                        ELSE '* ' || column_name END, chr(10) ORDER BY ord) AS cl
      FROM e GROUP BY source_id)
    SELECT source_id, {_hash_sql()} AS columns_hash,
           {sql_str(MAPPING_HEAD)} || source_id || {sql_str(MAPPING_COLUMNS)} || cl
           || {sql_str(MAPPING_VOCAB)} || {sql_str(vocabulary_lines())} || {sql_str(MAPPING_TAIL)} AS prompt
    FROM lines
""")
def mapping_prompt_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.examples_map(examples_frame(spark, sf_dir), "source_id")
    return per.select(
        "source_id", M.dataset_columns_hash(LANDING_COLUMNS).alias("columns_hash"),
        mapping_prompt(F.col("source_id"), column_lines(F.col("columns"), F.col("examples")))
        .alias("prompt"))
