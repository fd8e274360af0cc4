"""Queries over column mappings and model calls."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.ids import columns_hash
from grantflow.operators import inference as INF
from grantflow.operators import mapping as M
from grantflow.operators.conform import compound_targets, drop_all_null_rows, rename_by_mapping
from grantflow.plans.frames import LANDING_COLUMNS, LANDING_SQL, landing_frame, table
from grantflow.plans.registry import register
from grantflow.plans.report import portable
from grantflow.schema import vocabulary_rows
from grantflow.session import scratch_dir

# ------------------------------------------------------------ schema identity

LAYOUT_SQL = """
    SELECT 'src_' || CAST(user_id AS VARCHAR) AS source, list_sort(list(DISTINCT event_type)) AS cols
    FROM events GROUP BY user_id
"""
DATASETS_SQL = f"""
    SELECT source, md5(array_to_string(cols, ',')) AS columns_hash, cols FROM ({LAYOUT_SQL}) l
"""


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its column layout: the distinct event types of its events
    (a bounded set, combined map-side before the shuffle)."""
    e = table(spark, sf_dir, "events")
    return (e.select(F.concat(F.lit("src_"), F.col("user_id").cast("string")).alias("source"),
                     "event_type").distinct()
             .groupBy("source").agg(F.collect_list("event_type").alias("cols")))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("source", columns_hash("cols").alias("columns_hash"), "cols")


@register("columns_hash", f"""
    SELECT source, CAST(len(cols) AS INTEGER) AS n_columns, columns_hash FROM ({DATASETS_SQL}) d
""")
def columns_hash_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets(spark, sf_dir).select("source", F.size("cols").alias("n_columns"), "columns_hash")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = datasets(spark, sf_dir)
    even = F.substring_index("source", "_", -1).cast("bigint") % 2 == 0
    return d.filter(even).select("source", "columns_hash")


CACHE_SQL = f"""SELECT source, columns_hash FROM ({DATASETS_SQL}) d
                WHERE CAST(split_part(source, '_', 2) AS BIGINT) % 2 = 0"""


@register("mapping_cache_hit", f"""
    SELECT source, columns_hash FROM ({DATASETS_SQL}) d
    WHERE (source, columns_hash) IN (SELECT (source, columns_hash) FROM ({CACHE_SQL}) c)
""")
def mapping_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = M.cache_split(datasets(spark, sf_dir).drop("cols"), _cache(spark, sf_dir))
    return hits


@register("mapping_cache_miss", f"""
    SELECT source, columns_hash FROM ({DATASETS_SQL}) d
    WHERE (source, columns_hash) NOT IN (SELECT (source, columns_hash) FROM ({CACHE_SQL}) c)
""")
def mapping_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, misses = M.cache_split(datasets(spark, sf_dir).drop("cols"), _cache(spark, sf_dir))
    return misses


# ------------------------------------------------------------ validation

VOCAB_KEYS = [k for _, k, _, _ in vocabulary_rows()]
N_SLOTS = len(VOCAB_KEYS) + 5


def _synthetic_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-style mapping rows: each conversation turn maps ``col_<turn>``
    to a vocabulary key, ``"null"``, or an unknown name."""
    c = table(spark, sf_dir, "conversations")
    idx = ((F.col("conv_id") * 7 + F.col("turn")) % N_SLOTS).cast("int")
    key = F.get(F.array(*[F.lit(k) for k in VOCAB_KEYS]), idx)
    target = F.coalesce(key, F.when(idx == N_SLOTS - 1, F.lit("null"))
                        .otherwise(F.concat(F.lit("award-"), idx.cast("string"))))
    return c.select("conv_id", F.concat(F.lit("col_"), F.col("turn").cast("string")).alias("source_col"),
                    target.alias("target_col"))


def _targets_sql() -> str:
    keys = ", ".join("'" + k + "'" for k in VOCAB_KEYS)
    return f"""
    SELECT conv_id, 'col_' || CAST(turn AS VARCHAR) AS source_col,
           coalesce([{keys}][idx + 1], CASE WHEN idx = {N_SLOTS - 1} THEN 'null'
                    ELSE 'award-' || CAST(idx AS VARCHAR) END) AS target_col
    FROM (SELECT conv_id, turn, CAST((conv_id * 7 + turn) % {N_SLOTS} AS INTEGER) AS idx
          FROM conversations) c
    """


ALLOWED_SQL = "(" + ", ".join("'" + k + "'" for k in VOCAB_KEYS + ["null"]) + ")"


@register("mapping_validate", f"SELECT * FROM ({_targets_sql()}) t WHERE target_col IN {ALLOWED_SQL}")
def mapping_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = M.validate_mapping(spark, _synthetic_targets(spark, sf_dir))
    return valid


@register("mapping_rejects", f"SELECT * FROM ({_targets_sql()}) t WHERE target_col NOT IN {ALLOWED_SQL}")
def mapping_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = M.validate_mapping(spark, _synthetic_targets(spark, sf_dir))
    return rejected


# ------------------------------------------------------------ mapping store

def _rule_a(c):
    return (F.when(c == "purchase", "award-amount").when(c == "signup", "award-start-date")
            .otherwise("null"))


def _rule_b(c):
    return F.when(c == "purchase", "@amount").otherwise("description")


@register("mapping_store", f"""
    SELECT source, columns_hash, c AS source_col,
           CASE WHEN CAST(split_part(source, '_', 2) AS BIGINT) % 2 = 0
                THEN CASE WHEN c = 'purchase' THEN '@amount' ELSE 'description' END
                ELSE CASE WHEN c = 'purchase' THEN 'award-amount'
                          WHEN c = 'signup' THEN 'award-start-date' ELSE 'null' END END AS target_col
    FROM (SELECT source, columns_hash, unnest(cols) AS c FROM ({DATASETS_SQL}) d) x
""")
def mapping_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings appended twice (second load re-maps even sources); latest wins."""
    path = scratch_dir(spark, "column_mappings")
    rows = datasets(spark, sf_dir).select("source", "columns_hash",
                                          F.explode("cols").alias("source_col"))
    first = rows.withColumn("target_col", _rule_a(F.col("source_col"))) \
                .withColumn("ts", F.lit(_dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    even = F.substring_index("source", "_", -1).cast("bigint") % 2 == 0
    second = rows.filter(even).withColumn("target_col", _rule_b(F.col("source_col"))) \
                 .withColumn("ts", F.lit(_dt.datetime(2024, 2, 1)).cast("timestamp_ntz"))
    M.save_mappings(first, path)
    M.save_mappings(second, path)
    return M.latest_mappings(spark.read.parquet(path)).drop("ts")


# ------------------------------------------------------------ rename / compound

RENAME = {"Research Project Title": "project-title", "Project/Area Number": "award-number",
          "Total Cost (Overall)": "award-amount", "Keywords": "null"}


@register("rename_by_mapping", f"""
    SELECT row_no, source_id, "Research Project Title" AS "project-title",
           "Project Title (English)", "Project/Area Number" AS "award-number",
           "Project Period (FY)", "Principal Investigator", "Research Institution",
           "Total Cost (Overall)" AS "award-amount", "Keywords"
    FROM ({LANDING_SQL}) g
""")
def rename_by_mapping_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = drop_all_null_rows(landing_frame(spark, sf_dir))
    return rename_by_mapping(g, RENAME)


@register("compound_targets", f"""
    SELECT "Project/Area Number" AS grant_id,
           CASE WHEN len(pp) = 2 THEN strftime(CAST(try_strptime(pp[1], '%Y-%m-%d') AS DATE), '%Y-%m-%d') END AS start_date,
           CASE WHEN len(pp) = 2 THEN strftime(CAST(try_strptime(pp[2], '%Y-%m-%d') AS DATE), '%Y-%m-%d') END AS end_date,
           CASE WHEN len(np) > 1 THEN np[1] END AS investigator_given_name,
           CASE WHEN len(np) > 1 THEN np[2] END AS investigator_family_name
    FROM (SELECT *, string_split("Project Period (FY)", ' – ') AS pp,
                 string_split("Principal Investigator", ' ') AS np FROM ({LANDING_SQL}) g0) g1
""")
def compound_targets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = compound_targets(landing_frame(spark, sf_dir), "Project Period (FY)", "Principal Investigator")
    return portable(g.select(F.col("`Project/Area Number`").alias("grant_id"), "start_date",
                             "end_date", "investigator_given_name", "investigator_family_name"))


# ------------------------------------------------------------ model calls

def echo(prompts):
    """Stand-in model: answers each prompt with the prompt itself."""
    return list(prompts)


def fails_on_tenth(prompts):
    """Stand-in model that raises for prompts of documents whose id ends in 0."""
    out = []
    for p in prompts:
        if p.split("\n", 1)[0].endswith("0"):
            raise RuntimeError("model call failed")
        out.append(p)
    return out


CLEAN_HEAD = "Clean the text of document "
PROMPT_SQL = f"'{CLEAN_HEAD}' || CAST(doc_id AS VARCHAR) || chr(10) || text"


def _doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit(CLEAN_HEAD), F.col("doc_id").cast("string"),
                                       F.lit("\n"), F.col("text")).alias("prompt"))


@register("complete_batch", f"""
    SELECT doc_id, md5(p) AS response_md5, CAST(length(p) AS INTEGER) AS response_chars, 'ok' AS status
    FROM (SELECT doc_id, {PROMPT_SQL} AS p FROM documents) d
""")
def complete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = INF.outcome(INF.complete(_doc_prompts(spark, sf_dir), "prompt", echo))
    return out.select("doc_id", F.md5("response").alias("response_md5"),
                      F.length("response").alias("response_chars"), "status")


@register("isolate_failures", f"""
    SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE md5(p) END AS response_md5,
           CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'ok' END AS status
    FROM (SELECT doc_id, {PROMPT_SQL} AS p FROM documents) d
""")
def isolate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = INF.outcome(INF.complete(_doc_prompts(spark, sf_dir), "prompt", fails_on_tenth))
    return out.select("doc_id", F.md5("response").alias("response_md5"), "status")


# ------------------------------------------------------------ cache-first mapping

def layout_model(prompts):
    """Stand-in model for column mappings: amounts for purchases, a start date
    for signups, an unknown name for errors, no mapping for the rest; a prompt
    of a source whose number ends in 9 raises, one ending in 7 answers prose."""
    out = []
    for p in prompts:
        source, cols = p.split("\n")
        if source.endswith("9"):
            raise RuntimeError("model call failed")
        target = {"purchase": "award-amount", "signup": "award-start-date", "error": "award-x"}
        body = ", ".join(f'"{c}": "{target.get(c, "null")}"' for c in cols.split(","))
        out.append("no idea" if source.endswith("7") else "```json\n{" + body + "}\n```")
    return out


def _resolved(spark: SparkSession, sf_dir: str):
    d = datasets(spark, sf_dir)
    prompts = d.select("source", "columns_hash", F.concat_ws(
        "\n", "source", F.array_join(F.sort_array("cols"), ",")).alias("prompt"))
    even = F.substring_index("source", "_", -1).cast("bigint") % 2 == 0
    cache = d.filter(even).select("source", "columns_hash", F.explode("cols").alias("source_col")) \
        .withColumn("target_col", F.when(F.col("source_col") == "view", "no-such-field").otherwise("description"))
    return M.resolve_mappings(spark, prompts, cache, layout_model)


_RESOLVE_SQL = f"""
    SELECT source, columns_hash, c AS source_col,
           CASE WHEN CAST(split_part(source, '_', 2) AS BIGINT) % 2 = 0
                THEN CASE WHEN c = 'view' THEN 'no-such-field' ELSE 'description' END
                ELSE CASE c WHEN 'purchase' THEN 'award-amount' WHEN 'signup' THEN 'award-start-date'
                            WHEN 'error' THEN 'award-x' ELSE 'null' END END AS target_col
    FROM (SELECT source, columns_hash, unnest(cols) AS c FROM ({DATASETS_SQL}) d
          WHERE right(source, 1) NOT IN ('9', '7')) x
"""


@register("resolve_mappings", f"SELECT * FROM ({_RESOLVE_SQL}) m WHERE target_col IN {ALLOWED_SQL}")
def resolve_mappings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[0]


@register("resolve_rejects", f"SELECT * FROM ({_RESOLVE_SQL}) m WHERE target_col NOT IN {ALLOWED_SQL}")
def resolve_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[2]


@register("resolve_failures", f"""
    SELECT source, columns_hash, CASE WHEN right(source, 1) = '9' THEN 'RuntimeError: model call failed'
                                      ELSE 'the answer is not a mapping' END AS error
    FROM ({DATASETS_SQL}) d WHERE right(source, 1) IN ('9', '7')
""")
def resolve_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1]


STORED = [("Research Project Title", "project-title"), ("Project Title (English)", "project-title"),
          ("Project/Area Number", "award-number"), ("Research Institution", "institution"),
          ("Total Cost (Overall)", "award-amount"), ("Keywords", "description"),
          ("Principal Investigator", "null")]


@register("mapping_to_grants", f"""
    SELECT source_id, strftime(TIMESTAMP '2024-01-05 00:00:00', '%Y-%m-%d %H:%M:%S') AS run_ts,
           md5(array_to_string(list_sort([{", ".join("'" + c + "'" for c in LANDING_COLUMNS)}]), ',')) AS columns_hash,
           "Project/Area Number" AS grant_id, coalesce("Research Project Title", "Project Title (English)") AS project_title,
           "Keywords" AS project_description, "Research Institution" AS organization_name,
           CAST(TRY_CAST("Total Cost (Overall)" AS DECIMAL(20,2)) AS VARCHAR) AS amount
    FROM ({LANDING_SQL}) g
""")
def mapping_to_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored mapping (vocabulary keys) applied to the landed rows of its
    layout: crosswalk, typed flat rows, lineage."""
    path = scratch_dir(spark, "stored_mapping")
    ts = F.lit(_dt.datetime(2024, 1, 5)).cast("timestamp_ntz")
    g = landing_frame(spark, sf_dir).drop("row_no").withColumn("run_ts", ts)
    names = [c for c in g.columns if c not in ("source_id", "run_ts")]
    stored = g.select(F.col("source_id").alias("source")).distinct().select(
        "source", M.dataset_columns_hash(names).alias("columns_hash"),
        F.explode(F.create_map(*[F.lit(x) for pair in STORED for x in pair])).alias("source_col", "target_col"),
        ts.alias("ts"))
    M.save_mappings(stored, path)
    held = M.latest_mappings(spark.read.parquet(path))
    # The mapping of one layout: as many rows as it has columns.
    pairs = [(r.source_col, r.target_col) for r in held.where(
        F.col("columns_hash") == M.dataset_columns_hash(names)).select("source_col", "target_col").distinct().collect()]
    order = {c: i for i, c in enumerate(names)}
    rows = M.conform_mapped(g, sorted(pairs, key=lambda x: order[x[0]]), lineage=["source_id", "run_ts"])
    return portable(rows.select("source_id", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
                                "columns_hash", "grant_id", "project_title", "project_description",
                                "organization_name", "amount"))


#: Three layouts: the columns of each, where they come from, and the stored mapping.
LAYOUTS = {
    "alpha": [("Project/Area Number", "Project/Area Number", "award-number"), ("Title", "Research Project Title", "project-title"),
              ("Cost", "Total Cost (Overall)", "award-amount"), ("Person", "Principal Investigator", "null")],
    "beta": [("amount", "Total Cost (Overall)", "@amount"), ("title en", "Project Title (English)", "project-title"),
             ("title", "Research Project Title", "project-title"), ("no", "Project/Area Number", "award-number"),
             ("host", "Research Institution", "institution")],
    "gamma": [("Id", "Project/Area Number", "award-number"), ("Status", "Keywords", "description")],
    "delta": [("unknown id", "Project/Area Number", "award-number")],
}


def _layouts_sql() -> str:
    hashes = [f"md5(array_to_string(list_sort([{', '.join(repr(c) for c, _, _ in cols)}]), ','))" for cols in LAYOUTS.values()]
    pick = lambda xs: "CASE row_no % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    none = "NULL"
    return f"""
    SELECT {pick([f"'{s}'" for s in LAYOUTS])} AS source, {pick(hashes)} AS columns_hash,
           CASE WHEN row_no % 4 < 3 THEN "Project/Area Number" END AS grant_id,
           {pick(['"Research Project Title"', 'coalesce("Research Project Title", "Project Title (English)")', none, none])}
             AS project_title,
           CASE WHEN row_no % 4 = 2 THEN "Keywords" END AS project_description,
           CASE WHEN row_no % 4 = 1 THEN "Research Institution" END AS organization_name,
           CASE WHEN row_no % 4 < 2 THEN CAST(TRY_CAST("Total Cost (Overall)" AS DECIMAL(20,2)) AS VARCHAR) END AS amount,
           CASE WHEN row_no % 4 = 3 THEN 'layout_unmapped'
                WHEN row_no % 4 < 2 AND "Total Cost (Overall)" = 'TBD' THEN 'amount_invalid' ELSE '' END AS quarantine_reasons
    FROM ({LANDING_SQL}) g
    """


@register("layouts_to_grants", _layouts_sql())
def layouts_to_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four layouts, three with a stored mapping, in one job: fields
    by name, the mapping of the layout joined, one projection for all."""
    from grantflow.sources.csv_tolerant import read_mapped

    root, store = scratch_dir(spark, "layout_files"), scratch_dir(spark, "layout_mappings")
    g = landing_frame(spark, sf_dir)
    rest = F.col("row_no") % 4
    source, line, head = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, cols) in enumerate(LAYOUTS.items()):
        own = F.to_csv(F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, (_, c, _) in enumerate(cols)]))
        source = F.when(rest == i, name).otherwise(source)
        line = F.when(rest == i, own).otherwise(line)
        head = F.when(rest == i, ",".join(n for n, _, _ in cols)).otherwise(head)
    rows = g.select(source.alias("source"), F.lit(1).alias("place"), line.alias("line"), head.alias("head"))
    # A header on top of each file: one file per source and part.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(4)))
    heads = rows.select("source", "part", F.lit(0).alias("place"), F.col("head").alias("line")).distinct()
    (heads.unionByName(rows.drop("head")).repartition("source", "part").sortWithinPartitions("source", "part", "place")
     .select("source", "part", "line").write.partitionBy("source", "part").text(root))
    ts = F.lit(_dt.datetime(2024, 1, 5)).cast("timestamp_ntz")
    pairs = [(s, n, t) for s, cols in LAYOUTS.items() if s != "delta" for n, _, t in cols]
    stored = spark.createDataFrame(pairs, "source string, source_col string, target_col string")
    hashes = spark.createDataFrame([(s, [n for n, _, _ in cols]) for s, cols in LAYOUTS.items()],
                                   "source string, cols array<string>").select("source", columns_hash("cols").alias("columns_hash"))
    M.save_mappings(stored.join(hashes, "source").withColumn("ts", ts), store)
    landed = read_mapped(spark, root).select(
        F.regexp_extract("__file", "/source=([^/]+)/", 1).alias("source"),
        columns_hash(F.map_keys("values")).alias("columns_hash"), "values")
    feeds = M.layout_feeds(spark, M.latest_mappings(spark.read.parquet(store)))
    out = M.conform_layouts(landed, feeds)
    return portable(out.select("source", "columns_hash", "grant_id", "project_title", "project_description",
                               "organization_name", "amount", "quarantine_reasons"))
