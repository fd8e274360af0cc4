"""Column mapping: schema identity, examples, validation, cache and store.

A dataset's schema identity is the md5 of its sorted column names.  The
mapping cache is a table of exploded rows ``(source, columns_hash,
source_col, target_col, ts)``; lookups are joins on ``(source,
columns_hash)``, so only cache misses ever reach the model function.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.ids import columns_hash
from grantflow.functions.text import labels
from grantflow.schema import CROSSWALK, GRANT_FIELDS, vocabulary_df
from grantflow.session import staged

CACHE_KEYS = ["source", "columns_hash"]


def dataset_columns_hash(columns: Sequence[str]):
    """md5 of the sorted column names of a layout, as a literal Column."""
    return columns_hash(F.array(*[F.lit(c) for c in columns]))


def column_examples(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Example value per (dataset, column) under both policies.

    * ``example_first_non_null`` — the value of the first row (by
      ``order``) where the column is not null;
    * ``example_reference`` — the first row's value, but only while no
      earlier column of that row was null (the collection stops at the
      first null column).

    One aggregation with map-side combine: each task keeps one candidate
    per dataset and column, so a huge dataset never gathers into a group.
    """
    cols = [F.col(f"`{c}`").cast("string") for c in columns]
    first = F.min_by(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), F.col(order))
    aggs = [first.alias("__first")]
    aggs += [F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"__nn{i}")
             for i, c in enumerate(cols)]
    g = df.groupBy(key).agg(*aggs)
    entries = []
    prefix_ok = F.lit(True)
    for i, name in enumerate(columns):
        v = F.col(f"__first.c{i}")
        prefix_ok = prefix_ok & v.isNotNull()
        entries.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(i).cast("bigint").alias("ord"),
            F.col(f"__nn{i}").alias("example_first_non_null"),
            F.when(prefix_ok, v).alias("example_reference")))
    return g.select(key, F.inline(F.array(*entries)))


def examples_map(examples: DataFrame, key: str, policy: str = "first_non_null") -> DataFrame:
    """Per dataset: ordered ``columns`` array and ``examples`` map.

    The number of entries per dataset is its column count (bounded by the
    layout, not by the rows)."""
    col = "example_first_non_null" if policy == "first_non_null" else "example_reference"
    return (examples.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("ord", "column_name", col))).alias("__e"))
            .select(key,
                    F.transform("__e", lambda e: e["column_name"]).alias("columns"),
                    F.map_from_entries(F.filter(
                        F.transform("__e", lambda e: F.struct(e["column_name"], e[col])),
                        lambda e: e[col].isNotNull())).alias("examples")))


def allowed_targets(spark: SparkSession) -> DataFrame:
    """Vocabulary keys plus the literal ``"null"`` (36 rows, fixed)."""
    vocab = vocabulary_df(spark).select(F.col("field").alias("target_col"))
    return vocab.union(spark.createDataFrame([("null",)], "target_col string"))


def validate_mapping(spark: SparkSession, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) mapping rows: the target must be a vocabulary key or
    ``"null"``.  The allowed set is fixed-size, so it is broadcast."""
    allowed = F.broadcast(allowed_targets(spark))
    return (mappings.join(allowed, "target_col", "left_semi"),
            mappings.join(allowed, "target_col", "left_anti"))


def explode_mapping(df: DataFrame, mapping_col: str = "mapping") -> DataFrame:
    """``map<source_col,target_col>`` -> one row per entry."""
    return df.select(*[c for c in df.columns if c != mapping_col],
                     F.explode_outer(mapping_col).alias("source_col", "target_col")) \
             .filter(F.col("source_col").isNotNull())


def cache_split(datasets: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of datasets against the mapping cache on (source, hash)."""
    keys = cache.select(*CACHE_KEYS).distinct()
    return (datasets.join(keys, CACHE_KEYS, "left_semi"),
            datasets.join(keys, CACHE_KEYS, "left_anti"))


def save_mappings(mappings: DataFrame, path: str) -> None:
    """Append exploded mapping rows; datasets with no entry are not saved."""
    mappings.filter(F.col("source_col").isNotNull()).write.mode("append").parquet(path)


def latest_mappings(store: DataFrame) -> DataFrame:
    """Latest-wins read: for each (source, hash) the rows of its newest ``ts``."""
    newest = store.groupBy(*CACHE_KEYS).agg(F.max("ts").alias("ts"))
    return store.join(newest, [*CACHE_KEYS, "ts"], "left_semi")


def resolve_mappings(spark: SparkSession, datasets: DataFrame, cache: DataFrame, fn):
    """Cache-first column mapping.

    ``datasets``: (source, columns_hash, prompt); ``cache``: exploded rows
    (source, columns_hash, source_col, target_col).  Only misses are sent
    to ``fn``; an unusable answer degrades to an empty mapping, is counted
    as failed and never saved.  Cached rows are validated too.

    Returns ``(mapping_rows, failed_datasets, rejected_rows)``.
    """
    from grantflow.functions.text import parse_mapping, strip_fences_braces
    from grantflow.operators.inference import complete

    hits, misses = cache_split(datasets, cache)
    # Staged: the three results read one set of answers, one call per prompt.
    answered = staged(complete(misses, "prompt", fn).drop("prompt").withColumn(
        "mapping", parse_mapping(strip_fences_braces(F.col("response")))), "mapping-answers")
    empty = F.col("mapping").isNull() | (F.size("mapping") == 0)
    failed = answered.filter(empty).select(*CACHE_KEYS, F.coalesce(
        "error", F.lit("the answer is not a mapping")).alias("error"))
    fresh = explode_mapping(answered.filter(F.size("mapping") > 0).select(*CACHE_KEYS, "mapping"))
    cached = cache.join(hits.select(*CACHE_KEYS), CACHE_KEYS, "left_semi") \
                  .select(*CACHE_KEYS, "source_col", "target_col")
    valid, rejected = validate_mapping(spark, fresh.unionByName(cached))
    return valid, failed, rejected


def crosswalked(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(source column, vocabulary key) pairs -> (source column, flat field),
    the best key of a field first; keys without a flat field are left out."""
    rank = {key: (field, i) for field, keys in CROSSWALK.items() for i, key in enumerate(keys)}
    found = [(rank[key][1], source, rank[key][0]) for source, key in pairs if key in rank]
    return [(source, field) for _, source, field in sorted(found, key=lambda x: x[0])]


def conform_mapped(df: DataFrame, pairs: Sequence[tuple[str, str]], policy: str = "coalesce",
                   lineage: Sequence[str] = ()) -> DataFrame:
    """One dataset layout -> flat grant rows through its stored mapping, with
    ``columns_hash`` and the given lineage columns.

    ``pairs`` are the mapping's rows for this layout (as many as it has
    columns); one projection types every row.
    """
    from grantflow.operators.conform import conform

    own = [c for c in df.columns if c not in lineage]
    return conform(df, crosswalked(pairs), policy, keep=lineage) \
        .withColumn("columns_hash", dataset_columns_hash(own))


def layout_feeds(spark: SparkSession, mappings: DataFrame) -> DataFrame:
    """Mapping rows (source, columns_hash, source_col, target_col) -> one row
    per layout with ``feeds``: flat field -> its source columns, those of the
    best vocabulary key first, of one key by name.  A layout has as many
    entries as columns."""
    rank = [(key, field, i) for field, keys in CROSSWALK.items() for i, key in enumerate(keys)]
    known = F.broadcast(spark.createDataFrame(rank, "target_col string, field string, rank int"))     # fixed size
    per = mappings.join(known, "target_col").groupBy(*CACHE_KEYS, "field").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "source_col"))), lambda x: x["source_col"]).alias("cols"))
    return per.groupBy(*CACHE_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("field", "cols"))).alias("feeds"))


def conform_layouts(rows: DataFrame, feeds: DataFrame, policy: str = "coalesce",
                    lineage: Sequence[str] = ()) -> DataFrame:
    """Rows of any number of layouts -> flat grant rows in one projection.

    ``rows``: source, columns_hash, ``values`` (column -> text) and lineage;
    ``feeds``: :func:`layout_feeds`.  The mapping travels with the row, so the
    plan does not grow with the layouts.  Policies and reasons as in
    :func:`~grantflow.operators.conform.conform`; a row whose layout has no
    mapping has the reason ``layout_unmapped``.
    """
    from grantflow.operators.conform import checked, typed

    rows = rows.join(feeds, CACHE_KEYS, "left")
    out, reasons = [], [F.when(F.col("feeds").isNull(), F.lit("layout_unmapped"))]
    for field, dtype in GRANT_FIELDS:
        texts = F.transform(F.try_element_at("feeds", F.lit(field)), lambda c: F.try_element_at("values", c))
        as_type = functools.partial(typed, field)
        value = F.transform(texts, lambda v: as_type(v))
        if policy == "coalesce":
            value = F.filter(value, lambda v: v.isNotNull())
        elif policy != "first_column":
            raise ValueError(f"unknown conform policy {policy!r}")
        out.append(F.get(value, F.lit(0)).cast(dtype).alias(field))
        if checked(field):
            bad = F.exists(texts, lambda v: v.isNotNull() & as_type(v).isNull())
            reasons.append(F.when(bad, F.lit(f"{field}_invalid")))
    return rows.select(*CACHE_KEYS, *lineage, *out, labels(*reasons).alias("quarantine_reasons"))
