"""Publish and serve the ``grants`` table.

Publishing is a partitioned parquet write with *dynamic* partition
overwrite: re-publishing one source replaces exactly its partition, so a
repeated load is idempotent and other sources are untouched.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.operators.quality import validate
from grantflow.session import staged

PARTITION_COL = "source_id"


def publish_grants(df: DataFrame, path: str, mode: str = "overwrite",
                   partitions: Sequence[str] = (PARTITION_COL,)) -> None:
    """Write ``grants`` partitioned by ``source_id`` (dynamic overwrite).

    Rows are rebalanced by source first: a source's rows meet in few tasks (a
    large one is split), so a load writes few files per source, each sorted by
    ``grant_id`` and with a bloom filter of it: a lookup by id reads the row
    groups that may hold the id, not one of every source.
    """
    (df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, "grant_id").write.mode(mode)
       .option("partitionOverwriteMode", "dynamic")
       .option("parquet.bloom.filter.enabled#grant_id", "true")
       .option("parquet.bloom.filter.adaptive.enabled", "true")
       .partitionBy(*partitions)
       .parquet(path))


def append_grants(df: DataFrame, path: str, key: Sequence[str] = (PARTITION_COL, "grant_id")) -> DataFrame:
    """Validate, then append the valid rows whose key the table does not hold
    yet; returns the rows that broke a rule (never written).

    The checked rows are staged, so the input is computed once, and running
    the same load again adds nothing.  Of rows of one load that share a key
    one is written; the others come back as ``key_repeated``.

    Keys and row numbers alone are grouped and compared; whole rows only meet
    the row numbers to leave out, or the new ones where those are fewer.
    """
    spark, key = df.sparkSession, [*key]
    rows = staged(validate(df).withColumn("__row", F.monotonically_increasing_id()), "append-checked")
    good, broken = rows.filter(F.size("violations") == 0), rows.filter(F.size("violations") > 0)
    keys = good.select(*key, "__row")
    more = staged(keys.groupBy(*key).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
                  .where("__n > 1").drop("__n"), "append-keys")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}"))
    repeated = staged(keys.alias("k").join(more.alias("m"), same).where("__row != __first").select("__row"), "append-repeated")
    again = good.join(repeated, "__row", "left_semi").withColumn("violations", F.array(F.lit("key_repeated")))
    good = good.join(repeated, "__row", "left_anti").drop("violations", "null_amount")
    try:
        held = spark.read.schema(good.drop("__row").schema).parquet(path).select(*key)
        new = staged(keys.join(held, key, "left_anti").select("__row"), "append-new")
        if 2 * new.count() <= keys.count():
            good = good.join(new, "__row", "left_semi")
        else:
            good = good.join(staged(keys.join(new, "__row", "left_anti").select("__row"), "append-held"), "__row", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    publish_grants(good.drop("__row"), path, mode="append")
    return broken.unionByName(again).drop("__row")


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    """``SELECT * FROM grants`` — partition pruning applies to ``source_id``."""
    return spark.read.parquet(path)


def grant_by_id(spark: SparkSession, grants: DataFrame, grant_id: str) -> DataFrame:
    """Parameterised lookup; the id is bound, never spliced into SQL text."""
    return spark.sql("SELECT * FROM {g} WHERE grant_id = :id", args={"id": grant_id}, g=grants)


@dataclass
class GrantSearch:
    """Conjunctive search filter.  Empty filter matches everything."""

    equals: dict[str, object] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)   # case-insensitive
    start_from: _dt.date | None = None                        # start_date >=
    start_to: _dt.date | None = None                          # start_date <=
    amount_min: float | None = None
    amount_max: float | None = None

    def predicate(self) -> Column:
        conds: list[Column] = []
        for c, v in self.equals.items():
            conds.append(F.col(c) == F.lit(v))
        for c, v in self.contains.items():
            conds.append(F.lower(F.col(c)).contains(v.lower()))
        if self.start_from is not None:
            conds.append(F.col("start_date") >= F.lit(self.start_from))
        if self.start_to is not None:
            conds.append(F.col("start_date") <= F.lit(self.start_to))
        if self.amount_min is not None:
            conds.append(F.col("amount") >= F.lit(self.amount_min))
        if self.amount_max is not None:
            conds.append(F.col("amount") <= F.lit(self.amount_max))
        out = F.lit(True)
        for c in conds:
            out = out & c
        return out


def search_grants(grants: DataFrame, search: GrantSearch) -> DataFrame:
    """Filter ``grants`` by a :class:`GrantSearch` (pushed to the scan)."""
    return grants.filter(search.predicate())


#: Text fields whose three-character pieces are kept beside the table.
SEARCHED = ["project_title", "project_description", "organization_name"]
PIECE = 3
#: So many candidates go to the scan as a list of ids; more are joined.
LISTED = 1000


def _pieces(text: Column) -> Column:
    """Distinct pieces of a lower-case text; none for shorter ones."""
    places = F.when(F.length(text) >= PIECE, F.sequence(F.lit(1), F.length(text) - (PIECE - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(PIECE))))


def _named(field: str):
    return lambda p: F.struct(F.lit(field).alias("field"), p.alias("piece"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grants with their pieces -> per batch a row for each piece: the ids that
    have it, as many as the batch has rows at most."""
    for batch in batches:
        found = batch.column("pieces")
        grant = pc.list_parent_indices(found)
        named = pc.list_flatten(found)
        flat = pa.table({c: batch.column(c).take(grant) for c in (PARTITION_COL, "grant_id")}
                        | {c: pc.struct_field(named, c) for c in ("field", "piece")})
        lists = flat.group_by([PARTITION_COL, "field", "piece"]).aggregate([("grant_id", "list")])
        lists = lists.rename_columns({"grant_id_list": "ids"}).select([PARTITION_COL, "field", "piece", "ids"])
        yield from lists.combine_chunks().to_batches()


def publish_index(df: DataFrame, path: str) -> None:
    """Write the pieces of the searched fields of a load, partitioned by source
    like the table itself: publishing a source again replaces its pieces.

    The searched fields are rebalanced by source, not their many pieces; a task
    lists the ids of each piece batch by batch.  The files are sorted by piece,
    so a search reads few row groups of each."""
    fields = [c for c in SEARCHED if c in df.columns]
    pieces = F.flatten(F.array(*[F.coalesce(
        F.transform(_pieces(F.lower(F.col(c))), _named(c)),
        F.array().cast("array<struct<field:string,piece:string>>")) for c in fields]))
    rows = df.select(PARTITION_COL, "grant_id", *fields).hint("rebalance", PARTITION_COL) \
        .select(PARTITION_COL, "grant_id", pieces.alias("pieces"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.mapInArrow(_postings, f"{PARTITION_COL} {kind[PARTITION_COL]}, field string, piece string, "
                                      f"ids array<{kind['grant_id']}>")
    (rows.sortWithinPartitions(PARTITION_COL, "piece", "field").write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("parquet.bloom.filter.enabled#piece", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
     .partitionBy(PARTITION_COL).parquet(path))


def search_indexed(grants: DataFrame, index: DataFrame, search: GrantSearch) -> DataFrame:
    """The rows of :func:`search_grants`, read by way of the index: only rows
    that hold every piece of every searched text are looked at, and checked.

    A text shorter than a piece, or of a field that is not indexed, narrows
    nothing.
    """
    terms = [(c, v.lower()) for c, v in search.contains.items() if c in SEARCHED and len(v.lower()) >= PIECE]
    wanted = {(c, v[i:i + PIECE]) for c, v in terms for i in range(len(v) - PIECE + 1)}
    if not wanted:
        return search_grants(grants, search)
    key = [PARTITION_COL, "grant_id"]
    has = [(F.col("field") == c) & (F.col("piece") == p) for c, p in sorted(wanted)]
    hit = F.lit(False)
    for field in {c for c, _ in wanted}:
        hit = hit | (F.col("field") == field) & F.col("piece").isin(sorted(p for c, p in wanted if c == field))
    found = index.where(hit).select(PARTITION_COL, *[x.alias(f"p{i}") for i, x in enumerate(has)],
                                    F.explode("ids").alias("grant_id"))
    found = found.groupBy(*key).agg(*[F.bool_or(f"p{i}").alias(f"p{i}") for i in range(len(has))]) \
        .where(" AND ".join(f"p{i}" for i in range(len(has))))
    found = staged(found.select(*key), "search-found")
    few = found.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        # Ids and sources go down to the scan: partitions, row groups, pages.
        ids, none = sorted({r.grant_id for r in few if r.grant_id is not None}), any(r.grant_id is None for r in few)
        own = F.col("grant_id").isin(ids) | (F.lit(none) & F.col("grant_id").isNull())
        rows = grants.where(F.col(PARTITION_COL).isin(sorted({r[0] for r in few if r[0] is not None}))
                            | F.col(PARTITION_COL).isNull()).where(own)
    else:
        rows = grants.alias("g").join(found.alias("f"), F.col(f"g.{PARTITION_COL}").eqNullSafe(F.col(f"f.{PARTITION_COL}"))
                                      & F.col("g.grant_id").eqNullSafe(F.col("f.grant_id")), "left_semi")
    return search_grants(rows, search)
