"""Source-catalog CSV reader and projection.

The catalog is read with a declared all-string schema built from its
header line (names de-duplicated the way the pandas reader does,
``a, a.1, a.2``), so nothing is inferred and every file parses the same.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantflow.functions.ids import (
    clean_source_id, parser_type, source_id_by_funder, source_id_by_name, truthy,
)
from grantflow.functions.text import na_to_null
from grantflow.schema import CATALOG_OPTIONAL, CATALOG_REQUIRED, CATALOG_STATUS_DEFAULT

# Columns whose literal "NA" is a value (Namibia), not a missing marker.
NA_EXEMPT = {"Country", "country_code"}

CATALOG_FIELDS = ["source_id", "funder", "action", "source_name", "country", "type",
                  "status", "web_link", "data_link", "format", "size", "notes",
                  "skip_ssl_verify", "parser"]


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated header names become ``name.1``, ``name.2`` … (never colliding)."""
    seen: dict[str, int] = {}
    taken = set(names)
    out = []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        k = seen[n]
        while True:
            k += 1
            cand = f"{n}.{k}"
            if cand not in taken:
                break
        seen[n] = k
        taken.add(cand)
        out.append(cand)
    return out


def header_names(spark: SparkSession, path: str, sep: str = ",",
                 encoding: str = "UTF-8", header_row: int = 0) -> list[str]:
    """Column names from the header of the first file under ``path``."""
    return dedupe_names(header_tokens(spark, path, sep, encoding, header_row))


def header_tokens(spark: SparkSession, path: str, sep: str = ",",
                  encoding: str = "UTF-8", header_row: int = 0) -> list[str]:
    """Raw fields of line ``header_row`` of the first file (reads only its first lines)."""
    lines = (spark.read.option("encoding", encoding).text(path)
             .filter(F.col("_metadata.file_path") == F.lit(_first_file(spark, path)))
             .limit(header_row + 1).collect())
    if len(lines) <= header_row:
        return []
    row = next(csv.reader(io.StringIO(lines[header_row][0]), delimiter=sep), [])
    return [c.strip("\ufeff") for c in row]


def _first_file(spark: SparkSession, path: str) -> str:
    files = (spark.read.format("binaryFile").load(path)
             .select("path").orderBy("path").limit(1).collect())
    return files[0][0] if files else ""


def string_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_catalog(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Catalog CSV -> all-string DataFrame, missing tokens -> null, + ``__ord``."""
    names = header_names(spark, path, sep)
    df = (spark.read.schema(string_schema(names))
          .option("header", True).option("enforceSchema", True)
          .option("sep", sep).option("multiLine", True).option("escape", '"')
          .csv(path).withColumn("__file", F.col("_metadata.file_path")))
    df = df.select("__file", *[(F.col(f"`{c}`") if c in NA_EXEMPT else na_to_null(F.col(f"`{c}`"))).alias(c)
                     for c in names])
    # Later files, and later rows of a file, win; a file is read by one task.
    return df.withColumn("__ord", F.struct("__file", F.monotonically_increasing_id())).drop("__file")


def missing_required(columns: list[str], required=CATALOG_REQUIRED) -> list[str]:
    """Required headers absent from ``columns`` (in required order)."""
    return [c for c in required if c not in columns]


def missing_required_col(present: Column, required=CATALOG_REQUIRED) -> Column:
    """Column form: ``array_except(required, present)``."""
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def _flag_column(columns: list[str]) -> str | None:
    """The skip-verify flag under any of its spellings (case/space/_ insensitive)."""
    for c in columns:
        if c.lower().replace(" ", "").replace("_", "") == "skipsslverify":
            return c
    return None


def project_catalog(df: DataFrame, id_rule: str = "name") -> DataFrame:
    """Catalog rows -> the 14 catalog fields.

    A default applies only when the *column is absent* (``status`` ->
    "Not started", flag -> false); a present-but-null value stays null.
    Rows without any id part are dropped; ``id_rule`` picks id rule 1
    (source name + action) or 2 (aggregator name / funder[-action]).
    """
    cols = set(df.columns)

    def col(name: str, default=None) -> Column:
        if name in cols:
            return F.col(f"`{name}`")
        return F.lit(default).cast("string")

    flag = _flag_column(df.columns)
    fmt = F.lower(col("Format"))
    if id_rule == "name":
        sid = source_id_by_name(col("Source_name"), col("Action"))
        has_id = (clean_source_id(col("Source_name")) != "") | (clean_source_id(col("Action")) != "")
    else:
        sid = source_id_by_funder(col("Funder"), col("Source_name"), col("Type"), col("Action"))
        has_id = sid != ""
    out = df.select(
        sid.alias("source_id"),
        col("Funder").alias("funder"), col("Action").alias("action"),
        col("Source_name").alias("source_name"), col("Country").alias("country"),
        col("Type").alias("type"), col("Status", CATALOG_STATUS_DEFAULT).alias("status"),
        col("Link to web").alias("web_link"), col("Link to dump").alias("data_link"),
        fmt.alias("format"), col("Size").alias("size"), col("Notes").alias("notes"),
        (truthy(F.col(f"`{flag}`")) if flag else F.lit(False)).alias("skip_ssl_verify"),
        parser_type(fmt).alias("parser"),
        (F.col("__ord") if "__ord" in cols else F.monotonically_increasing_id()).alias("__ord"),
        has_id.alias("__has_id"),
    )
    return out.filter("__has_id").drop("__has_id")


def last_wins(df: DataFrame, key: str = "source_id", order: str = "__ord") -> DataFrame:
    """Later rows overwrite earlier ones with the same key (dict semantics).

    An aggregation (max of ``(order, row)``), so a key repeated a million
    times is reduced map-side rather than sorted in one task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("__b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__b.{c}").alias(c) for c in rest])


def output_strings(df: DataFrame) -> DataFrame:
    """Nulls become ``""`` in string columns on output (``nan`` text too)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isNull() | (c == "nan"), F.lit("")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def catalog_from_rows(df: DataFrame, id_rule: str = "name") -> DataFrame:
    """Full catalog build: project, drop id-less rows, last wins, ordered fields."""
    return last_wins(project_catalog(df, id_rule)).select(*CATALOG_FIELDS)


__all__ = [
    "CATALOG_FIELDS", "CATALOG_OPTIONAL", "catalog_from_rows", "dedupe_names",
    "header_names", "last_wins", "missing_required", "missing_required_col",
    "output_strings", "project_catalog", "read_catalog",
]
