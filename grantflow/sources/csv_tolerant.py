"""Tolerant CSV reading for landed datasets.

Records come from :mod:`grantflow.sources.csv_records`: files are split, also
where quoted fields hold line breaks.  Layouts are data, not plans: the header
record of each file gives a row of names, joined to the file's records, whose
fields are an array by position.  A folder of a thousand headers is one scan
and a plan of constant size.

* :func:`read_records` gives the fields by position with the layout,
  :func:`read_mapped` a map from name to value, :func:`read_tolerant_csv` the
  columns of all layouts;
* a record with a value beyond its header has its whole text in ``__overflow``
  and is quarantined instead of silently skipped; short records are padded with
  nulls;
* files that are not valid UTF-8 are read as ISO-8859-1, header included;
* ``header_row`` skips that many lines at the start of each file;
  ``quote=""`` reads without quoting;
* records are never recognised by content: one that equals the header, or has
  no value at all, is kept; blank lines are not records;
* :func:`sniff_dialect` finds each file's delimiter and quote character from
  all of its records; :func:`verify_files` gives the per-file verdict of the
  fallback ladder.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantflow.functions.text import na_to_null
from grantflow.session import staged
from grantflow.sources.catalog import dedupe_names
from grantflow.sources.csv_records import Quoting, Records, file_path

OVERFLOW = "__overflow"
DELIMITERS = [",", ";", "\t", "|"]
QUOTES = ['"', "'"]
#: Share of a file's records that must agree on the number of a delimiter.
AGREEING = 0.9


def fields_of(header: str, sep: str, quote: str = '"') -> list[str]:
    """Fields of a header record."""
    dialect = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    return next(csv.reader(io.StringIO(header, newline=""), delimiter=sep, **dialect), [])


def read_layouts(records: Records, sep: str, quote: str) -> DataFrame:
    """file, names (repeated ones ``a, a.1``) of every file whose header has
    a field; the others have no columns to map and are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [dedupe_names(fields_of(h, sep, quote)) for h in pdf["text"]]
            yield pd.DataFrame({"file": pdf["file"], "names": names})

    rows = records.headers().select("file", "text").mapInPandas(parse, "file string, names array<string>")
    return staged(rows.where(F.exists("names", lambda n: F.trim(n) != "")), "csv-layouts")


def _fields(text: Column, sep: str, quote: str, width: int) -> Column:
    """Fields by position, ``width`` of them, missing and empty ones null."""
    options = {"sep": sep, "mode": "PERMISSIVE", "quote": quote, "escape": quote or "\\", "multiLine": "true"}
    parsed = F.from_csv(text, ", ".join(f"c{i} string" for i in range(width)), options)
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def _surplus(text: Column, sep: str, quote: str, width: Column) -> Column:
    """Whether a field beyond ``width`` is not empty."""
    bare = Quoting(sep, quote).bare(text) if quote else text
    parts = F.split(bare, F.lit(f"[{sep}]") if sep != "\\" else F.lit(r"\\"), F.lit(-1))
    return (F.size(parts) > width) & F.exists(F.slice(parts, width + 1, F.greatest(F.size(parts) - width, F.lit(0))),
                                              lambda x: F.trim(x) != "")


def _parsed(found: Records, layouts: DataFrame, sep: str, quote: str) -> DataFrame:
    """Every record with its layout's columns, ``fields`` by position and ``surplus``."""
    width = layouts.agg(F.max(F.size("names"))).first()[0] or 1
    rows = found.rows.where(F.col("line") > found.header_row).join(layouts, "file")
    return rows.select("file", "line", "text", *[c for c in layouts.columns if c != "file"],
                       _fields(F.col("text"), sep, quote, width).alias("fields"),
                       _surplus(F.col("text"), sep, quote, F.size("names")).alias("surplus"))


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",", header_row: int = 0,
                 quote: str | None = None, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(layouts, records)``: file and names of every layout; and of every
    record its file, line, text, names, ``fields`` by position and ``surplus``."""
    quote = '"' if quote is None else quote
    found = Records(spark, path, sep, quote, header_row, multiline)
    layouts = read_layouts(found, sep, quote)
    return layouts, _parsed(found, layouts, sep, quote)


def read_mapped(spark: SparkSession, path: str | list[str], sep: str = ",", header_row: int = 0,
                quote: str | None = None, multiline: bool = True) -> DataFrame:
    """file, line, ``values`` (name to value, NA tokens and missing ones null)
    and overflow of every record: a plan that does not grow with the layouts."""
    _, rows = read_records(spark, path, sep, header_row, quote, multiline)
    values = F.transform(F.slice("fields", F.lit(1), F.size("names")), na_to_null)
    return rows.select(F.col("file").alias("__file"), "line", F.map_from_arrays("names", values).alias("values"),
                       F.when(F.col("surplus"), F.col("text")).alias(OVERFLOW))


def read_tolerant_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header_row: int = 0,
                      quote: str | None = None, multiline: bool = True, na_exempt: tuple[str, ...] = ()) -> DataFrame:
    """Landed CSV files -> all-string rows + ``__overflow`` + ``__file``.

    The columns are those of all layouts, in the order they first occur by
    file name.  Each layout's row says where in its files' fields a column is,
    so a column is one look-up, whatever the number of layouts.
    """
    quote = '"' if quote is None else quote
    found = Records(spark, path, sep, quote, header_row, multiline)
    layouts = read_layouts(found, sep, quote)
    named = layouts.select("file", F.posexplode("names").alias("pos", "name"))
    # Distinct names, as the schema of the result needs them.
    first = named.groupBy("name").agg(F.min(F.struct("file", "pos")).alias("first")).orderBy("first").collect()
    names = [r.name for r in first]
    if not names:
        return spark.createDataFrame([], f"`{OVERFLOW}` string, __file string")
    slots = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: (F.array_position("names", n) - 1).cast("int"))
    places = staged(layouts.select("file", "names", slots.alias("slots")), "csv-places")
    raw = F.transform("slots", lambda i: F.get("fields", F.nullif(i, F.lit(-1))))
    rows = _parsed(found, places, sep, quote).select(
        raw.alias("raw"), F.transform(raw, na_to_null).alias("values"),
        F.when(F.col("surplus"), F.col("text")).alias(OVERFLOW), F.col("file").alias("__file"))
    return rows.select(*[F.get("raw" if n in na_exempt else "values", F.lit(i)).alias(n) for i, n in enumerate(names)],
                       OVERFLOW, "__file")


def split_overflow(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, over-long rows quarantined)."""
    bad = F.col(OVERFLOW).isNotNull()
    return df.filter(~bad).drop(OVERFLOW), df.filter(bad)


def overflow_counts(df: DataFrame) -> DataFrame:
    """Per file its rows and its over-long rows."""
    return df.groupBy("__file").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count_if(F.col(OVERFLOW).isNotNull()).alias("n_overflow"))


def sniff_quotes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, quote: the quote character with most complete fields (between
    delimiters or line ends) in the lines of a file; ``"`` where none has."""
    some = "".join(DELIMITERS).replace("\t", "\\t")
    count = [F.sum(F.regexp_count("value", F.lit(f"(?:^|[{some}]){q}[^{q}]*+{q}(?=[{some}\r]|$)"))).alias(f"q{i}")
             for i, q in enumerate(QUOTES)]
    per = spark.read.option("lineSep", "\n").text(path) \
        .groupBy(file_path().alias("file")).agg(*count)
    return per.select("file", F.when(F.col("q1") > F.col("q0"), QUOTES[1]).otherwise(QUOTES[0]).alias("quote"))


def sniff_dialect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file ``path, delimiter, quote, share``.

    Delimiters inside quoted fields, of one line or several, are not counted.
    Of the delimiters that occur, the one with the same number in most records
    (ties: the more frequent one in a record, then the listed order).
    ``delimiter`` is null, for the quarantine, where fewer than ``AGREEING`` of
    the records agree.  A file whose quotes don't close is judged line by line.
    """
    quotes = {q: [r.file for r in rows] for q, rows in _by(sniff_quotes(spark, path).collect(), "quote").items()}
    out = None
    for q, files in quotes.items():                        # as many as there are quote characters
        dialect = Quoting("".join(DELIMITERS), q)
        records = Records(spark, files, "".join(DELIMITERS), q).rows
        bare = F.when(F.col("by_line"), F.col("text")).otherwise(dialect.bare(F.col("text")))
        rows = records.select(F.col("file").alias("path"), bare.alias("bare"))
        found = rows.select("path", F.explode(F.array(*[
            F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"),
                     (F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit("")))).alias("n"))
            for i, d in enumerate(DELIMITERS)])).alias("x")).select("path", "x.*")
        per = found.groupBy("path", "rank", "delimiter", "n").agg(F.count(F.lit(1)).alias("records"))
        best = per.where("n > 0").groupBy("path").agg(
            F.max_by(F.struct("delimiter", "records"), F.struct("records", "n", -F.col("rank"))).alias("b"))
        total = per.where("rank = 0").groupBy("path").agg(F.sum("records").alias("total"))
        share = F.coalesce(F.col("b.records"), F.lit(0)) / F.col("total")
        told = total.join(best, "path", "left").select(
            "path", F.when(share >= AGREEING, F.col("b.delimiter")).alias("delimiter"), F.lit(q).alias("quote"),
            share.alias("share"))
        out = told if out is None else out.unionAll(told)
    if out is None:
        return spark.createDataFrame([], "path string, delimiter string, quote string, share double")
    return staged(out, "csv-dialects")


def _by(rows: list, *keys: str) -> dict:
    out = defaultdict(list)
    for r in rows:
        out[r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)].append(r)
    return out


def read_sniffed(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all files, each read with its own dialect; files without one).
    The plan has an arm per dialect, eight at most."""
    sniffed = sniff_dialect(spark, path)
    out = None
    for (sep, quote), files in _by(sniffed.where("delimiter IS NOT NULL").collect(), "delimiter", "quote").items():
        rows = read_tolerant_csv(spark, [f.path for f in files], sep=sep, quote=quote)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], f"`{OVERFLOW}` string, __file string")
    return out, sniffed.where("delimiter IS NULL").select("path", "share")


def verify_files(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Per-file verdict of the read ladder, the first rung that gives rows:

    ``strict`` (no bad rows) > ``skip_bad`` (over-long rows skipped) >
    ``quote_none`` (quotes don't close: read without quoting) > ``sniffed``
    (one header field: another dialect fits) > ``unparsed_nonempty`` (bytes
    but no rows).  ``success`` is true for every non-empty file;
    ``verification_passed`` only when rows were parsed.  Zero-byte files
    are skipped by Spark's file listing and so get no row (= not a success).
    """
    records = Records(spark, path, sep)
    layouts = read_layouts(records, sep, '"').select("file", F.size("names").alias("n_fields"))
    facts = staged(records.files.join(layouts, "file", "left"), "csv-facts")
    other = staged(sniff_dialect(spark, path).select(F.col("path").alias("file"), "delimiter", "quote"), "csv-other")
    rung = F.when(F.col("by_line"), F.struct(F.lit("quote_none").alias("rung"), F.lit(sep).alias("sep"),
                                             F.lit("").alias("quote")))
    rung = rung.when((F.coalesce("n_fields", F.lit(0)) < 2) & (F.coalesce("delimiter", F.lit(sep)) != sep),
                     F.struct(F.lit("sniffed").alias("rung"), F.col("delimiter").alias("sep"), F.col("quote").alias("quote")))
    rung = rung.otherwise(F.struct(F.lit("plain").alias("rung"), F.lit(sep).alias("sep"), F.lit('"').alias("quote")))
    ways = facts.join(other, "file", "left").select("file", rung.alias("r")).select("file", "r.*")
    counts = spark.createDataFrame([], "__file string, n_rows long, n_overflow long, rung string")
    for (name, d, q), files in _by(ways.collect(), "rung", "sep", "quote").items():     # ten at most
        rows = read_tolerant_csv(spark, [f.file for f in files], sep=d, quote=q)
        counts = counts.unionByName(overflow_counts(rows).withColumn("rung", F.lit(name)))
    listing = (spark.read.format("binaryFile").load(path)
               .select(F.col("path").alias("__file"), F.col("length").alias("n_bytes")))
    utf8 = facts.select(F.col("file").alias("__file"), (~F.col("latin1")).alias("utf8_ok"))
    j = listing.join(counts, "__file", "left").join(utf8, "__file", "left")
    n_rows, n_overflow = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_overflow", F.lit(0))
    verdict = (F.when(n_rows == 0, "unparsed_nonempty").when(F.col("rung") != "plain", F.col("rung"))
               .when(n_overflow == 0, "strict").otherwise("skip_bad"))
    return j.select(F.col("__file").alias("path"), "n_bytes", n_rows.alias("n_rows"), n_overflow.alias("n_overflow"),
                    F.coalesce("utf8_ok", F.lit(True)).alias("utf8_ok"), verdict.alias("verdict"),
                    (F.col("n_bytes") > 0).alias("success"), (n_rows > 0).alias("verification_passed"))
