"""Polymorphic JSON: landed files, generic API pages, project-API pages.

Everything is Column work over the JSON text (``from_json`` with string
leaves keeps nested values as raw JSON text; ``json_object_keys`` keeps
document key order, which the file rule depends on) or over ``VARIANT``
for the project API whose leaves are either scalars or ``{"$": value}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantflow.functions.text import py_strip
from grantflow.session import staged

PAGE_SIZE = 100          # records per project-API page


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_char(text: Column) -> Column:
    return F.substring(py_strip(text), 1, 1)


def _as_list(text: Column) -> Column:
    """JSON array text -> array of element JSON texts (else null)."""
    return F.when(_first_char(text) == "[", F.from_json(text, "array<string>"))


def _get_path(text: Column, path: Column) -> Column:
    """``get_json_object`` with a per-row path."""
    return F.call_function("get_json_object", text, path)


def _member(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$['{key}']")


def file_records(text: Column | str) -> Column:
    """A landed JSON file -> array of record JSON texts.

    list -> its elements; object -> the first non-empty list value in key
    order, else the object itself as one record; scalar -> one record.
    """
    t = _col(text)
    # Members by their own JSON type, so a string that looks like a list is
    # not one; keys are looked up in a map, so no key needs quoting in a path.
    members = F.from_json(t, "map<string,variant>")
    lists = F.transform(F.json_object_keys(t), lambda k: F.transform(
        F.try_variant_get(F.element_at(members, k), "$", "array<variant>"), lambda v: F.to_json(v)))
    lists = F.filter(lists, lambda a: F.coalesce(F.size(a) > 0, F.lit(False)))
    first = _first_char(t)
    return (F.when(first == "[", F.from_json(t, "array<string>"))
            .when(first == "{", F.coalesce(F.get(lists, 0), F.array(t)))
            .otherwise(F.array(t)))


def api_records(text: Column | str) -> Column:
    """A generic API page -> array of record JSON texts.

    list -> elements; object with a list under ``data`` -> it (an empty
    list yields nothing and stops the fall-through); else ``results``;
    else the object as one record; a scalar page yields nothing.
    """
    t = _col(text)
    first = _first_char(t)
    data, results = _as_list(_member(t, "data")), _as_list(_member(t, "results"))
    return (F.when(first == "[", F.from_json(t, "array<string>"))
            .when(first == "{", F.coalesce(data, results, F.array(t)))
            .otherwise(F.array().cast("array<string>")))


def _truthy_json(v: Column) -> Column:
    """Python truthiness of a JSON value given as text (null/false/0/""/[]/{} are false)."""
    s = py_strip(v)
    return F.coalesce(~s.isin("null", "false", "0", "0.0", '""', "[]", "{}", ""), F.lit(False))


def api_has_more(text: Column | str) -> Column:
    """Continuation flag of an API page: ``next`` truthy or ``has_more`` truthy."""
    t = _col(text)
    obj = _first_char(t) == "{"
    return obj & (_truthy_json(_member(t, "next")) | _truthy_json(_member(t, "has_more")))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed ``.json`` files (``metadata.json`` excluded) -> one row per record.

    A single JSON document cannot be split, so each file is one task; files
    of one run spread over the cluster.
    """
    files = (spark.read.option("wholetext", True).text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
             .filter(~F.col("path").endswith("/metadata.json")))
    return files.select("path", F.posexplode_outer(file_records("text")).alias("row_no", "record")) \
                .filter(F.col("row_no").isNotNull())


def discover_schema(records: DataFrame, text: str = "record") -> str:
    """Struct DDL that fits all JSON objects of a text column: one pass, each
    task merges the fields it sees and the merged schemas meet in a tree.

    Whole numbers are ``bigint`` (longer ones decimal), other numbers
    ``double``; a field that is always null, or has values of different kinds,
    is text (of a nested value: its JSON).  Texts that are no JSON object, and
    columns without any, add no fields.
    """
    found = F.schema_of_variant_agg(F.try_parse_json(text))
    ddl = records.where(_first_char(F.col(text)) == "{").agg(found.alias("s")).first()[0] or ""
    if not ddl.startswith("OBJECT<"):
        return ""
    # Outside quoted names; a name is followed by a colon.
    parts = re.split(r"(`(?:[^`]|``)*`)", ddl)
    for pattern, kind in ((r"\bOBJECT<>", "STRING"), (r"\bOBJECT<", "STRUCT<"), (r"\b(?:VOID|VARIANT)\b(?!:)", "STRING"),
                          (r"\bDECIMAL\(\d+,[1-9]\d*\)", "DOUBLE")):
        parts[::2] = [re.sub(pattern, kind, p) for p in parts[::2]]
    return "".join(parts)


def flatten_records(records: DataFrame, text: str = "record") -> DataFrame:
    """JSON records of unknown schema -> the other columns and dotted leaf
    columns of all fields that any record has.  A record that is no object has
    none of them and stays in ``__record``."""
    keep = [c for c in records.columns if c != text]
    ddl = discover_schema(records, text)
    is_object = _first_char(F.col(text)) == "{"
    odd = F.when(is_object, F.lit(None).cast("string")).otherwise(F.col(text)).alias("__record")
    if not ddl:
        return records.select(*keep, odd)
    parsed = F.when(is_object, F.from_json(text, ddl)).alias("__value")
    rows = records.select(*[F.col(f"`{c}`").alias(f"__keep.{c}") for c in keep], odd, parsed)
    flat = flatten_columns(rows)
    name = {f"__keep.{c}": c for c in keep}
    return flat.select(*[F.col(f"`{c}`").alias(name.get(c, c.removeprefix("__value."))) for c in flat.columns])


def flatten_columns(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted leaf columns (``a.b.c``); arrays kept as JSON text."""
    cols: list[Column] = []

    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
            return
        ref = F.col(".".join(f"`{p}`" for p in path))
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            ref = F.to_json(ref)
        cols.append(ref.alias(sep.join(path)))

    walk(df.schema, [])
    return df.select(*cols)


def read_json_flat(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON-lines records -> dotted flat columns.  Without a schema the fields
    of all files are merged first (:func:`discover_schema`)."""
    if schema is None:
        schema = discover_schema(spark.read.text(path), "value")
        schema = T.DataType.fromDDL(schema) if schema else "value string"
    return flatten_columns(spark.read.schema(schema).json(path))


# ---------------------------------------------------------------- project API

def _leaf(v: Column, key: str) -> Column:
    """``{"$": x}`` -> x; scalar -> its text; missing or other object -> ''."""
    return F.coalesce(F.try_variant_get(v, f"$['{key}']['$']", "string"),
                      F.try_variant_get(v, f"$['{key}']", "string"), F.lit(""))


def _present(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant").isNotNull()


def project_results(body: Column | str) -> Column:
    """``response.results.result`` as array<variant>: a list as is, a single
    non-empty object as one element, anything else as empty."""
    v = F.try_parse_json(_col(body))
    path = "$.response.results.result"
    as_list = F.try_variant_get(v, path, "array<variant>")
    single = F.try_variant_get(v, path, "variant")
    is_obj = F.coalesce(F.schema_of_variant(single).startswith("OBJECT<"), F.lit(False))
    return F.coalesce(as_list, F.when(is_obj, F.array(single)),
                      F.array().cast("array<variant>"))


def project_total(body: Column | str) -> Column:
    """``response.header.total``: number, numeric string, ``{"$": n}`` or the
    first value (document order) of another object; a missing total counts
    as 0; anything unparsable -> null (unknown)."""
    t = F.get_json_object(_col(body), "$.response.header.total")
    is_obj = _first_char(t) == "{"
    first_key = F.get(F.json_object_keys(t), 0)
    from_obj = F.coalesce(
        F.get_json_object(t, "$['$']"),
        _get_path(t, F.concat(F.lit("$['"), first_key, F.lit("']"))),
        F.lit("0"))
    raw = F.when(t.isNull(), F.lit("0")).when(is_obj, from_obj).otherwise(t)
    return _int_like(raw)


def _int_like(raw: Column) -> Column:
    """``int()`` of integer text; anything else (``"12.5"``, words) -> null."""
    digits = F.regexp_extract(raw, r"^\s*[+-]?\d+\s*$", 0)
    return F.when(digits != "", F.trim(digits).try_cast("bigint"))


def project_fields(p: Column) -> Column:
    """One project (variant) -> struct(code, acronym, title, start_date,
    end_date, funder, raw_id).  Metadata may sit under
    ``oaf:entity.oaf:project``; dates are null when the key is absent; funder
    names join with ``"; "`` without empty names.  A project whose metadata is
    no object has only its ``raw_id`` (its id, or ``unknown``)."""
    meta0 = F.try_variant_get(p, "$.metadata", "variant")
    wrapped = F.try_variant_get(meta0, "$['oaf:entity']", "variant")
    none = F.parse_json(F.lit("{}"))
    meta = F.when(wrapped.isNotNull(), F.coalesce(F.try_variant_get(wrapped, "$['oaf:project']", "variant"), none)) \
        .otherwise(F.coalesce(meta0, none))
    usable = F.schema_of_variant(meta).startswith("OBJECT<")
    funders_list = F.try_variant_get(meta, "$.fundingtree.funder", "array<variant>")
    funder_one = F.try_variant_get(meta, "$.fundingtree.funder", "variant")
    names = F.transform(funders_list, lambda f: _leaf(f, "shortname"))
    funder = F.when(funders_list.isNotNull(), F.array_join(F.filter(names, lambda n: n != ""), "; ")) \
              .when(funder_one.isNotNull(), _leaf(funder_one, "shortname"))
    raw_id = F.coalesce(F.try_variant_get(p, "$.id", "string"), F.lit("unknown"))
    return F.struct(
        F.when(usable, _leaf(meta, "code")).alias("code"),
        F.when(usable, _leaf(meta, "acronym")).alias("acronym"),
        F.when(usable, _leaf(meta, "title")).alias("title"),
        F.when(usable & _present(meta, "startdate"), _leaf(meta, "startdate")).alias("start_date"),
        F.when(usable & _present(meta, "enddate"), _leaf(meta, "enddate")).alias("end_date"),
        F.when(usable, funder).alias("funder"),
        F.when(~usable, raw_id).alias("raw_id"),
    )


def project_pages(pages: DataFrame, source: str = "source", page: str = "page",
                  body: str = "body") -> DataFrame:
    """Per landed page: item count, announced total and pages, and two flags:
    ``after_empty`` (a page of the source before it had no items) and
    ``beyond_announced`` (its number is above the announced page count).

    The flags report; no landed page is dropped for them.  Bodies are parsed
    once: the small per-page row is staged, and the per-source facts are
    aggregates joined back on the source.
    """
    per = staged(pages.select(source, page, F.size(project_results(body)).alias("n_items"),
                              project_total(body).alias("total")), "project-pages")
    facts = per.groupBy(source).agg(
        F.min(F.when(F.col("n_items") == 0, F.col(page))).alias("__stop"),
        F.min(F.when(F.col(page) == 1, F.ceil(F.col("total") / F.lit(PAGE_SIZE)))).cast("bigint")
         .alias("expected_pages"))
    # A zero or unknown page count announces nothing.
    announced = F.when(F.col("expected_pages") > 0, F.col("expected_pages"))
    return per.join(facts, source).select(
        source, page, "n_items", "total", "expected_pages",
        F.coalesce(F.col(page) > F.col("__stop"), F.lit(False)).alias("after_empty"),
        F.coalesce(F.col(page) > announced, F.lit(False)).alias("beyond_announced"))


def flatten_projects(pages: DataFrame, source: str = "source", page: str = "page",
                     body: str = "body") -> DataFrame:
    """Every landed page -> one flat row per project."""
    # posexplode_outer + filter keeps the optimizer from inferring (and
    # pushing down) a size() filter that would parse every body twice.
    return pages.select(source, page, F.posexplode_outer(project_results(body)).alias("pos", "p")) \
                .filter(F.col("pos").isNotNull()) \
                .select(source, page, "pos", project_fields(F.col("p")).alias("f")) \
                .select(source, page, "pos", "f.*")


def sources_with_more(pages: DataFrame, source: str = "source", page: str = "page",
                      body: str = "body") -> DataFrame:
    """Per source: landed pages, last page and ``incomplete``, true where the
    last landed page still announces more (``next`` / ``has_more``)."""
    last = F.max(F.struct(F.col(page).alias("p"), F.coalesce(api_has_more(body), F.lit(False)).alias("more")))
    return (pages.groupBy(source).agg(F.count(F.lit(1)).alias("n_pages"), last.alias("x"))
            .select(source, "n_pages", F.col("x.p").alias("last_page"), F.col("x.more").alias("incomplete")))
