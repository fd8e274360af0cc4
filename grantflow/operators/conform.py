"""Conform a landed (all-string) dataset to the flat grant schema.

One ``select`` per dataset layout: the mapping is resolved against the
columns on the driver (metadata only) and the rows are typed by Column
expressions, so conform is a narrow, codegen'd projection — no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantflow.functions.dates import parse_date, split_period
from grantflow.functions.text import labels, split_name
from grantflow.schema import AMOUNT_TYPE, GRANT_FIELDS, PERCENT_TYPE, PROTOTYPE_MAPPING

# Typed targets; any other target stays a string.
_DATE_FIELDS = {"start_date", "end_date"}


def typed(field: str, c: Column) -> Column:
    """The text of a flat field as the field's type, null where it has none."""
    if field in _DATE_FIELDS:
        return parse_date(c)
    if field == "amount":
        return c.try_cast(AMOUNT_TYPE)
    if field == "funding_percentage":
        return c.try_cast(PERCENT_TYPE)
    return c


def checked(field: str) -> bool:
    """Whether a text may be no value of the field."""
    return field in _DATE_FIELDS or field in ("amount", "funding_percentage")


def _pairs(mapping) -> list[tuple[str, object]]:
    if isinstance(mapping, Mapping):
        return list(mapping.items())
    return list(mapping)


def rename_by_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Plain rename ``source column -> target`` for the columns present."""
    present = {k: v for k, v in mapping.items() if k in df.columns and v and v != "null"}
    return df.withColumnsRenamed(present)


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Rows whose every column is null are dropped."""
    return df.na.drop("all")


def conform(df: DataFrame, mapping=PROTOTYPE_MAPPING, policy: str = "first_column",
            keep: Iterable[str] = ()) -> DataFrame:
    """Map source columns to the flat grant schema and type them.

    ``mapping`` is an ordered list (or dict) ``source column -> target``;
    a dict target is compound (period -> start/end, person -> given/family).
    Several source columns may feed one target:

    * ``first_column`` — the first listed source column present wins for
      the whole column (the reference prototype's rule);
    * ``coalesce`` — per row, the first non-null listed value wins.

    Adds ``quarantine_reasons`` (array<string>): values present in the
    source but not parseable.  ``keep`` passes lineage columns through.
    """
    cols = set(df.columns)
    feeds: dict[str, list[Column]] = {}
    reasons: list[Column] = []

    for source, target in _pairs(mapping):
        if source not in cols:
            continue
        src = F.col(f"`{source}`")
        if isinstance(target, Mapping):
            keys = set(target)
            if keys & {"start_date", "end_date"}:
                per = split_period(src)
                reasons.append(F.when(src.isNotNull() & ~per["period_ok"], F.lit("period_format")))
                for sub in ("start_date", "end_date"):
                    if sub in target:
                        feeds.setdefault(target[sub], []).append(per[sub])
                ok = per["period_ok"]
                reasons.append(F.when(ok & per["start_date"].isNull(), F.lit("start_date_invalid")))
                reasons.append(F.when(ok & per["end_date"].isNull(), F.lit("end_date_invalid")))
            else:
                name = split_name(src)
                for sub in ("given_name", "family_name"):
                    if sub in target:
                        feeds.setdefault(target[sub], []).append(name[sub])
        else:
            value = typed(target, src)
            feeds.setdefault(target, []).append(value)
            if checked(target):
                reasons.append(F.when(src.isNotNull() & value.isNull(), F.lit(f"{target}_invalid")))

    out: list[Column] = []
    for field, dtype in GRANT_FIELDS:
        sources = feeds.get(field)
        if not sources:
            value = F.lit(None).cast(dtype)
        elif policy == "coalesce":
            value = F.coalesce(*sources).cast(dtype)
        elif policy == "first_column":
            value = sources[0].cast(dtype)
        else:
            raise ValueError(f"unknown conform policy {policy!r}")
        out.append(value.alias(field))
    reason_arr = labels(*reasons) if reasons else F.array().cast("array<string>")
    return df.select(*[F.col(f"`{k}`") for k in keep], *out,
                     reason_arr.alias("quarantine_reasons"))


def split_quarantine(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows) by ``quarantine_reasons``; rows are never lost."""
    bad = F.size("quarantine_reasons") > 0
    return conformed.filter(~bad), conformed.filter(bad)


def quarantine_reason_counts(conformed: DataFrame) -> DataFrame:
    """``reason, n_rows`` over all quarantined rows (partial aggregation)."""
    # explode_outer + filter: a plain explode makes the optimizer infer a
    # size(...) > 0 filter and push the whole reason expression below joins.
    return (conformed.select(F.explode_outer("quarantine_reasons").alias("reason"))
            .filter(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows")))


def compound_targets(df: DataFrame, period_col: str, person_col: str) -> DataFrame:
    """One column feeding two fields each: period -> dates, person -> names."""
    per = split_period(F.col(f"`{period_col}`"))
    name = split_name(F.col(f"`{person_col}`"))
    return df.select(
        "*",
        per["start_date"].alias("start_date"),
        per["end_date"].alias("end_date"),
        name["given_name"].alias("investigator_given_name"),
        name["family_name"].alias("investigator_family_name"),
    )
