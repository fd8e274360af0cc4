"""Identifier, path and flag helpers (all Column -> Column, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantflow.schema import TRUTHY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def clean_source_id(c: Column | str) -> Column:
    """Space -> ``_``, then keep Unicode letters, digits and ``_``; null -> ``''``."""
    spaced = F.replace(F.coalesce(_col(c), F.lit("")), F.lit(" "), F.lit("_"))
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", "")


def source_id_by_name(source_name: Column | str, action: Column | str) -> Column:
    """Id rule 1: ``clean(source_name) + '-' + clean(action)``.

    A missing action leaves the trailing ``-`` (kept as the reference does).
    """
    return F.concat(clean_source_id(source_name), F.lit("-"), clean_source_id(action))


def source_id_by_funder(funder: Column | str, source_name: Column | str,
                        source_type: Column | str, action: Column | str) -> Column:
    """Id rule 2: aggregators by source name, others by funder[-action].

    Only spaces become ``_``; nothing else is removed.  Null parts count as
    empty (null-safe where the reference breaks on a missing action).
    """
    def under(x):
        return F.replace(F.coalesce(_col(x), F.lit("")), F.lit(" "), F.lit("_"))

    act = F.coalesce(_col(action), F.lit(""))
    return (
        F.when(F.lower(F.coalesce(_col(source_type), F.lit(""))) == "aggregator", under(source_name))
        .when(act != "", F.concat(under(funder), F.lit("-"), under(action)))
        .otherwise(under(funder))
    )


def parser_type(fmt: Column | str) -> Column:
    """Parser chosen from the declared format (case-insensitive)."""
    f = F.lower(F.coalesce(_col(fmt), F.lit("")))
    return (
        F.when(f == "csv", "standard_csv")
        .when(f.isin("excel", "xlsx", "xls"), "excel")
        .when(f == "api", "api")
        .when(f == "html", "html")
        .otherwise("standard_csv")
    )


def columns_hash(cols: Column | str) -> Column:
    """Schema identity: md5 of the code-point-sorted column names joined by ``,``."""
    return F.md5(F.array_join(F.array_sort(_col(cols)), ","))


def url_filename(url: Column | str, source_id: Column | str, action: Column | str,
                 fmt: Column | str) -> Column:
    """Last path segment of the URL, else ``<id>[_action].<ext>`` (excel -> xlsx)."""
    path = F.try_parse_url(_col(url), F.lit("PATH"))
    name = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0), F.lit(""))
    f = F.lower(F.coalesce(_col(fmt), F.lit("")))
    ext = F.when(f == "excel", F.lit("xlsx")).otherwise(f)
    act = F.coalesce(_col(action), F.lit(""))
    stem = F.when(act != "", F.concat(_col(source_id), F.lit("_"), act)).otherwise(_col(source_id))
    return F.when(name != "", name).otherwise(F.concat(stem, F.lit("."), ext))


def truthy(c: Column | str) -> Column:
    """``true/1/yes/y/t`` (any case) -> true; anything else, null included -> false."""
    return F.coalesce(F.lower(_col(c)).isin(*TRUTHY), F.lit(False))


def source_description(funder: Column | str, action: Column | str) -> Column:
    """``"funder - action"`` when there is an action, else the funder."""
    act = F.coalesce(_col(action), F.lit(""))
    return F.when(act != "", F.concat_ws(" - ", _col(funder), act)).otherwise(_col(funder))


def raw_path(root: str, source_name: Column | str, action: Column | str) -> Column:
    """Landing folder ``root/name[/action]``; a blank action is left out."""
    act = _col(action)
    return F.concat_ws("/", F.lit(root), _col(source_name),
                       F.when(act.rlike(r"\S"), act))


def run_key(source_id: Column | str, action: Column | str) -> Column:
    """``source[_action]``."""
    return F.concat_ws("_", _col(source_id), F.nullif(_col(action), F.lit("")))


def run_label(ts: Column | str) -> Column:
    """Run folder label ``YYYYmmdd_HHMMSS``."""
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")
