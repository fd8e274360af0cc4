"""Date and age helpers (ANSI-safe: every parse is a ``try_`` form)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantflow.schema import PERIOD_SEPARATOR

MICROS_PER_DAY = 86_400_000_000.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """Strict ``%Y-%m-%d`` parse; malformed or impossible dates -> null.

    ``yyyy-M-d`` accepts ``2024-7-1`` like ``strptime`` does and still
    rejects Feb 30 and trailing text.
    """
    return F.try_to_date(_col(c), "yyyy-M-d")


def period_parts(c: Column | str) -> Column:
    """The period split on the spaced en dash (array of strings)."""
    return F.split(_col(c), PERIOD_SEPARATOR)


def split_period(c: Column | str) -> Column:
    """``"start – end"`` -> struct(start_date, end_date, period_ok).

    Exactly two parts are required; any other count gives two nulls and
    ``period_ok = false`` (the row is then quarantined with a reason).
    Literal-string functions only (no per-row regex): the part count is the
    separator count plus one.
    """
    col = _col(c)
    sep = F.lit(PERIOD_SEPARATOR)
    n_sep = (F.length(col) - F.length(F.replace(col, sep, F.lit("")))) / len(PERIOD_SEPARATOR)
    ok = F.coalesce(n_sep == 1, F.lit(False))
    return F.struct(
        F.when(ok, parse_date(F.substring_index(col, PERIOD_SEPARATOR, 1))).alias("start_date"),
        F.when(ok, parse_date(F.substring_index(col, PERIOD_SEPARATOR, -1))).alias("end_date"),
        ok.alias("period_ok"),
    )


def as_of_literal(as_of: _dt.datetime | str) -> Column:
    """An explicit reference time; operators never read ``now()`` themselves."""
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def age_days(ts: Column | str, as_of: Column) -> Column:
    """Exact age in days of ``ts`` at ``as_of`` (double, unrounded).

    Both sides are wall-clock (``timestamp_ntz``) so the session time zone
    never shifts the result.
    """
    t = _col(ts).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", t, as_of.cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(MICROS_PER_DAY)


def is_fresh(ts: Column | str, as_of: Column, max_age_days: float = 7,
             force: bool = False) -> Column:
    """Fresh when ``age <= max_age`` (inclusive); unknown time -> not fresh."""
    fresh = F.coalesce(age_days(ts, as_of) <= F.lit(float(max_age_days)), F.lit(False))
    return fresh & F.lit(not force)


def display_ts(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a timestamp."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def parse_ts(c: Column | str) -> Column:
    """ISO-8601 text -> wall-clock timestamp; unparsable -> null."""
    return F.try_to_timestamp(_col(c)).cast("timestamp_ntz")
