"""Text helpers: names, null tokens, model-response cleanup, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantflow.schema import NA_TOKENS

# Characters Python's ``str.strip()`` removes (ASCII whitespace, the
# information separators, NEL and every Unicode separator).  Written so
# both Java regex and RE2 read it the same way.
WS_CLASS = r"[\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
STRIP_RE = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"

# Record fields asked of the extraction model, in prompt order.
RECORD_FIELDS = [
    "project_title", "principal_investigator", "institution", "funding_amount",
    "funding_year", "duration", "description", "research_area",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels(*flags: Column) -> Column:
    """array<string> of the non-null labels among ``flags`` (each a
    ``when(cond, 'label')``), built with codegen-friendly ``concat_ws`` +
    ``split`` instead of a lambda filter.  Labels must not contain ``,``."""
    joined = F.concat_ws(",", *flags)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def py_strip(c: Column | str) -> Column:
    """Strip leading/trailing whitespace the way Python's ``strip()`` does."""
    return F.regexp_replace(_col(c), STRIP_RE, "")


def na_to_null(c: Column | str) -> Column:
    """Map the CSV reader's default missing-value tokens to SQL NULL."""
    col = _col(c)
    return F.when(col.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def split_name(c: Column | str) -> Column:
    """First two single-space-separated tokens as (given_name, family_name).

    Fewer than two tokens -> both null.  A double space yields ``''`` as the
    second token, exactly like ``str.split(" ")``.
    """
    parts = F.split(_col(c), " ")
    two = F.coalesce(F.size(parts) > 1, F.lit(False))
    return F.struct(
        F.when(two, F.get(parts, 0)).alias("given_name"),
        F.when(two, F.get(parts, 1)).alias("family_name"),
    )


def strip_fences(c: Column | str) -> Column:
    """Remove a leading ```` ```json ```` or ```` ``` ```` and a trailing ```` ``` ````."""
    s = py_strip(c)
    s = F.regexp_replace(s, r"\A```(json)?", "")
    s = F.regexp_replace(s, r"```\z", "")
    return py_strip(s)


def strip_fences_braces(c: Column | str) -> Column:
    """Fence strip, then make sure the text starts with ``{`` and ends with ``}``."""
    s = strip_fences(c)
    s = F.when(s.startswith("{"), s).otherwise(F.concat(F.lit("{"), s))
    return F.when(s.endswith("}"), s).otherwise(F.concat(s, F.lit("}")))


def extract_fenced_json(c: Column | str) -> Column:
    """Body of the first ```` ```json\\n … \\n``` ```` block; none -> null."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)```json\n(.*?)\n```", 1), F.lit(""))


def parse_mapping(c: Column | str) -> Column:
    """JSON object text -> ``map<string,string>``; non-objects and garbage -> null.

    Nested values stay JSON text; a JSON ``null`` target becomes ``"null"``.
    """
    m = F.from_json(_col(c), "map<string,string>")
    return F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("null")))


def parse_records(c: Column | str) -> Column:
    """JSON array-of-objects text -> ``array<map<string,string>>`` (garbage -> null)."""
    return F.from_json(_col(c), "array<map<string,string>>")


def response_text(c: Column | str) -> Column:
    """Chat-completion envelope -> first choice's message text (default ``''``)."""
    return F.coalesce(F.get_json_object(_col(c), "$.choices[0].message.content"), F.lit(""))


def cost_breakdown(c: Column | str) -> Column:
    """``"2024:780000 2025:2080000"`` -> ``map<year, amount-text>``."""
    return F.str_to_map(_col(c), F.lit(" "), F.lit(":"))


def keyword_list(c: Column | str) -> Column:
    """Slash-separated keywords -> array."""
    return F.split(_col(c), " / ")


def truncate(c: Column | str, max_chars: int) -> Column:
    """First ``max_chars`` characters (characters, not bytes)."""
    return F.substring(_col(c), 1, max_chars)


def is_truncated(c: Column | str, max_chars: int) -> Column:
    return F.length(_col(c)) > F.lit(max_chars)
