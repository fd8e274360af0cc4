"""HTML -> readable text as Column expressions.

Equivalent to an HTML parser walk that drops ``script``/``style``, strips
each text node, drops empty nodes and joins the rest with ``\\n``: every tag,
comment or doctype ends a text node, so splitting on tags after blanking
scripts, styles, comments and doctypes yields the same nodes.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantflow.functions.text import STRIP_RE

# The common references of text, ``&amp;`` last so that
# ``&amp;lt;`` becomes ``&lt;`` and not ``<``.
ENTITIES = [
    ("&lt;?", "<"),
    ("&gt;?", ">"),
    ("&quot;?", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&nbsp;?", "\u00a0"),
    ("&copy;?", "©"),
    ("&middot;?", "·"),
    ("&amp;?", "&"),
]

SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE_RE = r"(?is)<style\b[^>]*>.*?</style\s*>"
COMMENT_RE = r"(?s)<!--.*?-->"
DOCTYPE_RE = r"(?i)<!doctype[^>]*>"
# A quoted attribute value may hold ">"; a "<" before anything but a name is text.
TAG_RE = r"""</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>|<[?!][^>]*>"""
# The same without backtracking into the parts of a tag, for Java's engine.
JAVA_TAG_RE = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[?!][^>]*+>"""
# A reference that is not one of ENTITIES, spelled out.
OTHER_ENTITY_RE = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|#39|#x27);)[A-Za-z#]"
# What HTML5 takes for a reference.
REFERENCE_RE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that need no semicolon, also at the beginning of a longer word.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Code points 0x80-0x9F mean those of windows-1252.
WINDOWS = bytes(range(0x80, 0xA0))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(c: Column) -> Column:
    for pattern, repl in ENTITIES:
        c = F.regexp_replace(c, pattern, repl)
    return c


def _character(number: Column) -> Column:
    """The character of a numeric reference."""
    control = number.between(1, 31) & ~number.isin(9, 10, 12, 13) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF) \
        | (number == 11) | (number % 0x10000 >= 0xFFFE)
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    old = F.create_map(*[x for b in WINDOWS for x in (F.lit(b), F.lit(_windows(b)))])
    return (F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
            .when(number == 13, "\r").when(number.between(0x80, 0x9F), F.try_element_at(old, number.cast("int")))
            .when(control, "").otherwise(wide))


def _windows(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:                 # five bytes have no meaning there
        return chr(byte)


def _decode_reference(part: Column, names: Column) -> Column:
    """A text that holds one ``&``, its first character: the reference at its
    beginning decoded.  A name is looked up whole, then by the longest of the
    names without a semicolon that it begins with."""
    ref = F.regexp_extract(part, REFERENCE_RE, 1)
    rest = F.substr(part, F.length(ref) + 2)
    digits = F.regexp_extract(ref, "^#([0-9]+)", 1)
    hexes = F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]+)", 1)
    number = (F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 9, F.lit(0x110000))
              .when(digits != "", digits.try_cast("bigint"))
              .when(F.length(hexes) > 8, F.lit(0x110000)).otherwise(F.conv(hexes, 16, 10).try_cast("bigint")))
    start = F.regexp_extract(ref, "^(" + "|".join(OPEN_NAMES) + ")", 1)
    whole = F.try_element_at(names, ref)
    named = F.when(whole.isNotNull(), whole).when(start != "", F.concat(
        F.try_element_at(names, start), F.substr(ref, F.length(start) + 1))).otherwise(F.concat(F.lit("&"), ref))
    return F.when(ref == "", part).when(ref.startswith("#"), F.concat(_character(number), rest)) \
        .otherwise(F.concat(named, rest))


def decode_all_references(c: Column) -> Column:
    """Every named and numeric reference of HTML5 decoded."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")        # a constant
    parts = F.split(c, "(?=&)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), _decode_reference(p, names)).otherwise(p)), "")


def text_nodes(html: Column | str) -> Column:
    """Array of stripped, non-empty text nodes outside script/style.

    Pages whose references are all common ones take a few replacements; the
    table of all names is for the others.
    """
    h = _col(html)
    rare = h.rlike(OTHER_ENTITY_RE)
    for pattern in (SCRIPT_RE, STYLE_RE, COMMENT_RE, DOCTYPE_RE):
        h = F.regexp_replace(h, pattern, "<x>")
    parts = F.split(h, JAVA_TAG_RE)
    parts = F.when(rare, F.transform(parts, decode_all_references)).otherwise(F.transform(parts, decode_entities))
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, STRIP_RE, "")), lambda t: t != "")


def html_to_text(html: Column | str) -> Column:
    """Readable page text, one text node per line."""
    return F.array_join(text_nodes(html), "\n")
