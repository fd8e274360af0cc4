"""Prompt text for the column-mapping and page-extraction model calls.

Prompts are assembled as Column expressions (one per dataset / page), so
they are built where the data is and travel to the model function inside
the same task.  Template wording is our own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantflow.functions.text import RECORD_FIELDS
from grantflow.schema import vocabulary_rows

MAPPING_HEAD = (
    "You align the columns of a research-grant dataset with a grant vocabulary.\n\n"
    "Dataset: "
)
MAPPING_COLUMNS = "\n\nColumns, with an example value where one is known:\n"
MAPPING_VOCAB = "\n\nVocabulary, one field per line (field: description (limits)):\n"
MAPPING_TAIL = (
    "\n\nReply with a single JSON object that maps every column name to one "
    "vocabulary field, or to \"null\" when no field fits. Reply with the JSON "
    "object only."
)

EXTRACT_HEAD = "The text below was taken from the website of "
EXTRACT_BODY = (
    ", a page that lists funded projects or grants.\n"
    "Return a JSON array with one object per project, using the fields "
    + ", ".join(RECORD_FIELDS)
    + " and any other field you find; use null where a value is unknown. "
    "Return the JSON array only.\n\nText:\n"
)


def vocabulary_lines() -> str:
    """``- field: description (limits)`` per vocabulary key, in vocabulary order."""
    return "\n".join(f"- {k}: {d} ({lim})" for _, k, d, lim in vocabulary_rows())


def column_lines(columns: Column, examples: Column) -> Column:
    """``* col: example`` (or ``* col`` when no example) per column, newline-joined.

    ``columns`` is array<string>; ``examples`` a map<string,string>.
    """
    def line(c):
        ex = F.element_at(examples, c)
        return F.when(ex.isNotNull(), F.concat(F.lit("* "), c, F.lit(": "), ex)) \
                .otherwise(F.concat(F.lit("* "), c))
    return F.array_join(F.transform(columns, line), "\n")


def mapping_prompt(source: Column, col_lines: Column) -> Column:
    return F.concat(F.lit(MAPPING_HEAD), source, F.lit(MAPPING_COLUMNS), col_lines,
                    F.lit(MAPPING_VOCAB), F.lit(vocabulary_lines()), F.lit(MAPPING_TAIL))


def extract_prompt(source_desc: Column, text: Column) -> Column:
    return F.concat(F.lit(EXTRACT_HEAD), source_desc, F.lit(EXTRACT_BODY), text)
