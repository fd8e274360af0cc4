"""Excel workbooks: first sheet of each landed file, read inside the tasks.

Spark has no Excel source, so each file's bytes go through ``mapInPandas``
to ``pandas.read_excel`` (first sheet).  The engine package (openpyxl) must
be installed on the executors; it is optional here, so the reader function
can be injected (tests pass their own).  Rows come out as
``(path, row_no, map<column, text>)`` — the column layout varies per file,
and :func:`to_columns` turns one layout into ordinary columns.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ExcelReader = Callable[[bytes], pd.DataFrame]

OUT_SCHEMA = "path string, row_no long, row map<string,string>, error string"


def default_reader(content: bytes) -> pd.DataFrame:
    """First sheet via pandas; needs openpyxl (xlsx) or xlrd (xls) installed."""
    return pd.read_excel(io.BytesIO(content), sheet_name=0, dtype=str)


def read_excel_files(spark: SparkSession, path: str, reader: ExcelReader = default_reader,
                     glob: str = "*.xls*") -> DataFrame:
    """Landed workbooks -> one row per sheet row; unreadable files give one
    row with ``error`` set instead of failing the job."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
             .select("path", "content"))

    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    sheet = reader(bytes(content))
                    cols = [str(c) for c in sheet.columns]
                    for i, rec in enumerate(sheet.itertuples(index=False, name=None)):
                        row = {c: (None if pd.isna(v) else str(v)) for c, v in zip(cols, rec)}
                        out.append((p, i, row, None))
                except Exception as e:  # noqa: BLE001 - one bad workbook never stops the run
                    out.append((p, -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "row_no", "row", "error"])

    return files.mapInPandas(run, OUT_SCHEMA)


def to_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Project one known layout out of the row maps (all strings)."""
    good = rows.filter(F.col("error").isNull())
    return good.select("path", "row_no", *[F.col("row")[c].alias(c) for c in columns])
