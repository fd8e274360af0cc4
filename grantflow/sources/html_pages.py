"""HTML pages: landing, readable text, and block scraping.

Readable text is pure Column work (:mod:`grantflow.functions.html`).  Block
scraping by CSS class needs a real tag tree (nesting), so it is an Arrow
function over the standard-library parser; it runs inside the task that
holds the page.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantflow.functions.html import html_to_text
from grantflow.functions.text import is_truncated, truncate

# Elements that never have content (no end tag).
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"}


class _BlockParser(HTMLParser):
    """Collects the text of elements with class ``row_cls``; when
    ``field_cls`` is given, only the first descendant with that class.

    Text nodes are stripped and empty ones dropped, then concatenated.
    """

    def __init__(self, row_cls: str, field_cls: str | None):
        super().__init__(convert_charrefs=True)
        self.row_cls, self.field_cls = row_cls, field_cls
        self.stack: list[str] = []
        self.row_level: int | None = None
        self.field_level: int | None = None
        self.field_done = False
        self.current: list[str] = []
        self.blocks: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        self.stack.append(tag)
        classes = (dict(attrs).get("class") or "").split()
        if self.row_level is None:
            if self.row_cls in classes:
                self.row_level, self.current, self.field_done = len(self.stack), [], False
        elif (self.field_cls is not None and self.field_level is None
              and not self.field_done and self.field_cls in classes):
            self.field_level = len(self.stack)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            depth = len(self.stack)
            top = self.stack.pop()
            if self.field_level == depth:
                self.field_level, self.field_done = None, True
            if self.row_level == depth:
                self.blocks.append("".join(self.current))
                self.row_level = None
            if top == tag:
                break

    def handle_data(self, data):
        if self.row_level is None or "script" in self.stack or "style" in self.stack:
            return
        if self.field_cls is None or self.field_level is not None:
            s = data.strip()
            if s:
                self.current.append(s)


def blocks_of(html: str | None, row_cls: str, field_cls: str | None) -> list[str]:
    if html is None or not row_cls:
        return []
    p = _BlockParser(row_cls, field_cls)
    p.feed(html)
    p.close()
    return p.blocks


def scrape_blocks(spark: SparkSession, pages: DataFrame, row_cls: str,
                  field_cls: str | None = None) -> DataFrame:
    """``pages(page_id, html)`` -> one row per block: page_id, block_no, text.

    Pages travel in Arrow batches; a page's blocks come back as one array and
    are exploded by Spark.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(html: pd.Series) -> pd.Series:
        return html.map(lambda h: blocks_of(h, row_cls, field_cls))

    return pages.select("page_id", F.posexplode_outer(found("html")).alias("block_no", "text")) \
                .filter(F.col("block_no").isNotNull())


def page_text(pages: DataFrame, max_chars: int = 32000) -> DataFrame:
    """Readable text per page plus the truncated text and its flag."""
    text = html_to_text(F.col("html"))
    return pages.select("*", text.alias("text")).select(
        "*", truncate("text", max_chars).alias("text_for_model"),
        is_truncated("text", max_chars).alias("truncated"))


def text_chunks(pages: DataFrame, max_chars: int = 32000) -> DataFrame:
    """Readable text per page in consecutive chunks of at most ``max_chars``
    characters: the input columns, ``chunk_no`` (from 0) and ``chunk``.  A
    chunk ends after the last line end within the limit; only a line that is
    longer than the limit is cut inside.  A page without text has one empty
    chunk."""
    text = pages.select("*", html_to_text(F.col("html")).alias("__text"))
    # The rest if it fits, else up to the last line end that does, else a piece of one line.
    piece = F.lit(rf"(?s).{{1,{max_chars}}}\z|.{{0,{max_chars - 1}}}\n|.{{{max_chars}}}")
    long = F.coalesce(F.length("__text") > max_chars, F.lit(False))
    chunks = F.when(long, F.regexp_extract_all("__text", piece, F.lit(0))).otherwise(F.array("__text"))
    return text.select(*pages.columns, F.posexplode(chunks).alias("chunk_no", "chunk"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Land raw pages ``(source_id, url, html)`` as parquet."""
    pages.write.mode("overwrite").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
