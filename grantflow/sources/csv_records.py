"""Records of quoted CSV files, found by many tasks.

A line break inside quotes belongs to a field, so a reader that starts in the
middle of a file does not know whether its first line starts a record.  Here
files are split like any text, and what a split can't know is kept as a
function of the state it starts in:

1. A line maps the state before it (outside or inside quotes) to the state
   after it; a quote opens only at the start of a field and closes at a quote
   that is not doubled.  Both results come from two regular expressions.
2. Each task composes these functions along its split: for both states the
   split may start in, every line gets the state before and after it and the
   line that starts its record.  Lines that start inside quotes either way are
   joined to the line before them, so past the first line that settles the
   state a *piece* is a whole record (or ``PIECE`` bytes of it).  The pieces are
   staged with these columns.
3. One small row per split, composed in the order of the splits of a file,
   gives the state each split really starts in and the record that is open
   there: a sum of swaps since the last split that fixes the state.
4. A piece that is a record passes straight on; only the pieces of other
   records, at the ends of splits and batches, are grouped by the line that
   starts them, wherever the splits end.

A file that ends inside quotes has a quote that opens nothing: its pieces are
cut into their lines again, so it costs no more than its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from grantflow.session import staged

#: Most bytes of joined lines, about.
PIECE = 1 << 20
#: Of each piece its first line in the split and its number of lines, the states
#: before and after it, and the line that starts its record, if the split starts
#: outside (0) or inside (1) quotes; -1: in an earlier split.
STATES = "nth long, n long, in0 boolean, in1 boolean, out0 boolean, out1 boolean, first0 long, first1 long"
RECORD = ["file", "line", "latin1", "by_line", "text"]
LINE = "file string, block long, raw binary, utf8 boolean"


def file_path() -> Column:
    """Path of the file a row comes from, as readers take it: the metadata
    column has it as a URI, blanks and the like escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line as bytes, in order within a split: file, block (where its
    split starts), whether it is UTF-8."""
    return spark.read.option("lineSep", "\n").text(path).select(
        file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"))


class Quoting:
    """Regular expressions of one dialect.  ``sep`` may hold several
    characters: any of them then starts a field."""

    def __init__(self, sep: str, quote: str):
        q, d = re.escape(quote), "[" + "".join(re.escape(c) for c in sep) + "]"
        self.quote = quote
        self.closes = f"^[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"
        self.field = f"(^|{d}){q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"
        self.empty = f"(^|{d}){q}{q}(?!{q})"
        self.opens = f"(?:^|{d}){q}"

    def _left_open(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.field), F.lit("$1")).rlike(self.opens)

    def after(self, text: Column, inside: bool) -> Column:
        """Whether a line that starts outside or inside quotes ends inside."""
        if not inside:
            return F.contains(text, F.lit(self.quote)) & self._left_open(text)
        rest = F.regexp_replace(text, F.lit(self.closes), F.lit("x"))
        return ~F.contains(text, F.lit(self.quote)) | ~text.rlike(self.closes) | self._left_open(rest)

    def bare(self, text: Column) -> Column:
        """The record with ``x`` for each quoted field that is not empty."""
        none = F.regexp_replace(text, F.lit(self.empty), F.lit("$1"))
        return F.when(F.contains(text, F.lit(self.quote)), F.regexp_replace(none, F.lit(self.field), F.lit("$1x"))) \
            .otherwise(text)


def _composed(header_row: int):
    """Lines of splits in order -> pieces, with their columns of :data:`STATES`."""

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, state, first = None, 0, [False, True], [-1, -1]
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, raw, utf8 = (batch.column(c) for c in ("file", "block", "raw", "utf8"))
            after = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("after0", "after1")]
            codes, blocks = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
            size = pc.binary_length(raw).to_numpy().astype(np.int64) + 1
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1), len(size)]
            out = [[] for _ in range(9)]
            for a, b in zip(cuts, cuts[1:]):
                key = (file[a].as_py(), int(blocks[a]))
                if key != at:
                    at, nth, state, first = key, 0, [False, True], [-1, -1]
                n = np.arange(nth, nth + b - a)
                o = [x[a:b] & ~((blocks[a] == 0) & (n < header_row)) for x in after]    # lines above the header
                fixes, swaps = o[0] == o[1], np.cumsum(o[0] & ~o[1])
                last = np.maximum.accumulate(np.where(fixes, np.arange(b - a), -1))
                odd = (swaps - np.where(last < 0, 0, swaps[last])) % 2 == 1
                begins, ends, starts = [], [], []
                for h in (0, 1):
                    ends.append(np.where(last < 0, state[h], o[0][last]) ^ odd)
                    begins.append(np.append(state[h], ends[h][:-1]))
                    starts.append(np.maximum.accumulate(np.where(begins[h], first[h], n)))
                    state[h], first[h] = bool(ends[h][-1]), int(starts[h][-1])
                p = _piece_starts(begins[0] & begins[1], size[a:b])
                to = np.append(p[1:], b - a)
                for column, x in enumerate((p + a, n[p], to - p, begins[0][p], begins[1][p], ends[0][to - 1],
                                            ends[1][to - 1], starts[0][p], starts[1][p])):
                    out[column].append(x)
                nth += b - a
            lines, *columns = (np.concatenate(x) for x in out)
            joined = pa.ListArray.from_arrays(pa.array(np.append(lines, len(size)), pa.int32()), raw)
            valid = np.logical_and.reduceat(utf8.to_numpy(zero_copy_only=False), lines)
            yield pa.RecordBatch.from_arrays(
                [file.take(pa.array(lines)), block.take(pa.array(lines)),
                 pc.binary_join(joined, pa.scalar(b"\n", raw.type)), pa.array(valid), *map(pa.array, columns)],
                ["file", "block", "raw", "utf8", "nth", "n", "in0", "in1", "out0", "out1", "first0", "first1"])

    return along


def _piece_starts(inside: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lines that start pieces: those that may start outside quotes, and
    within their runs one every ``PIECE`` bytes."""
    new = ~inside
    new[0] = True
    upto = np.cumsum(size) - size
    run = upto - np.maximum.accumulate(np.where(new, upto, 0))
    new[1:] |= run[1:] // PIECE > run[:-1] // PIECE
    return np.flatnonzero(new)


class Records:
    """The records of all files under ``path``.

    ``files``: one row per file: file, latin1 (some line is not UTF-8) and
    by_line (it ends inside quotes, or ``multiline`` is off).  ``rows``: file,
    line (of the file, from 0) and text of every record that is not blank, with
    latin1 and by_line of its file; lines above ``header_row`` are no records,
    and the header is the record at that line.  ``sep`` and ``quote`` as in
    :class:`Quoting`; without a quote, or with ``multiline`` off, a record is
    a line.  Lines end with LF or CRLF; line breaks in fields stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"',
                 header_row: int = 0, multiline: bool = True):
        text = F.col("raw").cast("string")
        lines = raw_lines(spark, path)
        if quote and multiline:
            dialect = Quoting(sep, quote)
            after = [dialect.after(text, h) for h in (False, True)]
        else:
            after = [F.lit(False), F.lit(False)]
        lines = staged(lines.withColumn("after0", after[0]).withColumn("after1", after[1])
                       .mapInArrow(_composed(header_row), f"{LINE}, {STATES}"), "csv-lines")
        splits = self._splits(lines)
        ends = splits.groupBy("file").agg(F.max_by("ends", "block").alias("by_line"), F.max("latin1").alias("latin1"))
        by_line = F.col("by_line") if quote and multiline else F.lit(True)
        self.files = ends.select("file", "latin1", by_line.alias("by_line"))
        state = splits.select("file", "block", "before", "inside", "open").join(self.files, "file")
        # One small row per split; whether it is small enough to be sent to all tasks is Spark's to check.
        known = lines.join(staged(state, "csv-splits"), ["file", "block"])
        text = F.when(F.col("latin1"), F.decode("raw", "ISO-8859-1")).otherwise(F.col("raw").cast("string"))
        first = F.when(F.col("inside"), F.col("first1")).otherwise(F.col("first0"))
        known = known.select(
            "file", (F.col("before") + F.col("nth")).alias("at"), "latin1", "by_line", "nth",
            F.posexplode(F.when(F.col("by_line"), F.split(text, "\n", -1)).otherwise(F.array(text))).alias("pos", "text"),
            (~F.col("by_line") & F.when(F.col("inside"), F.col("in1")).otherwise(F.col("in0"))).alias("starts_in"),
            (~F.col("by_line") & F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0"))).alias("ends_in"),
            F.when(first < 0, F.col("open")).otherwise(F.col("before") + first).alias("first")) \
            .withColumn("line", F.col("at") + F.col("pos")).where(F.col("line") >= header_row)
        self._whole = ~F.col("starts_in") & ~F.col("ends_in")
        self._lines, self._joined, self.header_row = known, bool(quote and multiline), header_row
        out = known.where(self._whole)
        if self._joined:
            out = out.select(*RECORD).unionByName(self._grouped(known.where(~self._whole)))
        self.rows = self._cleaned(out)

    def _grouped(self, lines: DataFrame) -> DataFrame:
        """Records of several pieces."""
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
        return lines.groupBy("file", "first", "latin1", "by_line") \
            .agg(F.min("line").alias("line"), F.array_join(pieces, "\n").alias("text")).select(*RECORD)

    @staticmethod
    def _cleaned(records: DataFrame) -> DataFrame:
        text = F.regexp_replace("text", r"\r\z", "")
        text = F.when(F.col("line") == 0, F.ltrim(text, F.lit("\ufeff"))).otherwise(text)
        return records.select(*RECORD).withColumn("text", text).where(F.trim("text") != "")

    @staticmethod
    def _splits(lines: DataFrame) -> DataFrame:
        """Per split: lines before it, the state it starts in (inside), the
        line of the file that starts the record open there, and the state it
        ends in."""
        last = F.max_by(F.struct("out0", "out1", "first0", "first1"), "nth").alias("last")
        per = lines.groupBy("file", "block").agg(last, F.sum("n").alias("n"), F.max(~F.col("utf8")).alias("latin1"))
        order = W.partitionBy("file").orderBy("block")           # as many rows as the file has splits
        upto, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
        per = per.withColumn("swaps", F.sum((F.col("last.out0") & ~F.col("last.out1")).cast("int")).over(upto))
        fixed = F.when(F.col("last.out0") == F.col("last.out1"), F.struct(F.col("last.out0").alias("v"), "swaps"))
        fixed = F.last(fixed, ignorenulls=True).over(earlier)
        swaps = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(fixed["swaps"], F.lit(0))
        per = per.withColumn("inside", F.coalesce(fixed["v"], F.lit(False)) != (swaps % 2 == 1)) \
            .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        first = F.when(F.col("inside"), F.col("last.first1")).otherwise(F.col("last.first0"))
        ends = F.when(F.col("inside"), F.col("last.out1")).otherwise(F.col("last.out0"))
        return per.withColumn("own", F.when(first >= 0, F.col("before") + first)).select(
            "file", "block", "before", "inside", "latin1", ends.alias("ends"),
            F.last("own", ignorenulls=True).over(earlier).alias("open"))

    def headers(self) -> DataFrame:
        """file and text of the header of every file that has one.  Only the
        pieces of headers are grouped, not those of other records."""
        # A piece is no nearer to the beginning of its split than of its file.
        own = self._lines.where((F.col("nth") <= self.header_row) & (F.col("line") == self.header_row))
        out = own.where(self._whole)
        if self._joined:
            longer = own.where(~self._whole).select("file", F.col("first").alias("header"))
            lines = self._lines.where(~self._whole).join(longer, "file").where(F.col("first") == F.col("header"))
            out = out.select(*RECORD).unionByName(self._grouped(lines))
        return self._cleaned(out).select("file", "text", "latin1")
