"""Repeated passages by a sparse enhanced suffix array.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else.  Sorting every suffix of the corpus would move each byte hundreds of
times; only these reach a suffix array:

1. **Anchors.**  Of the ``GRAM``-byte grams of each window of ``width`` bytes
   the one with the smallest hash (ties: the first) is its anchor.  The choice
   depends on the window's bytes alone, so equal windows have equal anchors at
   equal distance ``d``.  Windows that share an anchor are one *stretch*, about
   one per 137 bytes.  A window whose anchor's gram occurs once is unique.
2. **Copies collapse.**  Equal stretches (128-bit digests) become one, with a
   count; if all stretches of a gram are equal, all their windows repeat.
3. **Buckets.**  The different stretches of one gram are a bucket, the only
   place where their windows can meet.  A bucket of over ``BUCKET`` stretches
   is split: windows are halved by ``d``, the bytes common to all windows of a
   half make its new bucket, equal parts collapse, until each bucket fits (a
   part of one window has one text).  A passage in a third of all documents
   so takes about ten rounds of partial aggregates and no large group.
4. **Suffix array.**  A task sorts the suffixes that start at the windows of
   its buckets, computes common prefixes of neighbours, and scans them with a
   stack: the nodes of the interval tree of at least ``width`` bytes whose
   suffixes differ in the byte before them are the maximal repeats, each with
   its whole range of the array, that is all its occurrences.
5. **Spans** go back to every stretch of the same digest and are merged in
   one pass over the staged texts, in which no text is shuffled.

Defined cases: null text counts as empty; texts shorter than ``width`` lose
nothing; rows equal in id and text are rows of their own, each a copy of the
other; null ids are kept as they are; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from grantflow.llm.chunks import text_slices
from grantflow.llm.store import new_folder, open_store, staged

GRAM = 128
#: Stretches of a bucket that one suffix array takes at most.
BUCKET = 256
#: Suffixes sorted together, if their buckets end there.
SUFFIXES = 1 << 16
#: Windows looked at together, so that the arrays stay in a core's cache.
BLOCK = 1 << 16
#: Row numbers below this many bits count the rows of one staged file.
ROW_BITS = 33
MULTIPLIER = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


class Anchors:
    """Anchors of all windows of a buffer, block by block."""

    def __init__(self, width: int, gram: int = GRAM, block: int = BLOCK):
        self.width, self.gram, self.block = width, gram, max(block, width)
        n = self.block + width
        self.bits = np.uint64(int(n).bit_length())
        self.table = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
        self.power, self.inverse = (self._powers(m, n) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))

    @staticmethod
    def _powers(m: int, n: int) -> np.ndarray:
        p = np.full(n, m, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p, out=p)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A rolling hash of every gram: differences of prefix sums, moved to
        the same power, and mixed."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.inverse[:len(data) - self.gram + 1]
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= MIX
        h ^= h >> np.uint64(32)
        return h

    def _smallest(self, key: np.ndarray, n: int) -> np.ndarray:
        """Minimum of each of ``n`` windows of grams: of the rest of one row
        and the beginning of the next."""
        w = self.width - self.gram + 1
        rows = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        rows[:len(key)] = key
        rows = rows.reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).reshape(-1)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return np.minimum(after[:n], before[w - 1:w - 1 + n])

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows of the runs that share an anchor, the anchors' places
        and their grams' hashes, ascending."""
        first, place, gram = [], [], []
        last = -1
        for at in range(0, len(data) - self.width + 1, self.block):
            part = data[at:at + self.block + self.width - 1]
            h = self._hashes(part)
            key = h >> self.bits << self.bits | np.arange(len(h), dtype=np.uint64)
            found = (self._smallest(key, len(part) - self.width + 1) & (np.uint64(1) << self.bits) - np.uint64(1)) \
                .astype(np.int64)
            new = np.flatnonzero(np.diff(found + at, prepend=last))
            first.append(new + at)
            place.append(found[new] + at)
            gram.append(h[found[new]])
            last = int(found[-1]) + at
        if not first:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        return np.concatenate(first), np.concatenate(place), np.concatenate(gram)


STRETCHES = "row long, at long, windows int, d int, gram long, x1 long, x2 long"


def _stretches(width: int) -> Callable:
    """(row, text) -> the stretches of each text: first window, number of
    windows, distance of the first to the anchor, gram and digest."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width)
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
                buffer = memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]
                ends = offsets - offsets[0]
                first, place, gram = anchors.runs(np.frombuffer(buffer, np.uint8))
                # A text's windows are those between its ends: cut the runs there.
                begin, stop = ends[:-1], np.maximum(ends[1:] - width + 1, ends[:-1])
                long = np.flatnonzero(stop > begin)
                if not len(long):
                    continue
                begin, stop = begin[long], stop[long]
                lo = np.searchsorted(first, begin, "right") - 1
                n = np.searchsorted(first, stop, "left") - lo
                own = np.repeat(np.arange(len(long)), n)
                run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                start = np.maximum(first[run], begin[own])
                end = np.minimum(np.append(first[1:], len(buffer))[run], stop[own])
                digests = b"".join([xxhash.xxh3_128_digest(buffer[a:b]) for a, b in
                                    zip(start.tolist(), (end + (width - 1)).tolist())])
                x = np.frombuffer(digests, np.int64).reshape(-1, 2)
                rows = part.column(0).to_numpy(zero_copy_only=False)[long][own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows, pa.int64()), pa.array(start - begin[own], pa.int64()),
                    pa.array((end - start).astype(np.int32)), pa.array((place[run] - start).astype(np.int32)),
                    pa.array(gram[run].view(np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1])],
                    ["row", "at", "windows", "d", "gram", "x1", "x2"])

    return find


# ------------------------------------------------------- the suffix array

def maximal_repeats(texts: list[bytes], windows: list[int], width: int) \
        -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Maximal repeats of at least ``width`` bytes among the suffixes of
    ``texts`` that start at the first ``windows`` bytes of each.

    Returns the enhanced suffix array, as the text and the place of every
    suffix in order, and the groups ``(length, first, last)``: all occurrences
    of a group are the suffixes ``first .. last``.
    """
    own = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = [t[i:] for t, n in zip(texts, windows) for i in range(n)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    own, place = own[order], place[order]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    start = (ends - [len(t) for t in texts])[own] + place
    shared = np.append(_common(data, start, ends[own], width), 0)
    # A text's beginning counts as a byte of its own.
    before = np.where(place > 0, data[start - 1].astype(np.int64), -1 - own)
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    groups, stack = [], []
    near = shared >= width
    for i in np.flatnonzero(near | np.append(False, near[:-1])).tolist():
        n, first = int(shared[i]), i - 1
        while stack and n < stack[-1][0]:
            length, first = stack.pop()
            if changes[i - 1] != changes[first]:       # not all go on to the left with the same byte
                groups.append((length, first, i - 1))
        if n and (not stack or n > stack[-1][0]):
            stack.append((n, first))
    return own, place, groups


def _common(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it, in order; 0 below
    ``width``.  No suffix is longer than twice the width."""
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    shared = np.zeros(len(start), np.int64)
    for lo in range(1, len(start), 2048):
        at = start[lo - 1:lo + 2048]
        rows = view[at]
        same = np.flatnonzero((rows[1:] == rows[:-1]).all(axis=1))
        a, b = at[same] + width, at[same + 1] + width
        most = np.minimum(end[lo - 1 + same] - a, end[lo + same] - b)
        differ = view[a] != view[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[lo + same] = width + np.minimum(first, most)
    return shared


def covered(texts: list[bytes], windows: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of the windows of each text that lie in a maximal
    repeat, runs of neighbours joined."""
    own, place, groups = maximal_repeats(texts, windows, width)
    longest = np.zeros(len(own) + 1, np.int64)
    for length, first, last in sorted(groups):          # inner nodes after those around them
        longest[first:last + 1] = length
    hit = np.flatnonzero(longest)
    at = (np.cumsum(windows) - windows)[own[hit]] + place[hit]
    edge = np.zeros(sum(windows) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + longest[hit] - width + 1, 1)
    inside = np.cumsum(edge)[:-1] > 0
    text = np.repeat(np.arange(len(texts)), windows)
    new = inside[1:] != inside[:-1]
    cut = np.append(0, np.flatnonzero(new | (text[1:] != text[:-1])) + 1)
    base = np.cumsum(windows) - windows
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(inside)]):
        if inside[a]:
            t = int(text[a])
            yield t, a - int(base[t]), b - int(base[t])


# ----------------------------------------------------------------- buckets

KEY = ["key", "low"]
#: A part of a distinct stretch (x1, x2): its bucket, the range of ``d`` of the
#: bucket, its own digest, copies, windows, ``d`` of the first, and its bytes.
PIECE = pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                   ("u1", pa.int64()), ("u2", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("d", pa.int32()),
                   ("text", pa.binary())])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PIECE)], PIECE.names)


def _covered_pieces(width: int) -> Callable:
    """Pieces of whole buckets together -> the spans of each piece (by its
    ``d``, so that they hold for the stretches it is part of)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SUFFIXES and row[:2] != rows[-1][:2]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[4]
        if rows:
            yield done(rows)

    def done(rows: list[tuple]) -> pa.RecordBatch:
        out = [(*rows[t][:4], rows[t][5] - end + 1, rows[t][5] - first)
               for t, first, end in covered([r[6] for r in rows], [r[4] for r in rows], width)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          [*KEY, "u1", "u2", "d_first", "d_last"])

    return find


def _halves(width: int) -> Callable:
    """Each piece cut in two by ``d``, each half under the bytes that all
    windows of that half have in common."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x1, x2, low, high, n, windows, d, text in zip(*[c.to_pylist() for c in batch.columns]):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle, high)):
                    least, most = max(a, d - windows + 1), min(b - 1, d)
                    if least > most:
                        continue
                    part = text[d - most:d - least + width]
                    key = xxhash.xxh3_64_digest(text[d - a:d - b + 1 + width], seed=a)
                    u = xxhash.xxh3_128_digest(part)
                    whole = (key, u[:8], u[8:])
                    k, u1, u2 = (int.from_bytes(w, "little", signed=True) for w in whole)
                    out.append((x1, x2, k, a, b, u1, u2, n, most - least + 1, most, part))
            yield _pieces(out)

    return cut


def settle(pieces: DataFrame, width: int) -> DataFrame:
    """(x1, x2, d_first, d_last): the windows of every distinct stretch that
    occur in another one, or in another copy of it."""
    found = []
    while True:
        distinct = pieces.groupBy(*KEY, "u1", "u2").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"),
                                                        F.first("d").alias("d"), F.first("text").alias("text"))
        distinct = staged(distinct, "repeats-distinct")
        sizes = staged(distinct.groupBy(*KEY).agg(F.count(F.lit(1)).alias("stretches")).where("stretches > 1"),
                       "repeats-sizes")
        sized = staged(distinct.join(sizes, KEY), "repeats-sized")
        small = sized.where(F.col("stretches") <= BUCKET).select(*KEY, "u1", "u2", "windows", "d", "text")
        schema = "key long, low int, u1 long, u2 long, d_first int, d_last int"
        part = small.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_covered_pieces(width), schema)
        whole = distinct.where("n > 1").select(*KEY, "u1", "u2", (F.col("d") - F.col("windows") + 1).alias("d_first"),
                                               F.col("d").alias("d_last"))
        links = pieces.select("x1", "x2", *KEY, "u1", "u2")
        found.append(staged(links.join(whole.unionAll(part), [*KEY, "u1", "u2"])
                            .select("x1", "x2", "d_first", "d_last"), "repeats-found"))
        hot = sizes.where(F.col("stretches") > BUCKET).select(*KEY)
        if hot.isEmpty():
            break
        pieces = staged(pieces.join(hot, KEY).select("x1", "x2", "low", "high", "n", "windows", "d", "text")
                        .mapInArrow(_halves(width), from_arrow_schema(PIECE)), "repeats-halves")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


# ------------------------------------------------------------------- texts

class Texts:
    """The documents, staged once; tasks read the files they need in order."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        self.path = new_folder(spark, "repeats-texts")
        rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                           F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                           F.monotonically_increasing_id().alias("row"))
        rows.write.parquet(self.path)
        self.rows = spark.read.schema(rows.schema).parquet(self.path)
        located = self.rows.select(F.col("_metadata.file_path").alias("file"), F.shiftright("row", ROW_BITS).alias("task"))
        #: One row per task that wrote: its files (one, unless a limit of rows a file is set).
        self.files = staged(located.groupBy("task").agg(F.sort_array(F.collect_set("file")).alias("files")),
                            "repeats-files")
        self.tasks = max(1, self.files.count())

    def beside(self, wanted: DataFrame, order: list[str], read: Callable, schema: T.StructType | str) -> DataFrame:
        """``wanted`` (with ``row``) file by file in the order of the rows;
        ``read(rows, texts)`` gets both for the rows of one task: an iterator
        of dicts and an iterator of (row, id, text), both ascending."""
        rows = wanted.withColumn("task", F.shiftright("row", ROW_BITS))
        own = self.files.select("task", F.lit(None).cast("long").alias("row"), "files")
        both = rows.unionByName(own, allowMissingColumns=True).repartition(self.tasks, "task") \
            .sortWithinPartitions("task", F.col("row").asc_nulls_first(), *order)

        def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stream = (r for b in batches for r in b.to_pylist())
            head = next(stream, None)
            while head is not None:
                after: list[dict] = []

                def mine(task=head["task"], after=after):
                    for r in stream:
                        if r["task"] != task:
                            after.append(r)
                            return
                        yield r

                rows = mine()
                yield from read(rows, read_files(head["files"]))
                for _ in rows:
                    pass
                head = after[0] if after else None

        return both.mapInArrow(serve, schema)


def read_files(files: list[str]) -> Iterator[tuple[int, object, bytes]]:
    for url in files:
        fs, path = open_store(url)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["row", "id", "text"]):
                columns = [batch.column("row"), batch.column("id"), batch.column("text").cast(pa.large_binary())]
                yield from zip(*[c.to_pylist() for c in columns])


def _slices(width: int) -> Callable:
    def read(rows: Iterator[dict], texts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, at = [], -1
        for r in rows:
            while at < r["row"]:
                at, _, text = next(texts)
            out.append((r["x1"], r["x2"], r["gram"], 0, width - GRAM + 1, r["x1"], r["x2"], r["n"], r["windows"],
                        r["d"], text[r["at"]:r["at"] + r["windows"] - 1 + width]))
            if len(out) >= 4096:
                yield _pieces(out)
                out.clear()
        yield _pieces(out)

    return read


def _cut(texts_too: bool, schema: pa.Schema) -> Callable:
    def read(rows: Iterator[dict], texts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        r = next(rows, None)
        out, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)],
                                              schema.names)

        for row, doc_id, text in texts:
            spans: list[dict] = []
            while r is not None and r["row"] == row:
                if spans and r["first"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                else:
                    spans.append({"start": r["first"], "end": r["end"]})
                r = next(rows, None)
            at, digest, kept = 0, hashlib.sha256(), []
            for start, end in [*((s["start"], s["end"]) for s in spans), (len(text), len(text))]:
                digest.update(text[at:start])
                if texts_too:
                    kept.append(text[at:start])
                at = end
            out.append((doc_id, len(text), sum(s["end"] - s["start"] for s in spans), spans, digest.hexdigest(),
                        *[b"".join(kept)] * texts_too))
            size += len(text)
            if len(out) >= 2048 or size >= 4_000_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return read


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400,
                    kept_bytes: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (start and end in
    bytes, ascending, apart from each other), kept_sha256, and with
    ``kept_bytes`` the bytes that stay."""
    if width < GRAM:
        raise ValueError(f"width is at least {GRAM} bytes")
    texts = Texts(docs, id_col, text_col)
    stretches = staged(texts.rows.select("row", "text").mapInArrow(_stretches(width), STRETCHES), "repeats-stretches")
    grams = stretches.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x1", "x2")])
    # Staged, so that the join has a plain shuffle on both sides and Spark splits a gram of many stretches.
    shared = staged(grams.where("n > 1").select(
        "gram", ((F.col("min_x1") != F.col("max_x1")) | (F.col("min_x2") != F.col("max_x2"))).alias("differ")),
        "repeats-grams")
    met = staged(stretches.join(shared, "gram"), "repeats-met")
    equal = met.where(~F.col("differ")).select("row", F.col("at").alias("first"),
                                               (F.col("at") + F.col("windows") - 1 + width).alias("end"))
    distinct = met.where("differ").groupBy("gram", "x1", "x2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "windows", "d")).alias("one")) \
        .select("gram", "x1", "x2", "n", "one.*")
    pieces = staged(texts.beside(distinct, ["at"], _slices(width), from_arrow_schema(PIECE)), "repeats-pieces")
    some = met.where("differ").select("row", "at", "d", "x1", "x2").join(settle(pieces, width), ["x1", "x2"]).select(
        "row", (F.col("at") + F.col("d") - F.col("d_last")).alias("first"),
        (F.col("at") + F.col("d") - F.col("d_first") + width).alias("end"))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()),
                        T.StructField("spans", T.ArrayType(
                            T.StructType().add("start", T.LongType()).add("end", T.LongType()))),
                        T.StructField("kept_sha256", T.StringType())])
    if kept_bytes:
        out = out.add("kept", T.BinaryType())
    return texts.beside(equal.unionAll(some), ["first"], _cut(kept_bytes, to_arrow_schema(out)), out)
