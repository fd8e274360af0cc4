"""Token-id shards compressed by Re-Pair grammars, with random access.

Documents are ordered by id into shards, tokenised there, and every shard is
written as one file; a task closes a shard before its text exceeds twice
``SHARD_BYTES`` (or one document) and begins the next: frequent adjacent pairs of ids are replaced by new
symbols, round after round, each round counting all pairs of the shard anew
and replacing the most frequent ones that do not compete for an id, until no
pair is frequent.  Pairs of one symbol count, and are replaced, from left to
right without overlap.  No pair crosses the end of a document, so the file keeps, per document, where its
symbols start; expanding a slice of them gives the document back without the
rest of the shard.

File layout (little-endian): a 48-byte header (magic, id of the first new
symbol, counts, bits per symbol), then arrays: rules (left, right), expansion
length of every rule, symbols (their whole low bytes, then a bit array for
every higher bit), first symbol of every document (and the end), first id of
every document within the shard (and the end), and the documents' keys as an
Arrow IPC stream.

A task writes its file under its own attempt's name and reports it in the
manifest, a table; files of failed attempts are never read.  Rows with equal
ids are ordered by a hash of their text, so that a repeated id is spread
over shards; null ids come first; null and empty texts hold the end id alone;
an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from grantflow.llm.chunks import ragged, text_slices
from grantflow.llm.pieces import token_ids, vocabulary
from grantflow.llm.store import new_folder, open_store, staged

#: Text of a shard, about; tasks of a write, at most.
SHARD_BYTES, MOST_TASKS = 10_000_000, 100_000
#: Stretches of text whose ids a Python worker keeps.
STRETCHES = 700_000
#: Pairs replaced in one round at most.
PAIRS = 4096
#: A pair must occur this often to earn a rule (a rule costs three numbers).
LEAST = 16
#: Symbols close up while more than one in so many is replaced in a round.
CLOSE_UP = 12
#: No symbol: its place was taken by the rule to its left.
GONE = np.uint32(0xFFFFFFFF)
MAGIC, HEADER = b"GFREPAIR", struct.Struct("<8sQQQQQ")


def frequent(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur at least ``LEAST`` times, and how often."""
    values = np.sort(values)
    # In sorted order a value that occurs n times equals its LEAST - 1st
    # successor n - LEAST + 1 times.
    hits = values[:max(0, len(values) - LEAST + 1)][values[LEAST - 1:] == values[:max(0, len(values) - LEAST + 1)]]
    at = np.flatnonzero(np.append(True, hits[1:] != hits[:-1])) if len(hits) else np.zeros(0, np.int64)
    return hits[at], np.diff(np.append(at, len(hits))) + LEAST - 1


def replace_pairs(symbols: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over ``symbols``; ``ends`` marks the last symbol of a document.

    Returns the shorter symbols, where documents end in them, and the rules
    (left, right) of symbols ``first``, ``first + 1``, ...

    A pair of known symbols only gets rarer, so a round after the first looks
    at the places that were in frequent pairs and at those next to its last
    replacements alone.  While many places change, the symbols close up; from
    then on they stay where they are, linked to their neighbours, and a round
    costs as much as it has places to look at.
    """
    symbols, ends = symbols.copy(), ends.copy()
    rules = [np.zeros((0, 2), np.uint32)]
    new, n = first, len(symbols)
    following = before = None                   # links, once symbols stay in place
    at = np.flatnonzero(~ends)                  # no pair across documents
    while True:
        two = symbols[at + 1 if following is None else following[at]]
        one = symbols[at]
        # In a run of one symbol every other pair counts.
        equal = np.flatnonzero(one == two)
        if len(equal):
            beyond = at[equal] + 1 if following is None else following[at[equal]]
            head = np.append(True, at[equal][1:] != beyond[:-1])
            rank = np.arange(len(equal)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            skipped = equal[rank % 2 == 1]
            counted = np.ones(len(at), bool)
            counted[skipped] = False
            at, one, two, skipped = at[counted], one[counted], two[counted], at[skipped]
        else:
            skipped = equal
        pairs = (one.astype(np.uint64) << np.uint64(32)) | two
        kinds, counts = frequent(pairs)
        chosen: list[int] = []
        is_left, is_right = np.zeros(new, bool), np.zeros(new, bool)
        for pair in kinds[np.lexsort((kinds, -counts))].tolist():
            left, right = pair >> 32, pair & 0xFFFFFFFF
            # A symbol is a left or a right side this round, not both, so
            # two chosen pairs never overlap in the text; in a pair of equal
            # symbols it is both, and in no other pair.
            if is_right[left] or is_left[right]:
                continue
            chosen.append(pair)
            is_left[left] = is_right[right] = True
            if len(chosen) == PAIRS:
                break
        if not chosen:
            break
        table = np.sort(np.array(chosen, np.uint64))
        maybe = np.flatnonzero(is_left[one] & is_right[two])
        slot = np.minimum(np.searchsorted(table, pairs[maybe]), len(table) - 1)
        hit = table[slot] == pairs[maybe]
        hits, slot = at[maybe[hit]], slot[hit]
        rules.append(np.stack([table >> np.uint64(32), table & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        left_of, right_of = np.zeros(new, bool), np.zeros(new, bool)
        left_of[kinds >> np.uint64(32)] = right_of[kinds & np.uint64(0xFFFFFFFF)] = True
        stay = left_of[one] & right_of[two]
        stay[maybe[hit]] = False
        if following is None and len(hits) * CLOSE_UP < n:
            following, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        gone = hits + 1 if following is None else following[hits]
        symbols[hits] = new + slot
        ends[hits] = ends[gone]
        symbols[gone] = GONE
        n -= len(hits)
        look = np.zeros(len(symbols), bool)
        look[at[stay]] = look[skipped] = look[hits] = True
        if following is None:
            keep = symbols != GONE
            symbols, ends, look = symbols[keep], ends[keep], look[keep]
            made = np.flatnonzero(symbols >= new)
            look[made[made > 0] - 1] = True
            at = np.flatnonzero(look & ~ends)
        else:
            after = following[gone]
            following[hits] = after
            inside = after < len(before)
            before[after[inside]] = hits[inside]
            left = before[hits]
            look[left[left >= 0]] = True
            look[gone] = False
            at = np.flatnonzero(look)
            at = at[~ends[at]]
        new += len(table)
    keep = symbols != GONE
    return symbols[keep], ends[keep], np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids under each rule; a rule only names earlier symbols."""
    out = np.zeros(len(rules), np.uint32)
    known = np.zeros(len(rules), bool)
    while not known.all():
        side = rules.astype(np.int64) - first
        ready = ((side < 0) | known[np.maximum(side, 0)]).all(axis=1) & ~known
        out[ready] = np.where(side[ready] < 0, 1, out[np.maximum(side[ready], 0)]).sum(axis=1)
        known |= ready
    return out


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol up to the last rule, where its ids start in one flat
    array and how many they are."""
    length = np.append(np.ones(first, np.int64), expansion_lengths(rules, first).astype(np.int64))
    start = np.cumsum(length) - length
    flat = np.zeros(int(length.sum()), np.uint32)
    flat[:first] = np.arange(first)
    waiting = np.arange(len(rules))
    done = np.append(np.ones(first, bool), np.zeros(len(rules), bool))
    while len(waiting):
        ready = waiting[done[rules[waiting].astype(np.int64)].all(axis=1)]
        for side, at in ((0, start[first + ready]), (1, start[first + ready] + length[rules[ready, 0]])):
            part = rules[ready, side].astype(np.int64)
            n = length[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(at, n) + step] = flat[np.repeat(start[part], n) + step]
        done[first + ready] = True
        waiting = waiting[~done[first + waiting]]
    return start, length, flat


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    start, length, flat = table
    return flat[ragged(start, length, symbols)[0]]


def encode_shard(keys: pa.Array, docs: list[np.ndarray], first: int) -> bytes:
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, stops, rules = replace_pairs(ids, ends, first)
    starts = np.append(0, np.flatnonzero(stops) + 1).astype("<u8")
    sink = pa.BufferOutputStream()
    table = pa.record_batch([keys], names=["id"])
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_batch(table)
    width = int(first + len(rules)).bit_length()
    return b"".join([
        HEADER.pack(MAGIC, first, len(rules), len(symbols), len(docs), width),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(),
        symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width // 8].tobytes(),
        *(np.packbits((symbols >> bit & 1).astype(bool)).tobytes() for bit in range(width // 8 * 8, width)),
        starts.tobytes(),
        np.append(0, np.cumsum(sizes)).astype("<u8").tobytes(), sink.getvalue().to_pybytes()])


class Shard:
    """A shard file opened for random access by document number."""

    def __init__(self, data: bytes):
        magic, self.first, n_rules, n_symbols, self.n_docs, width = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = array("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = array("<u4", n_rules)
        packed = array("u1", n_symbols * (width // 8)).reshape(n_symbols, width // 8)
        self.symbols = np.zeros((n_symbols, 4), np.uint8)
        self.symbols[:, :width // 8] = packed
        self.symbols = self.symbols.view("<u4").reshape(-1)
        for bit in range(width // 8 * 8, width):
            plane = np.unpackbits(array("u1", -(-n_symbols // 8)), count=n_symbols)
            self.symbols |= plane.astype("<u4") << bit
        self.starts = array("<u8", self.n_docs + 1).astype(np.int64)
        self.first_id = array("<u8", self.n_docs + 1).astype(np.int64)
        self.table = expansions(self.rules, self.first)
        self.keys = pa.ipc.open_stream(pa.py_buffer(data)[at:]).read_all().column("id").combine_chunks()

    def documents(self, start: int, stop: int) -> list[np.ndarray]:
        """All ids of documents ``start .. stop - 1``, expanded together."""
        ids = expand(self.symbols[self.starts[start]:self.starts[stop]], self.table)
        cut = self.first_id[start:stop + 1] - self.first_id[start]
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of a document; expansion lengths skip the
        symbols before and after the slice."""
        symbols = self.symbols[self.starts[doc]:self.starts[doc + 1]]
        if start == 0 and stop is None:
            return expand(symbols, self.table)
        nested = symbols >= self.first
        width = np.ones(len(symbols), np.int64)
        width[nested] = self.lengths[symbols[nested] - self.first]
        upto = np.cumsum(width)
        stop = int(upto[-1]) if stop is None else min(stop, int(upto[-1]))
        lo, hi = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
        skipped = int(upto[lo] - width[lo]) if lo < len(upto) else 0
        return expand(symbols[lo:hi], self.table)[start - skipped:max(stop, start) - skipped]


def _write_shards(folder: str, file: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = token_ids(vocabulary(file), STRETCHES)
        task = TaskContext.get()
        keys: list[pa.Array] = []
        docs: list[np.ndarray] = []
        size = shard = 0

        def written() -> pa.RecordBatch:
            data = encode_shard(pa.concat_arrays(keys), docs, tok.lib.get_vocab_size())
            store, path = open_store(f"{folder}/shard-{task.partitionId():06d}-{shard:04d}-{task.taskAttemptId()}.rp")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(data)
            row = (task.partitionId(), shard, path.rpartition("/")[2], len(docs), sum(map(len, docs)), len(data))
            return pa.record_batch([pa.array([x]) for x in row],
                                   names=["task", "shard", "name", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            # Large slices: a stretch is looked up once in each.
            for part in text_slices(batch, 1, 1 << 16, limit):
                if docs and size + part.column(1).nbytes > 2 * limit:
                    yield written()
                    keys, docs, size, shard = [], [], 0, shard + 1
                keys.append(part.column(0))
                docs += [np.append(np.frombuffer(x, tok.dtype), tok.dtype.type(end_id))
                         for x in tok.encode(part.column(1))]
                size += part.column(1).nbytes
        if docs:
            yield written()
    return run


def write_shards(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all documents in id order; the folder and its manifest, with
    ``first`` = ids in earlier shards."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    order = ["id", F.xxhash64("text"), "text"]
    folder = new_folder(spark, "shards")
    tasks = total // max(SHARD_BYTES, total // MOST_TASKS) + 1
    ordered = rows.repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)
    manifest = staged(ordered.mapInArrow(
        _write_shards(folder, file, end_id, SHARD_BYTES),
        "task long, shard long, name string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    # Ids before a task (one row each, MOST_TASKS at most), and in it before a shard.
    def before(window) -> Column:
        return F.coalesce(F.sum("n_tokens").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    per = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens"))
    per = per.select("task", before(W.orderBy("task")).alias("earlier"))
    return folder, manifest.withColumn("within", before(W.partitionBy("task").orderBy("shard"))).join(per, "task") \
        .withColumn("first", F.col("earlier") + F.col("within")).drop("earlier", "within")


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = open_store(f"{folder}/{name}")
                with store.open_input_stream(path) as f:
                    shard = Shard(f.read())
                for at in range(0, shard.n_docs, 1000):
                    docs = range(at, min(at + 1000, shard.n_docs))
                    ids = shard.documents(docs.start, docs.stop)
                    yield pa.record_batch([
                        shard.keys.slice(at, len(docs)),
                        pa.array(shard.first_id[at:docs.stop] + first),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                        names=["id", "start", "n_tokens", "ids_crc32"])
    return run


def read_shards(folder: str, manifest: DataFrame, kind: str) -> DataFrame:
    """Every document of the shard files: id, start, n_tokens, ids_crc32."""
    files = manifest.select("name", "first")
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(n * 4, "name").mapInArrow(
        _read_shards(folder), f"id {kind}, start long, n_tokens long, ids_crc32 long")
