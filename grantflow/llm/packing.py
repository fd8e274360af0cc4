"""Packing documents into windows by non-negative least squares.

A document is its token ids and an end id.  Whole windows are cut from its
start; the remainder (shorter than a window) stays in one piece wherever a
combination of up to ``DEPTH`` remainders fills a window:

1. All documents are tokenised once and staged with their ids.
2. Remainder lengths of the whole corpus are counted in ``window / BIN`` bins.
   All combinations of at most ``DEPTH`` bins that add up to a window are the
   columns of a non-negative least squares problem against that histogram;
   its solution says how often each combination is used.  The histogram and
   the problem have a fixed size, whatever the corpus.
3. Each task packs its documents in blocks of ``BLOCK_TOKENS``: repeat counts
   are scaled to the block, rounded down and limited to what the block holds.
   What is left is packed greedily, longest first, and the piece that crosses
   the end of a window is cut there.  The last, partly filled window of a
   task is cut at powers of two, which need no padding.

Sequence ids are unique, grouped by task (task number << 32 plus a count) and
not dense.  Nothing is shuffled but the histogram's partial counts, so no key
can be hot.  Defined cases: null and empty texts are the end id alone; rows
with equal or null ids are packed like any others; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from grantflow.llm.pieces import id_rows
from grantflow.llm.store import staged

WINDOW = 2048
#: Width of a length bin; a combination is short of a window by less than
#: ``DEPTH * BIN`` tokens.
BIN = 8
DEPTH = 3
BLOCK_TOKENS = 8_000_000


def combinations(bins: int, depth: int) -> np.ndarray:
    """All non-increasing tuples of at most ``depth`` bin numbers with sum
    ``bins``, padded with 0; shape (n, depth)."""
    rows: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            rows.append(head + (0,) * (depth - len(head)))
        elif len(head) < depth:
            for b in range(min(left, head[-1] if head else left), 0, -1):
                grow((*head, b), left - b)

    grow((), bins)
    return np.array(rows, dtype=np.int64).reshape(-1, depth)


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |A x - target|.

    ``columns[j]`` lists the rows in which column j of A counts 1 (twice for
    2); entry 0 stands for no row.
    """
    n, m = len(columns), len(target)
    flat = np.append(0.0, target.astype(float))
    dense = np.zeros((n, m + 1))
    for d in range(columns.shape[1]):
        dense[np.arange(n), columns[:, d]] += 1
    dense[:, 0] = 0
    x, chosen = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, flat.max())
    for _ in range(rounds):
        gain = dense @ (flat - x @ dense)
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        chosen[best] = True
        while True:
            at = np.flatnonzero(chosen)
            fit = np.linalg.lstsq(dense[at].T, flat, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[at] = fit
                break
            down = at[fit <= 0]
            step = x[down] / np.maximum(x[down] - fit[fit <= 0], 1e-300)
            x[at] += step.min() * (fit - x[at])
            chosen[at[x[at] <= tolerance * 1e-3]] = False
            x[~chosen] = 0
            if not chosen.any():
                break
    return x


def solve_mix(histogram: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations in use and their repeat counts for a histogram of bins."""
    bins = window // BIN
    target = np.zeros(bins)
    for b, n in histogram.items():
        target[b - 1] = n
    if not target.any():
        return np.zeros((0, DEPTH), np.int64), np.zeros(0)
    columns = combinations(bins, DEPTH)
    columns = columns[(target[columns - 1] * (columns > 0) + (columns == 0)).min(axis=1) > 0]
    if not len(columns):
        return columns, np.zeros(0)
    x = non_negative_least_squares(columns, target)
    use = np.flatnonzero(x > 0)
    use = use[np.argsort(-x[use], kind="stable")]
    return columns[use], x[use]


class _Packer:
    """The sequences of one task, block by block.

    A segment is (key, ids of its document, start, length).
    """

    def __init__(self, window: int, dtype: np.dtype, mix: np.ndarray, per_token: np.ndarray, first: int):
        self.window, self.dtype, self.mix, self.per_token = window, dtype, mix.tolist(), per_token
        self.sequence = first
        self.rows: list[tuple] = []
        self.open: list[tuple] = []          # the greedy stream's last, partly filled window

    def _place(self, segments: list[tuple]) -> None:
        """One sequence of the given segments in a row."""
        offset = 0
        for key, ids, start, length in segments:
            part = np.frombuffer(ids, self.dtype, length, start * self.dtype.itemsize)
            self.rows.append((key, start, length, zlib.crc32(part.astype("<u4").tobytes()),
                              len(ids) // self.dtype.itemsize, self.sequence, offset))
            offset += length
        self.sequence += 1

    def _lay(self, segments: list[tuple], sizes: list[int]) -> list[tuple]:
        """Segments end to end into sequences of these sizes; what is left."""
        waiting = segments[::-1]
        for size in sizes:
            taken = []
            while size:
                key, ids, start, length = waiting.pop()
                n = min(length, size)
                taken.append((key, ids, start, n))
                size -= n
                if n < length:
                    waiting.append((key, ids, start + n, length - n))
            self._place(taken)
        return waiting[::-1]

    def block(self, docs: list[tuple], tokens: int) -> None:
        bins: dict[int, list[tuple]] = {}
        for key, ids in docs:
            n = len(ids) // self.dtype.itemsize
            whole = n - n % self.window
            for start in range(0, whole, self.window):
                self._place([(key, ids, start, self.window)])
            if whole < n:
                bins.setdefault(-(-(n - whole) // BIN), []).append((key, ids, whole, n - whole))
        for combo, want in zip(self.mix, (self.per_token * tokens).tolist()):
            parts = [b for b in combo if b]
            held = [len(bins.get(b, ())) // parts.count(b) for b in parts]
            for _ in range(min(int(want), *held)):
                self._place([bins[b].pop() for b in parts])
        left = self.open + sorted((x for v in bins.values() for x in v), key=lambda x: -x[3])
        self.open = self._lay(left, [self.window] * (sum(x[3] for x in left) // self.window))

    def close(self) -> None:
        """The last window, cut at powers of two."""
        left = sum(x[3] for x in self.open)
        self.open = self._lay(self.open, [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1])


def _pack_rows(window: int, mix: np.ndarray, per_token: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, np.dtype("<u2"), mix, per_token, TaskContext.get().partitionId() << 32)
        kind = None

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(packer.rows), 10_000):
                cols = zip(*packer.rows[at:at + 10_000])
                yield pa.record_batch([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)],
                                      names=PIECE)
            packer.rows = []

        docs, tokens = [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, ids, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # Every document has its end id, so its id width can be seen.
                packer.dtype = np.dtype(f"<u{len(ids) // n}")
                docs.append((key, ids))
                tokens += n
                if tokens >= BLOCK_TOKENS:
                    packer.block(docs, tokens)
                    docs, tokens = [], 0
                    yield from rows()
        packer.block(docs, tokens)
        packer.close()
        yield from rows()
    return run


PIECE = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    ids = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                 .mapInArrow(id_rows(file, end_id), f"id {kind}, ids binary, n_tokens long"), "pack-ids")
    rest = F.col("n_tokens") % window
    counted = (ids.groupBy(F.ceil(rest / BIN).cast("int").alias("b"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect())
    mix, times = solve_mix({r.b: r.n for r in counted if r.b}, window)
    tokens = sum(r.tokens for r in counted)
    out = f"id {kind}, " + ", ".join(f"{c} long" for c in PIECE[1:])
    return ids.mapInArrow(_pack_rows(window, mix, times / max(tokens, 1)), out)
