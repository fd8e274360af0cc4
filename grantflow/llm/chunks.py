"""Arrow text columns cut into batches of bounded size and into stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts and bytes that are looked at together.
BATCH_TEXTS, BATCH_BYTES = 512, 2_000_000


def text_slices(batch: pa.RecordBatch, column: int, texts: int = BATCH_TEXTS,
                size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text size; a longer text is a slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= texts or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def space_chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts (none null) cut at every space: the distinct stretches, the
    number of each stretch in order, and where each text starts (and the end)."""
    cut = pc.split_pattern(texts, " ")
    at = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    # No stretch holds a space: one string, cut again, makes Python strings fastest.
    words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary),
                           " ")[0].as_py().split(" ")
    return words, coded.indices.to_numpy().copy(), at - at[0]


def ragged(first: np.ndarray, length: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs ``first[i] .. first[i] + length[i] - 1`` for every
    i of ``index`` in order, and where each run starts in them (and the end)."""
    each = length[index]
    upto = np.append(0, np.cumsum(each))
    return np.repeat(first[index] - upto[:-1], each) + np.arange(upto[-1]), upto
