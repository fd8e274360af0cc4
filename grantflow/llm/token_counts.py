"""Token counts of every prefix of every text by dynamic programming.

A byte-pair encoding is fixed by its neighbours: a row of tokens is the
encoding of its text exactly if every adjacent pair is the encoding of the
pair's own text.  So for each prefix there is one last token, the one that
ends the prefix and fits the last token of what precedes it, and

    count[i] = count[i - len(last)] + 1.

One pass over the tokens that end at each position (an Aho-Corasick automaton
of the vocabulary finds them) gives the counts of all prefixes of a
pre-token; which pairs fit is asked of the library once per pair.  Pre-tokens
are put together as the library's pattern would cut the prefix, not the whole
text: white space at the end of a prefix is one pre-token, and a contraction
that is cut is an apostrophe and a letter.

The result holds one 16-bit step per character (count of a prefix less that
of the prefix before), so ``truncated`` and ``counts`` answer any later
question about budgets without the tokenizer.

Defined cases: a null or empty text has no steps and 0 tokens; rows with null
or equal ids each have their row; an empty table gives an empty result;
further columns are ignored.  Special strings count as one token where they
are complete and as plain text where a prefix cuts them, as in the library.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grantflow.llm.chunks import text_slices
from grantflow.llm.pieces import _UNIT, BLANKS, TokenIds, vocabulary

# Fixed value: the byte-level pre-token pattern the tokenizer file stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters below have the same class in all Unicode versions; texts with
#: others are cut into pre-tokens by the library.
SETTLED = "\u0530"
#: Entries of the caches of a Python worker.
STRETCHES, PIECES, PAIRS = 700_000, 300_000, 600_000
STEP = np.dtype("<i2")


def _byte_alphabet() -> dict[int, int]:
    """Byte -> code point in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for 256, 257, ... in order."""
    plain = {b: b for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r}
    rest = (b for b in range(256) if b not in plain)
    return plain | {b: 256 + i for i, b in enumerate(rest)}


class PrefixSteps(TokenIds):
    """``encode(texts)`` -> per text, the packed steps of all its prefixes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        super().__init__(path, STRETCHES)
        if not self.byte_level:
            raise ValueError("prefix counts are for byte-level tokenizers")
        self.pattern = regex.compile(PATTERN)
        self.blank = regex.compile(f"[{BLANKS}]+")
        self.alphabet = _byte_alphabet()
        self.text_of = {i: t for t, i in self.lib.get_vocab(with_added_tokens=False).items()}
        self.ends = ahocorasick.Automaton()
        for i, t in self.text_of.items():
            if self._ids(t) == [i]:               # a token the encoder can reach
                self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.fits: dict[int, bool] = {}
        self.dtype = STEP
        self.pieces: dict[str, list[int]] = {}

    def _ids(self, byte_text: str) -> list[int]:
        return [t.id for t in self.lib.model.tokenize(byte_text)]

    def _fit(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            got = self.fits[key] = self._ids(self.text_of[left] + self.text_of[right]) == [left, right]
        return got

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of ``piece[:k]`` for k = 0 .. len(piece), each prefix a pre-token."""
        got = self.pieces.get(piece)
        if got is not None:
            return got
        raw = piece.encode("utf-8", "surrogatepass")
        text = raw.decode("latin-1").translate(self.alphabet)
        count, last = [0] * (len(text) + 1), [-1] * (len(text) + 1)
        fit = self._fit
        for end, (token, size) in self.ends.iter(text):
            end += 1
            if last[end] < 0:
                before = end - size
                if not before or last[before] >= 0 and fit(last[before], token):
                    last[end] = token
                    count[end] = count[before] + 1
        if len(raw) > len(piece):                 # byte positions that end a character
            at = [0]
            for c in piece:
                at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
            count = [count[i] for i in at]
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = count
        return count

    def _cut(self, unit: str) -> list[str]:
        if max(unit) < SETTLED:
            return self.pattern.findall(unit)
        return [unit[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(unit)]

    def unit_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for k = 1 .. len(text)."""
        out: list[int] = []
        base = 0
        for unit in _UNIT.findall(text):
            blank = self.blank.match(unit)
            wide = blank.end() if blank else 0
            if wide:                              # a prefix that ends here ends in white space
                out += [base + c for c in self.piece_counts(unit[:wide])[1:]]
                if wide == len(unit):
                    base = out[-1]
                    continue
            at = 0
            for piece in self._cut(unit):
                counts = self.piece_counts(piece)
                if at + len(piece) > wide:
                    inside = counts[max(wide - at, 0) + 1:]
                    if len(piece) == 3 and piece[0] == "'" and piece[1:] in ("re", "ve", "ll"):
                        inside[1] = self.piece_counts("'")[1] + self.piece_counts(piece[1])[1]
                    out += [base + c for c in inside]
                base += counts[-1]
                at += len(piece)
        return out

    def _steps(self, text: str) -> bytes:
        counts = self.unit_counts(text)
        return array("h", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    # -- what TokenIds asks for --------------------------------------------
    def _together(self, units: list[str]) -> list[bytes]:
        return [self._steps(u) for u in units]

    def _one(self, text: str) -> bytes:
        """A prefix that cuts a special string reads it, and the stretch
        before it, as plain text; the whole string is one token."""
        out, before = [], ""
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                head = (_UNIT.findall(before) or [""])[-1]
                had = self.unit_counts(head)[-1] if head else 0
                counts = [had, *self.unit_counts(head + part)[len(head):-1], had + 1]
                out.append(array("h", [b - a for a, b in zip(counts, counts[1:])]).tobytes())
            elif part:
                out.append(self._spaced(part))
            before = part if i % 2 == 0 else ""
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def _prefix_steps(path: str) -> PrefixSteps:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PrefixSteps(path)


def counts(steps: bytes) -> np.ndarray:
    """Tokens of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(steps, STEP), dtype=np.int64)


def truncated(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(counts(steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _rows(file: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_of = _prefix_steps(vocabulary(file))
        for batch in batches:
            for part in text_slices(batch, 1):
                steps = steps_of.encode(part.column(1))
                yield pa.record_batch([
                    part.column(0), pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64()),
                    pa.array(steps, pa.binary()),
                    pa.array([int(np.frombuffer(s, STEP).sum(dtype=np.int64)) for s in steps], pa.int64()),
                    pa.array([truncated(s, budget) for s in steps], pa.int64())],
                    names=["id", "n_bytes", "steps", "n_tokens", "fit_chars"])
    return run


def prefix_counts(docs: DataFrame, file: str, budget: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, steps (binary), n_tokens, and ``fit_chars``,
    the characters of the longest prefix within ``budget`` tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _rows(file, budget), f"id {kind}, n_bytes long, steps binary, n_tokens long, fit_chars long")
