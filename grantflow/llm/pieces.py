"""Token ids of whole texts, from the tokenizers library through a bounded cache.

A byte-pair tokenizer encodes every pre-token on its own, and no pre-token of
the two tokenizer kinds used here spans the start of a run of white space.
So a text is cut there, a stretch seen before is one dictionary lookup, and
all new stretches of a batch go to the library in one call.

The cache takes ``cache_size`` stretches of up to ``CACHED_CHARS`` characters
and starts afresh when most lookups of a batch miss a full cache, so memory
is bounded for any input.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grantflow.llm.chunks import ragged, space_chunks, text_slices

#: Stretches a Python worker keeps (about 200 bytes each).
CACHE_SIZE = 300_000
CACHED_CHARS = 48
#: New stretches that go to the library in one call.
CALL = 8_192

# The white space of the Unicode standard.
BLANKS = ("\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029"
          "\\u202f\\u205f\\u3000")
_UNIT = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
#: A word of Latin letters and the marks after it: composed as it stands, with
#: the same lower case everywhere, and two pre-tokens at most.
_SIMPLE = re.compile("([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+)([.,;:!?]*)")
# Byte-level vocabularies name a byte by its character, the blank ones by the next free ones from 256.
_NAMED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = dict(zip(_NAMED, _NAMED)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_NAMED)))}
_EDGE = re.compile(f"[{BLANKS}]|.*[{BLANKS}]$", re.S)


class TokenIds:
    """``encode(texts)`` -> one byte string of little-endian ids per text, as
    the library gives them without added begin or end tokens."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        self.cache_size = cache_size
        self.lib = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        if not added:
            raise ValueError("a special token is needed to mark the ends of stretches")
        self.specials = [*added]
        self.mark, self.mark_id = next(iter(added.items()))
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.byte_level = type(self.lib.pre_tokenizer).__name__ == "ByteLevel"
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = np.zeros(self.lib.get_vocab_size(), np.int64)      # bytes of a byte-level token
        for t, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(t)
        self.model = self.lib.model
        self.marks: dict[str, bytes] = {}
        # The model alone takes a quarter of the time that normalising and splitting a word takes with it.
        self.direct = not self.byte_level and self._direct_agrees()
        #: Ids of a space and the stretch (byte level), or of the stretch.
        self.after_space: dict[str, bytes] = {}
        #: Ids of a stretch as it stands.
        self.units: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, text: str) -> bytes:
        names = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_NAMES)
        return np.array([t.id for t in self.model.tokenize(names)], self.dtype).tobytes()

    def _simple(self, word: str, cache: dict[str, bytes]) -> bytes | None:
        """Ids of a simple word from the library's model, pre-token by
        pre-token; None for any other."""
        parts = _SIMPLE.fullmatch(word)
        if parts is None:
            return None
        letters, marks = parts.groups()
        ids = cache.get(letters) if marks else None
        if ids is None:
            ids = self._pre_token(letters.lower())
        if marks:
            end = self.marks.get(marks)
            if end is None:
                end = self._pre_token(marks)
                if len(self.marks) < 1000:
                    self.marks[marks] = end
            ids += end
        return ids

    def _direct_agrees(self) -> bool:
        """Whether simple words have the ids that the library gives them, tried
        on words of every letter and mark: false for a vocabulary that composes,
        folds or splits them in another way."""
        letters = [chr(c) for c in range(256) if _SIMPLE.fullmatch(chr(c))]
        words = [a + b + c for a, b, c in zip(letters * 3, letters[7:] * 4, letters[29:] * 5)]
        words += letters + [w + m for w, m in zip(words, [".", ",", ";", ":", "!", "?", "...", "?!", ",.;"] * 40)]
        return [self._simple(w, {}) for w in words] == self.library(words)

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of each stretch, none of which holds a special string: one call
        for all, with the mark between them.  After a space, byte-level
        stretches need no mark; their ends are found by counting bytes."""
        if self.byte_level and all(u[:1] == " " for u in units):
            packed = self.library(["".join(units)])[0]
            upto = np.cumsum(self.width[np.frombuffer(packed, self.dtype)])
            ends = np.searchsorted(upto, np.cumsum([len(u.encode()) for u in units])) + 1
            starts = np.append(0, ends[:-1])
        else:
            packed = self.library([self.mark.join(units)])[0]
            ids = np.frombuffer(packed, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            starts = np.append(0, ends[:-1] + 1)
        size = self.dtype.itemsize
        return [packed[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist())]

    def _look_up(self, cache: dict[str, bytes], words: list[str], lead: str) -> list[bytes | None]:
        """Ids of distinct stretches, new ones encoded together; None for one
        whose white space meets the space before or after it."""
        found = [*map(cache.get, words)]
        new = [i for i, x in enumerate(found) if x is None]
        if not new:
            return found
        if lead:
            new = [i for i in new if words[i] and not _EDGE.match(words[i])]
        if len(cache) + len(new) > self.cache_size and 2 * len(new) > len(words):
            cache.clear()
        if self.direct and not lead:
            others = []
            for i in new:
                word = words[i]
                ids = found[i] = self._simple(word, cache)
                if ids is None:
                    others.append(i)
                elif len(word) <= CACHED_CHARS and len(cache) < self.cache_size:
                    cache[word] = ids
            new = others
        units = [lead + words[i] for i in new]
        joined = "\n".join(units)
        if any(s in joined for s in self.specials):
            odd = {i for i, u in zip(new, units) if any(s in u for s in self.specials)}
            for i in odd:
                found[i] = self.library([lead + words[i]])[0]
            new = [i for i in new if i not in odd]
            units = [lead + words[i] for i in new]
        for at in range(0, len(new), CALL):
            for i, ids in zip(new[at:at + CALL], self._together(units[at:at + CALL])):
                found[i] = ids
                if len(words[i]) <= CACHED_CHARS and len(cache) < self.cache_size:
                    cache[words[i]] = ids
        return found

    def _spaced(self, text: str) -> bytes:
        """A text cut at every run of white space."""
        units = _UNIT.findall(text)
        known = [*dict.fromkeys(units)]
        ids = dict(zip(known, self._look_up(self.units, known, "")))
        return b"".join(map(ids.__getitem__, units))

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Texts without special strings (byte level) or any texts."""
        words, index, at = space_chunks(texts)
        lead = " " if self.byte_level else ""
        found = self._look_up(self.after_space, words, lead)
        irregular = np.array([x is None for x in found], bool)[index] if self.byte_level else None
        if self.byte_level:
            # The first stretch of a text follows no space.
            heads = [words[i] for i in index[at[:-1]].tolist()]
            known = {h: i for i, h in enumerate(dict.fromkeys(heads))}
            ends_blank = [bool(h) and _EDGE.match(h[-1]) is not None for h in known]
            found += self._look_up(self.units, [*known], "")
            head = np.fromiter((known[h] for h in heads), np.int64, len(heads))
            index[at[:-1]] = head + len(words)
            irregular[at[:-1]] = np.array(ends_blank, bool)[head]
        size = self.dtype.itemsize
        found = [x or b"" for x in found]
        length = np.fromiter(map(len, found), np.int64, len(found)) // size
        flat = np.frombuffer(b"".join(found), self.dtype)
        first = np.cumsum(length) - length
        runs, upto = ragged(first, length, index)
        ids = flat[runs].tobytes()
        ends = (upto[at] * size).tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        if irregular is not None and irregular.any():
            for i in np.unique(np.searchsorted(at, np.flatnonzero(irregular), "right") - 1).tolist():
                out[i] = self._spaced(texts[i].as_py())
        return out

    def _one(self, text: str) -> bytes:
        """A byte-level text that holds special strings."""
        return b"".join(self.library([part])[0] if i % 2 else self._spaced(part)
                        for i, part in enumerate(self.special.split(text)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        if not self.byte_level:
            return self._plain(texts)
        special = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.specials))
        out = self._plain(pc.if_else(special, "", texts))
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._one(texts[i].as_py())
        return out


@functools.lru_cache(maxsize=2)
def token_ids(path: str, cache_size: int = CACHE_SIZE) -> TokenIds:
    """The tokenizer of this Python process, loaded once."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a process per core
    return TokenIds(path, cache_size)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on the machine that calls."""
    import public_tokenizers
    return public_tokenizers.path(name)


def id_rows(file: str, end_id: int | None):
    """``mapInArrow`` function: (id, text) batches -> (id, ids, n_tokens).

    ``ids`` are little-endian unsigned 16-bit numbers where the vocabulary
    allows, else 32-bit; ``end_id`` is appended to every text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = token_ids(vocabulary(file))
        end = b"" if end_id is None else np.array([end_id], tok.dtype).tobytes()
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = [x + end for x in tok.encode(part.column(1))]
                n = [len(x) // tok.dtype.itemsize for x in ids]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary()),
                                       pa.array(n, pa.int64())], names=["id", "ids", "n_tokens"])
    return run
