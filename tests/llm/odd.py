"""Small inputs with every odd case, and plain versions of the rules."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(15_000))

#: doc_id, text, lang, source; columns with clashing names follow in `frame`.
DOCS = [
    (1, "Hello  world and more words here", "en", "a"),
    (2, "Hello world and\tmore words here", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "  \n", None, "b"),
    (6, "x" * 20_000, "en", "c"),
    (7, "<|endoftext|> it's  <|endo we'll", "en", "b"),
    (8, "日本語 テキスト 😀", "en", "b"),
    (9, LONG, "en", "a"),
    (10, LONG + " end", "en", "a"),
    (11, "1234 !! 99", "en", None),
    (12, "repeated row", "en", "a"),
    (12, "repeated row", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (None, "Hello world and more words here", "en", "a"),
    (13, "HELLO world AND more words here", "en", "d"),
    *[(100 + i, "the same text many times over and over", "en", "hot") for i in range(40)],
    *[(200 + i, f"near copy of one text with a changing word at the end of a longer line {i}", "en", "hot")
      for i in range(20)],
]
SCHEMA = ("doc_id long, text string, lang string, source string, id string, row string, run string, sha string, "
          "size string, n string, kept string, fp string, h string, b string, keep string, score string")


def frame(spark, docs=DOCS):
    extra = ("x",) * 12
    return spark.createDataFrame([(*d, *extra) for d in docs], SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(value):
    return (value is None, value)


def simhash(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(numbers, bits=2):
    """number -> smallest number of its component."""
    numbers = sorted(set(numbers))
    root = {n: n for n in numbers}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(numbers):
        for b in numbers[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in numbers}


def normal(text):
    return BLANK.sub(" ", text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
