import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from grantflow.llm import repeats
from tests.llm.odd import DOCS, frame, key, nothing


def plain(texts, width):
    """By the definition: windows in a dictionary."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(int)))
        yield len(b), int(gone.sum()), list(zip(edges[::2].tolist(), edges[1::2].tolist())), kept


def check(spark, docs, rows, width):
    want = sorted(((key(d[0]), n, gone, spans, hashlib.sha256(kept).hexdigest(), kept)
                   for d, (n, gone, spans, kept) in zip(docs, plain([d[1] for d in docs], width))), key=repr)
    got = sorted(((key(r.id), r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept_sha256, bytes(r.kept))
                  for r in rows), key=repr)
    assert got == want
    return sum(w[2] for w in want)


def corpus(seed, width):
    """Passages of many lengths about the width, cut and joined; near copies;
    repeats inside one text; texts of one period."""
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "日本", "epsilon", "zeta", "eta", "theta", "iota"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))

    shared = [prose(rng.randrange(width // 12, width // 3)) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [prose(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a:a + rng.choice([width - 5, width, width + 1, 3 * width])], prose(rng.randrange(0, 40))]
        docs.append((i, " ".join(parts)))
    for i in range(30):
        base = docs[i % 7][1]
        at = rng.randrange(len(base) + 1)
        docs.append((200 + i, base[:at] + rng.choice("xyz") + base[at + 1:]))
    docs += [(300, "ab" * 700), (301, "ab" * 400 + "c" + "ab" * 900), (302, shared[0] * 3), (303, "x" * (width - 1)),
             (304, "x" * width), (305, "y" * (width + 1)), (306, None), (306, ""), (307, docs[3][1]), (307, docs[3][1])]
    return docs


@pytest.mark.parametrize("width, bucket", [(400, 256), (130, 2), (200, 8)])
def test_against_the_definition(spark, monkeypatch, width, bucket):
    """Small buckets force the split by halves on every border."""
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    docs = corpus(width, width)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = repeats.without_repeats(df, width=width, kept_bytes=True).collect()
    assert check(spark, docs, rows, width) > 10_000


def test_odd_rows(spark):
    rows = repeats.without_repeats(frame(spark), kept_bytes=True).collect()
    check(spark, DOCS, rows, 400)
    empty = repeats.without_repeats(nothing(spark))
    assert empty.count() == 0 and empty.columns == ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]


@pytest.mark.parametrize("block", [1, 150, 997, 1 << 16])
def test_anchors_depend_on_the_window_alone(block):
    rng = random.Random(block)
    some = bytes(rng.choices(b"abc", k=900))
    data = some + bytes(rng.choices(b"abc", k=700)) + some + b"z" * 500
    runs = repeats.Anchors(140, block=block).runs(np.frombuffer(data, np.uint8))
    first, place, gram = (x.tolist() for x in runs)
    assert first[0] == 0 and first == sorted(set(first)) and all(a != b for a, b in zip(place, place[1:]))
    anchor = {}
    for i, (a, p) in enumerate(zip(first, place)):
        for w in range(a, [*first[1:], len(data) - 139][i]):
            assert w <= p <= w + 140 - repeats.GRAM
            assert anchor.setdefault(data[w:w + 140], p - w) == p - w
    assert all(data[p:p + repeats.GRAM] == data[q:q + repeats.GRAM] for p, g in zip(place, gram)
               for q, h in zip(place[:40], gram) if g == h)


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(3)
    a, b = (bytes(rng.choices(b"abcdefgh", k=300)) for _ in "ab")
    texts = [b"1" + a + b"2", b"3" + a + b"4", b"5" + a[:250] + b"6", b"7" + b + b"8", b"9" + b + b"0"]
    width = 200
    own, place, groups = repeats.maximal_repeats(texts, [len(t) - width + 1 for t in texts], width)
    found = {texts[own[f]][place[f]:place[f] + n]: sorted(zip(own[f:e + 1].tolist(), place[f:e + 1].tolist()))
             for n, f, e in groups}
    assert found[a] == [(0, 1), (1, 1)] and found[a[:250]] == [(0, 1), (1, 1), (2, 1)] and found[b] == [(3, 1), (4, 1)]
    # By the definition: strings that occur twice and whose occurrences can't all be made longer.
    at = defaultdict(set)
    for t, x in enumerate(texts):
        for i in range(len(x) - width + 1):
            for n in range(width, len(x) - i + 1):
                at[x[i:i + n]].add((t, i))
    maximal = {s for s, where in at.items() if len(where) > 1
               and len({texts[t][i - 1:i] or t for t, i in where}) > 1
               and len({texts[t][i + len(s):i + len(s) + 1] or t for t, i in where}) > 1}
    assert maximal == {s for s, where in found.items()}
    assert all(set(where) == at[s] for s, where in found.items())
