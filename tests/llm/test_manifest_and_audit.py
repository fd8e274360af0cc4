import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grantflow.llm import filter_audit, merkle
from tests.llm.odd import DOCS, WORD, frame, key, nothing

LABELS = [(1, 1, 0), (2, 0, 1), (12, 1, 1), (13, 1, None), (13, None, 1), (104, 1, 0), (205, 0, 1), (999, 1, 1),
          (None, 1, 1)]


def labels(spark):
    return spark.createDataFrame([(*x, "x") for x in LABELS], "doc_id long, quality int, toxic int, part string")


# ---------------------------------------------------------------- manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def sides(tree, i):
    for nodes in tree[:-1]:
        run = nodes[i // 16 * 16:i // 16 * 16 + 16]
        yield "".join(run[:i % 16]), "".join(run[i % 16 + 1:])
        i //= 16


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_manifest(docs):
    """docs: (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n in docs:
        own = leaf((doc_id, source, lang, n, text))
        found = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            found = leaf((doc_id, source, lang, n, lowered(text)))
        trees[source].append(((doc_id is not None, doc_id or 0), own, found, doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
    built = {s: levels([x[1] for x in trees[s]]) for s in names}
    whole = levels([built[s][-1][0] for s in names])
    for at, s in enumerate(names):
        for i, (_, own, found, doc_id) in enumerate(trees[s]):
            both = [*sides(built[s], i), *sides(whole, at)]
            node = found
            for a, b in both:
                node = sha(a + node + b)
            yield (doc_id, own, built[s][-1][0], whole[-1][0], sha("".join(a + b for a, b in both)), node,
                   node == whole[-1][0])


def same(rows, docs):
    assert Counter(map(tuple, rows)) == Counter(plain_manifest(docs))


def test_manifest_of_odd_rows(spark):
    docs = frame(spark).withColumn("n_chars", F.length("text"))
    rows = merkle.manifest_of_documents(docs).collect()
    same(rows, [(d[0], d[1], d[2], d[3], None if d[1] is None else len(d[1])) for d in DOCS])
    empty = merkle.manifest_of_documents(nothing(spark).withColumn("n_chars", F.length("text")))
    assert empty.count() == 0 and empty.columns == ["id", *merkle.RESULT, "verified"]


def test_manifest_of_large_and_many_trees(spark):
    """A tree of two rounds, and as many trees as take three levels."""
    docs = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 450}", i % 7) for i in range(7000)]
    docs += [(7001, "Lone", None, "alone", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = merkle.manifest_of_documents(df.repartition(5)).collect()
    same(rows, docs)
    assert any(r.verified for r in rows) and not all(r.verified for r in rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_positions_in_the_log(n):
    nodes = [bytes([i % 251, i // 251]) + b"x" * 30 for i in range(n)]
    height = merkle.height(n)
    log = merkle.append_log(nodes, height)
    tree = levels([x.hex() for x in nodes])
    assert len(tree) == height + 1 and len(log) == 32 * sum(map(len, tree))
    for level, row in enumerate(tree):
        for i, digest in enumerate(row):
            at = 32 * merkle.position(level, i, n)
            assert log[at:at + 32].hex() == digest


# ------------------------------------------------------------ filter audit

def verdict(doc_id, text, docs):
    words = WORD.findall(text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == text for d in docs)}


def plain_audit(docs):
    good, toxic = {x[0] for x in LABELS if x[1] == 1}, {x[0] for x in LABELS if x[2] == 1}
    parts = defaultdict(list)
    for doc_id, text, _, source in docs:
        fails = verdict(doc_id, text or "", docs)
        parts[source or ""].append((fails, doc_id is not None and doc_id in good,
                                    doc_id is not None and doc_id in toxic))
    out = []
    for part, rows in parts.items():
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone),
                              sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone),
                              sum(r[2] for r in gone)))
        out += [(*line, shapley[line[1][line[2] - 1]]) for line in lines]
    return out


def test_filter_audit(spark):
    rich = " ".join(f"w{i}" for i in range(200))
    docs = [*DOCS, (300, rich, "en", "f"), (301, rich + " $", "en", "f"), (302, "A B " * 150, "en", "f"),
            (303, rich, "en", "g"), (304, "é" * 49 + "A", "en", "f"), (305, "é" * 48 + "A", "en", ""),
            (306, " ".join(["x", "y"] * 2 + [f"v{i}" for i in range(196)]), "en", "f")]
    got = filter_audit.audit_documents(frame(spark, docs), labels(spark))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(rows) == sorted(plain_audit(docs))
    assert filter_audit.audit_documents(nothing(spark), labels(spark)).count() == 0


def test_removal_ranks():
    orders, ranks = filter_audit.removal_ranks(3)
    for mask in range(8):
        for o, order in enumerate(orders):
            steps = [s for s, f in enumerate(order, 1) if mask >> f & 1]
            assert ranks[mask, o] == steps[0] if steps else ranks[mask, o] > 3


def test_audit_of_other_filters(spark):
    """Any filters and weights, null verdicts and a null part."""
    df = spark.createDataFrame([("p", True, None), ("p", True, True), (None, False, True)], "s string, x boolean, y boolean")
    got = filter_audit.audit(df, F.col("s"), {"X": F.col("x"), "Y": F.col("y")}, {"both": F.col("x") & F.col("y")})
    assert sorted(map(tuple, got.collect()), key=key) == sorted([
        ("", "XY", 1, 1, 0, 0, 0, 0, 0), ("", "XY", 2, 0, 1, 0, 1, 0, 2),
        ("", "YX", 1, 0, 1, 0, 1, 0, 2), ("", "YX", 2, 0, 0, 0, 0, 0, 0),
        ("p", "XY", 1, 0, 2, 0, 1, 1, 3), ("p", "XY", 2, 0, 0, 1, 0, 0, 1),
        ("p", "YX", 1, 1, 1, 0, 0, 1, 1), ("p", "YX", 2, 0, 1, 1, 1, 0, 3)])
