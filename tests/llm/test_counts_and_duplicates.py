import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from grantflow.llm import components, exact, simhash, token_counts
from grantflow.llm.pieces import token_ids, vocabulary
from tests.llm.odd import DOCS, frame, key, linked, normal, nothing, sha256, simhash as plain_simhash

BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "'", "s", "ll", "re", "1", "!", "　", "日", "\x1c", "\r", "the",
         "<|endoftext|>", "<|endo", "՘", "x", "İ", "Σ", "é", "<|startoftext|>"]
texts = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


def library(name, texts):
    lib = token_ids(vocabulary(name)).lib
    return [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORDS])
@settings(max_examples=150, deadline=None)
@given(batch=st.lists(texts | st.text(max_size=30), max_size=20))
def test_ids_are_the_librarys(name, batch):
    import numpy as np
    tok = token_ids(vocabulary(name))
    got = tok.encode(pa.array([*batch, None], pa.string()))
    assert [np.frombuffer(x, tok.dtype).tolist() for x in got] == library(name, [*batch, ""])


@settings(max_examples=300, deadline=None)
@given(batch=st.lists(st.text(st.characters(max_codepoint=0x17F), max_size=9) | st.from_regex(
    r"[A-Za-zÀ-ÿ]{1,12}['.,;:!?]{0,4}", fullmatch=True), max_size=30))
def test_ids_of_latin_words_are_the_librarys(batch):
    import numpy as np
    tok = token_ids(vocabulary(WORDS))
    assert tok.direct
    got = tok.encode(pa.array([*batch, " ".join(batch)], pa.string()))
    assert [np.frombuffer(x, tok.dtype).tolist() for x in got] == library(WORDS, [*batch, " ".join(batch)])


@settings(max_examples=100, deadline=None)
@given(text=texts | st.text(max_size=25))
def test_count_of_every_prefix(text):
    steps = token_counts._prefix_steps(vocabulary(BYTE)).encode(pa.array([text]))[0]
    counts = token_counts.counts(steps).tolist()
    assert counts == [len(x) for x in library(BYTE, [text[:k] for k in range(1, len(text) + 1)])] if text else not counts


def test_truncation_needs_no_tokenizer(spark):
    rows = token_counts.prefix_counts(frame(spark), BYTE, budget=7).collect()
    texts = sorted((d[1] or "") for d in DOCS)
    assert len(rows) == len(DOCS)
    by = {r.id: r for r in rows if r.id is not None and r.id != 12}
    for doc_id, text, *_ in DOCS:
        if doc_id in by and len(text or "") < 500:
            prefixes = [len(x) for x in library(BYTE, [(text or "")[:k] for k in range(len(text or "") + 1)])]
            assert by[doc_id].fit_chars == max(k for k, n in enumerate(prefixes) if n <= 7)
    assert sorted(r.n_tokens for r in rows) == sorted(len(x) for x in library(BYTE, texts))
    assert sorted(r.n_bytes for r in rows) == sorted(len(t.encode()) for t in texts)
    assert token_counts.prefix_counts(nothing(spark), BYTE, budget=7).count() == 0


def test_exact_duplicates(spark):
    rows = exact.duplicates(frame(spark)).collect()
    groups = defaultdict(list)
    for d in DOCS:
        groups[normal(d[1])].append(d[0])
    want = sorted((key(i), key(min(ids, key=key)), len(ids), sha256(text))
                  for text, ids in groups.items() for i in ids)
    assert sorted((key(r.id), key(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups)                       # of repeated rows exactly one
    assert all(r.id == r.keep_id for r in kept)
    assert exact.duplicates(nothing(spark)).count() == 0
    stay = exact.without_duplicates(frame(spark))
    assert stay.columns == frame(spark).columns
    assert sorted(normal(r.text) for r in stay.collect()) == sorted(groups)


def test_exact_duplicates_over_many_runs(spark):
    """More runs than one merge takes, and one text in a third of the rows."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    rows = exact.duplicates(docs.repartition(40)).toPandas()
    text = rows.id.map(lambda i: "hot" if i % 3 == 0 else f"t{i % 700}")
    groups = rows.groupby(text).id
    assert (groups.transform("min") == rows.keep_id).all()
    assert (groups.transform("size") == rows.group_size).all()
    assert (rows.kept == (rows.id == rows.keep_id)).all()


@pytest.mark.parametrize("crowded", [256, 1])
def test_simhash(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rows = simhash.near_duplicates(frame(spark)).collect()
    prints = {t: plain_simhash(t) for t in {d[1] for d in DOCS}}
    root, names = linked(prints.values()), defaultdict(list)
    for d in DOCS:
        names[root[prints[d[1]]]].append(d[0])
    want = sorted((key(d[0]), f"{prints[d[1]]:016x}", key(min(names[root[prints[d[1]]]], key=key))) for d in DOCS)
    assert sorted((key(r.id), f"{r.fp & (1 << 64) - 1:016x}", key(r.component_id)) for r in rows) == want
    assert simhash.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("crowded", [256, 2])
def test_links_lose_nothing(spark, monkeypatch, crowded):
    """Dense balls of fingerprints, with the sign bit and both segments hit."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(
        spark.createDataFrame(signed, "fp long")).collect()}
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert {frozenset(x) for x in got} == want and len(got) == len(want)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    nodes = list(range(200))
    rng.shuffle(nodes)
    links = list(zip(nodes, nodes[1:100])) + list(zip(nodes[101:], nodes[102:])) + [(5000, 5000), (7, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    first, second = min(nodes[:100]), min(nodes[101:])
    assert got == {n: first for n in nodes[:100]} | {n: second for n in nodes[101:]}


def test_digest_runs_are_not_sorted_for_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(exact, "staged", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or df)
    exact.digest_runs(frame(spark), "doc_id", "text")
    assert len(plans) == 1 and "Sort" not in plans[0]
