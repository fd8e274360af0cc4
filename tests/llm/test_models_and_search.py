import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantflow.llm import ann, langid, toxicity
from grantflow.llm.queries import QUERIES
from tests.llm.odd import DOCS, frame, nothing

SMOKE = "/root/testdata/sf0.01"


def taught(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


# -- nearest neighbours ---------------------------------------------------------

def brute(ids, vectors, query, own, k):
    score = (vectors * query).sum(1)
    other = ids != own
    pick = np.lexsort((ids[other], -score[other]))[:k]
    return ids[other][pick].tolist(), score[other][pick]


def test_recall_on_the_whole_table(spark):
    rows = QUERIES["op7_nearest"](spark, SMOKE).toPandas()
    t = spark.read.parquet(f"{SMOKE}/embeddings.parquet").toPandas()
    ids, vectors = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        want, score = brute(ids, vectors, vectors[i], ids[i], 20)
        own = rows[rows.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hits += len(set(want) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.95


@pytest.mark.parametrize("block_rows,query_rows", [(8192, 4096), (60, 7)])
def test_ties_copies_and_unfit_vectors(spark, monkeypatch, block_rows, query_rows):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ann, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 16))
    rows = [(i, base[i].tolist()) for i in range(120)]
    rows += [(1000 + i, base[3].tolist()) for i in range(90)]               # one vector in a third of the rows
    unfit = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16),
             (2080, [1.0, None] * 8), (2100, []), (None, base[5].tolist())]
    lone = [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]                         # another length
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + unfit + lone], "vec_id long, embedding array<double>, rank string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, miss=1e-9).toPandas()
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    asked = {i for i in ids.tolist() if i % 20 == 0}
    assert set(got.query_id) == asked | {3000}
    for q in asked:
        want, score = brute(ids, vectors, vectors[ids.tolist().index(q)], q, 10)
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == want and np.array_equal(own.score, score)
    assert got[got.query_id == 3000].vec_id.tolist() == [3001]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(2, 0.05) == pytest.approx(-2 * np.log(0.05))
    assert ann.chi_square_quantile(8, 0.05) == pytest.approx(15.5073, abs=1e-3)


# -- toxicity -------------------------------------------------------------------

def test_machine_learns_what_two_terms_say_together():
    """Insult or group alone is clean, both together are toxic."""
    rng = np.random.default_rng(1)
    insults, groups = [f"insult{i}" for i in "abc"], [f"group{i}" for i in "abc"]
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        words = [f"w{''.join(chr(97 + c) for c in str(x).encode() if c)}" for x in rng.integers(0, 500, 8)]
        words += [insults[rng.integers(3)]] * int(a) + [groups[rng.integers(3)]] * int(b)
        texts.append(" ".join(words))
        label.append(float(a and b))
    label = np.array(label)
    text, term = toxicity.Terms().of(pa.array(texts))
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    machine = toxicity.fit([term[a:b] for a, b in zip(cut, cut[1:])], label, label.mean())
    number = np.full(toxicity.BUCKETS, -1, np.int32)
    number[machine.buckets] = np.arange(len(machine.buckets))
    probe = ["insulta", "groupb", "insulta groupb", ""]
    alone, other, both, none = machine.scores(*toxicity.Terms(number).of(pa.array(probe)), 4)
    assert both > 0.8 and max(alone, other, none) < 0.3
    assert machine.factors.shape[1] == toxicity.FACTORS and np.abs(machine.factors).max() > 0.1


def test_toxicity_held_out(spark):
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert (rows.held_out == ~rows.doc_id.map(taught)).all() and rows.score.between(0, 1).all()
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = rows.merge(labels, on="doc_id").query("held_out")
    found = held[held.predicted == 1]
    assert found.toxic.mean() > 0.95 and found.toxic.sum() > 0.85 * held.toxic.sum()


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (2, 0, "x"), (None, 1, "x"), (9, None, "x"), (77, 1, "x")],
                                   "doc_id long, toxic int, text string")
    rows = toxicity.score(frame(spark), labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.id is None)
    none = toxicity.score(frame(spark), labels.limit(0)).collect()
    assert len(none) == len(DOCS) and all(r.predicted == 0 for r in none)
    assert toxicity.score(nothing(spark), labels).count() == 0


# -- languages ------------------------------------------------------------------

def test_language_held_out(spark):
    rows = QUERIES["op8_language"](spark, SMOKE).toPandas()
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows.merge(docs, on="doc_id").query("held_out")
    assert len(rows) == len(docs) and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_language_odd_rows(spark):
    rows = langid.identify(frame(spark), carry=True).collect()
    assert len(rows) == len(DOCS)
    assert sorted(str(r.row.text) for r in rows) == sorted(str(d[1]) for d in DOCS)
    for r in rows:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") != letters and 0 <= r.score <= 1
    untaught = langid.identify(frame(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in untaught.collect()} == {("und", 0.0)}
    assert langid.identify(nothing(spark)).count() == 0


def test_network_judges_a_whole_text():
    """A change at the very end of a long text moves its score."""
    a, b = b"alpha beta " * 40, b"gamma delta " * 40
    windows = np.concatenate([langid.windows_of(x * 3) for x in (a, b)])
    label = np.concatenate([np.zeros(len(langid.windows_of(a * 3)), int), np.ones(len(langid.windows_of(b * 3)), int)])
    net = langid.fit(windows, label, ["a", "b"])
    shares = net.classify(windows, net.pairs())
    assert (shares.argmax(1) == label).all()
    tail = net.classify(langid.windows_of(a * 30 + b), net.pairs())
    assert tail[:-4].argmax(1).max() == 0 and tail[-2].argmax() == 1
