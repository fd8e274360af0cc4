"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first four and
five letters (which meet inflected and compound forms), hashed to
``BUCKETS``.  The score is the logistic function of

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms i, j of the text: the second sum lets two terms say together
what neither says alone.  It is trained with AdaGrad on at most
``SAMPLE_PER_LABEL`` labelled rows of each label, on the terms that are
associated with the label there (chi-square), and its intercept is moved to
the share of toxic rows among all rows it may learn from.

Defined cases: null and empty texts have no terms and get the score of the
intercept; labels without a document, null labels and null ids teach nothing;
an id labelled twice counts as toxic if one label says so; without rows of
both labels every score is the share of toxic rows (0 without labels); rows
that repeat an id are each scored; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grantflow.llm.learning import bounded_sample, held_out
from grantflow.llm.chunks import ragged, space_chunks, text_slices

BUCKETS = 1 << 20
SAMPLE_PER_LABEL = 5_000
FACTORS = 4
#: Least chi-square and number of rows of a term that is learned, and most terms.
ASSOCIATED, SUPPORT, MOST_TERMS = 24.0, 4, 4_096
EPOCHS, RATE, DECAY = 20, 0.15, 1e-4
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
CACHE_SIZE = 300_000


def terms_of(chunk: str) -> list[int]:
    """Hashed terms of a stretch of text."""
    import xxhash
    out = []
    for word in _WORD.findall(chunk.lower()):
        out += [xxhash.xxh64_intdigest(t) % BUCKETS for t in (word, "^" + word[:4], "^" + word[:5])]
    return out


class Terms:
    """Distinct terms of texts, each distinct stretch hashed once; with
    ``numbers`` (bucket -> number, -1 for others) only those terms."""

    def __init__(self, numbers: np.ndarray | None = None):
        self.numbers, self.cache = numbers, {}

    def _chunk(self, chunk: str) -> np.ndarray:
        got = np.array(terms_of(chunk), np.int32)
        if self.numbers is not None:
            got = self.numbers[got]
            got = got[got >= 0]
        if len(self.cache) >= CACHE_SIZE:
            self.cache.clear()
        if len(chunk) <= 48:
            self.cache[chunk] = got
        return got

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text number, term) pairs, distinct and in order."""
        words, index, at = space_chunks(pc.fill_null(texts, ""))
        found = [x if x is not None else self._chunk(w) for w, x in zip(words, map(self.cache.get, words))]
        length = np.fromiter(map(len, found), np.int64, len(found))
        used = length[index] > 0
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[used]
        index = index[used]
        runs, _ = ragged(np.cumsum(length) - length, length, index)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        pairs = np.unique(np.repeat(text, length[index]) << 32 | flat[runs].astype(np.int64))
        return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Machine:
    buckets: np.ndarray          # of the terms that are learned
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from (text, term number) pairs."""
        z = self.bias + np.bincount(text, self.linear[term], n)
        for v in self.factors.T:
            own = v[term]
            z += 0.5 * (np.bincount(text, own, n) ** 2 - np.bincount(text, own * own, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def associated(text: np.ndarray, term: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Buckets whose presence goes with the label, strongest first."""
    n, toxic = len(label), label.sum()
    kinds, where = np.unique(term, return_inverse=True)
    count = np.bincount(where, minlength=len(kinds)).astype(float)
    both = np.bincount(where, label[text], len(kinds))
    cross = both * n - count * toxic
    spread = count * (n - count) * toxic * (n - toxic)
    chi = np.divide(n * cross ** 2, spread, out=np.zeros(len(kinds)), where=spread > 0)
    use = np.flatnonzero((chi >= ASSOCIATED) & (count >= SUPPORT))
    return kinds[use[np.lexsort((kinds[use], -chi[use]))][:MOST_TERMS]]


def fit(docs: list[np.ndarray], label: np.ndarray, share: float, seed: int = 5) -> Machine:
    """A machine from the terms of every sampled text and its label; ``share``
    is the label's share among all rows that may teach."""
    n = len(docs)
    if not n or not 0 < label.sum() < n:
        return Machine(np.zeros(0, np.int64), _logit(share), np.zeros(0), np.zeros((0, FACTORS)))
    text = np.repeat(np.arange(n), [len(d) for d in docs])
    term = np.concatenate(docs).astype(np.int64)
    buckets = associated(text, term, label)
    number = np.full(BUCKETS, -1)
    number[buckets] = np.arange(len(buckets))
    rows = [x[x >= 0] for x in (number[d] for d in docs)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS))
    b = _logit(label.mean())
    gw, gv, gb = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            size = np.array([len(rows[i]) for i in batch])
            at = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), size)
            summed = np.stack([np.bincount(of, v[at, f], len(batch)) for f in range(FACTORS)], 1)
            z = b + np.bincount(of, w[at], len(batch)) \
                + 0.5 * ((summed ** 2).sum(1) - np.bincount(of, (v[at] ** 2).sum(1), len(batch)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]
            slope = error / len(batch)
            hit = np.unique(at)
            dw, dv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(dw, at, slope[of])
            np.add.at(dv, at, slope[of][:, None] * (summed[of] - v[at]))
            dw[hit] += DECAY * w[hit]
            dv[hit] += DECAY * v[hit]
            gw[hit] += dw[hit] ** 2
            gv[hit] += dv[hit] ** 2
            gb += slope.sum() ** 2
            w[hit] -= RATE * dw[hit] / np.sqrt(gw[hit])
            v[hit] -= RATE * 0.2 * dv[hit] / np.sqrt(gv[hit])
            b -= RATE * slope.sum() / np.sqrt(gb)
    return Machine(buckets, float(b + _logit(share) - _logit(label.mean())), w, v)


def _logit(p: float) -> float:
    p = min(max(float(p), 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for part in text_slices(batch, 1):
            text, term = terms.of(part.column(1))
            ends = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32()))],
                                  names=["toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Machine:
    rows = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
            .where("id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("id")))
            .groupBy("id").agg(F.max("toxic").alias("toxic")))
    count = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most SAMPLE_PER_LABEL ids of each of two labels.
    sample = bounded_sample(rows.where("toxic IN (0, 1)"), "toxic", SAMPLE_PER_LABEL)
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(sample, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    got = texts.select("toxic", "text").mapInArrow(_sample_terms, "toxic int, terms array<int>").toArrow()
    docs_terms = [x for x in got.column("terms").combine_chunks().to_numpy(zero_copy_only=False)] \
        if got.num_rows else []
    share = count.get(1, 0) / max(1, count.get(0, 0) + count.get(1, 0))
    label = got.column("toxic").to_numpy().astype(float)
    # The rows arrive in no fixed order; the fit must not depend on it.
    order = sorted(range(len(docs_terms)), key=lambda i: (label[i], docs_terms[i].tobytes()))
    return fit([docs_terms[i] for i in order], label[order], share)


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int32)
        number[machine.buckets] = np.arange(len(machine.buckets))
        terms = Terms(number)
        for batch in batches:
            for part in text_slices(batch, 1):
                text, term = terms.of(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(machine.scores(text, term, part.num_rows))],
                                      names=["id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    machine = train(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_score(machine), f"id {kind}, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
