"""Language identification with a byte convolutional network in numpy.

A window of ``WINDOW`` bytes passes through filters of several widths; each
filter's strongest answer in the window (max pooling), after a rectifier,
feeds a softmax over the languages.  As the input is one of 256 bytes, a
filter of width w is w tables of 256 rows, and a convolution is table look-ups
and additions.  The network is trained with Adam on windows of at most
``SAMPLE_PER_LANG`` labelled texts of each language.

A text is judged whole: all its consecutive windows, in batches, each weighted
by the bytes it holds; the class shares add up to the text's score.

Defined cases: texts that are null or hold no letter are ``und`` with score 0;
rows without a language or an id teach nothing; an id that teaches with
several texts teaches with the smallest; with no labelled row every text is
``und`` with score 0; rows that repeat an id are each judged; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grantflow.llm.learning import bounded_sample, held_out
from grantflow.llm.chunks import text_slices

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
SAMPLE_PER_LANG, WINDOWS_PER_TEXT = 300, 4
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows that are judged together.
TOGETHER = 256
UNKNOWN = "und"


def windows_of(text: bytes) -> np.ndarray:
    """Consecutive windows of a text, the last filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]       # one of shape (width, 256, FILTERS) per width
    bias: np.ndarray               # of the filters
    dense: np.ndarray
    offset: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Tables over two bytes at once: half the look-ups of a filter."""
        out = []
        for t in self.tables:
            steps = []
            for j in range(0, len(t) - 1, 2):
                steps.append((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(1 << 16, -1).astype(np.float32))
            if len(t) % 2:
                steps.append(t[-1].astype(np.float32))
            out.append(steps)
        return out

    def classify(self, windows: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Class shares of every window."""
        out = np.empty((len(windows), len(self.langs)))
        for at in range(0, len(windows), TOGETHER):
            part = windows[at:at + TOGETHER]
            codes = part[:, :-1].astype(np.intp) << 8 | part[:, 1:]
            pooled = []
            for width, steps in zip(WIDTHS, pairs):
                n = WINDOW - width + 1
                total = steps[0].take(codes[:, :n], axis=0)
                for j, table in enumerate(steps[1:], 1):
                    source = part if len(table) == 256 else codes
                    total += table.take(source[:, 2 * j:2 * j + n], axis=0)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            out[at:at + TOGETHER] = _softmax(hidden @ self.dense + self.offset)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self, values: list[np.ndarray]):
        self.values, self.step = values, 0
        self.mean, self.square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def move(self, slopes: list[np.ndarray]) -> None:
        self.step += 1
        for v, g, m, s in zip(self.values, slopes, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= RATE * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.999 ** self.step)) + 1e-8)


def fit(windows: np.ndarray, label: np.ndarray, langs: list[str], seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    size = FILTERS * len(WIDTHS)
    net = Network(langs, tables, np.zeros(size), rng.normal(0, size ** -0.5, (size, len(langs))), np.zeros(len(langs)))
    adam = _Adam([*tables, net.bias, net.dense, net.offset])
    filters = np.arange(FILTERS)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            x, n = windows[batch], len(batch)
            pooled, places = [], []
            for w, t in zip(WIDTHS, tables):
                total = sum(t[j].take(x[:, j:WINDOW - w + 1 + j], axis=0) for j in range(w))
                place = total.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            before = np.concatenate(pooled, 1) + net.bias
            hidden = np.maximum(before, 0)
            error = _softmax(hidden @ net.dense + net.offset)
            error[np.arange(n), label[batch]] -= 1
            error /= n
            back = (error @ net.dense.T) * (before > 0)
            slopes = []
            for i, (w, t) in enumerate(zip(WIDTHS, tables)):
                g, own = np.zeros_like(t), back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):     # only the strongest place of a filter learns
                    np.add.at(g[j], (x[np.arange(n)[:, None], places[i] + j], filters), own)
                slopes.append(g)
            adam.move([*slopes, back.sum(0), hidden.T @ error, error.sum(0)])
    return net


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Network | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")) \
        .where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("id"))) \
        .where(F.col("text").rlike(r"\p{L}"))
    # Bounded: at most SAMPLE_PER_LANG ids of each language.
    sample = bounded_sample(rows.select("id", "lang").distinct(), "lang", SAMPLE_PER_LANG)
    got = (rows.join(sample, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
           .select("lang", "text").mapInArrow(_sample_windows, "lang string, window binary").toArrow())
    if not got.num_rows:
        return None
    # The rows arrive in no fixed order; the fit must not depend on it.
    found = sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist()))
    langs = sorted({lang for lang, _ in found})
    label = np.array([langs.index(lang) for lang, _ in found])
    return fit(np.stack([np.frombuffer(w, np.uint8) for _, w in found]), label, langs)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of every text, spread evenly over it."""
    for batch in batches:
        lang, out = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            all_of = windows_of(text.encode("utf-8"))
            for i in np.unique(np.linspace(0, len(all_of) - 1, WINDOWS_PER_TEXT).astype(int)):
                lang.append(name)
                out.append(all_of[i].tobytes())
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs() if net else []
        for batch in batches:
            for part in text_slices(batch, 1):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                known = pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False)
                rows = np.flatnonzero(known.to_numpy(zero_copy_only=False)) if net else []
                if len(rows):
                    texts = [t.encode("utf-8") for t in part.column(1).take(pa.array(rows)).to_pylist()]
                    windows = [windows_of(t) for t in texts]
                    shares = net.classify(np.concatenate(windows), pairs)
                    count = np.array([len(w) for w in windows])
                    ends = np.cumsum(count)
                    weight = np.full(len(shares), float(WINDOW))
                    weight[ends - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, count.tolist())]
                    total = np.add.reduceat(shares * weight[:, None], ends - count)
                    total /= total.sum(axis=1, keepdims=True)
                    best = total.argmax(axis=1)
                    for i, row in enumerate(rows.tolist()):
                        names[row], scores[row] = net.langs[best[i]], total[i, best[i]]
                yield pa.record_batch([part.column(0), pa.array(names), pa.array(scores)],
                                      names=["row", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             carry: bool = False) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; with ``carry``
    also ``row``, the input row as a struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else [id_col])])
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_predict(train(docs, id_col, text_col, lang_col)),
                          f"row {kind}, lang_pred string, score double")
    doc_id = F.col("row")[id_col]
    return out.select(doc_id.alias("id"), held_out(doc_id).alias("held_out"), "lang_pred", "score",
                      *(["row"] if carry else []))
