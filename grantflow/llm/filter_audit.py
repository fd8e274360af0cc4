"""How filters overlap: what each removes at every place in every order.

A row fails any of ``k`` filters: its bit mask.  Rows are counted by (part,
mask) in Spark, with partial aggregates, so a part that holds a third of all
rows is at most ``2 ** k`` rows a task after the first step.  Everything else
follows from those counts and one constant matrix:

* masks as a matrix of 0 (fails) and ``FAR`` (passes), filters across;
* orders as a matrix of positions, the inverse permutations, filters down;
* their min-plus product is the removal rank: the step at which an order
  removes rows of a mask, ``FAR`` and more if never.

The rank scatters the counts of a part, weighted ones too, over (order, step).
A row that fails the filter of a step was removed there or earlier, so what is
redundant at a step is the failures of its filter less the removals.

Defined cases: null text counts as empty; a null part is the part ``''``; the
copy filter compares whole texts table-wide, and a row without an id neither
fails it nor makes others fail; a repeated row counts again, but a row of the
same id and text is not a copy of a smaller id; labels repeated for an id
count once, and ids without labels count as neither good nor toxic; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grantflow.llm.store import staged

#: Beyond every step.
FAR = 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"


def removal_ranks(k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(orders, ranks)``: the orders of ``k`` filters, one a row, and for
    every mask (down) and order (across) the step, from 1, that removes it."""
    orders = np.array(list(itertools.permutations(range(k))))
    position = np.argsort(orders, axis=1).T + 1
    passes = np.where(np.arange(1 << k)[:, None] >> np.arange(k) & 1, 0, FAR)
    return orders, np.min(passes[:, :, None] + position[None], axis=1)


def interactions(counts: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """``counts`` (parts x masks) and ``weights`` (kinds x parts x masks) ->
    arrays over (part, order, step); ``lost`` has one such array per kind."""
    k = counts.shape[1].bit_length() - 1
    orders, ranks = removal_ranks(k)
    steps = np.arange(1, k + 1)
    scatter = (ranks[:, :, None] == steps).astype(np.int64)            # mask, order, step
    removed = np.einsum("pm,mos->pos", counts, scatter)
    lost = np.einsum("wpm,mos->wpos", weights, scatter)
    fails = counts @ (np.arange(1 << k)[:, None] >> np.arange(k) & 1)   # part, filter
    shapley = np.zeros_like(fails)
    for f in range(k):
        shapley[:, f] = removed[:, orders == f].sum(axis=1)
    return {"kept": counts.sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed,
            "redundant": fails[:, orders] - removed, "unique_fails": counts[:, 1 << np.arange(k)][:, orders],
            "shapley": shapley[:, orders], "lost": lost}


def audit(rows: DataFrame, part: Column, fails: dict[str, Column], weights: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``fails`` maps a one-letter name to a boolean Column (null: passes);
    ``weights`` maps a column of the result to a boolean Column that says which
    of the removed rows it counts.
    """
    names, kinds = list(fails), list(weights)
    k = len(names)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    per = (rows.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"),
                       *[F.when(w, 1).otherwise(0).alias(f"w{i}") for i, w in enumerate(weights.values())])
           .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"),
                                        *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(kinds))])
           .groupBy("part").agg(F.collect_list(F.struct("mask", "n", *[f"w{i}" for i in range(len(kinds))]))
                                .alias("masks")))        # 2 ** k entries at most
    columns = ["kept", "removed", "redundant", "unique_fails", *kinds, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = removal_ranks(k)[0]
        words = ["".join(names[f] for f in o) for o in orders]
        for batch in batches:
            parts = batch.column(0).to_pylist()
            counts = np.zeros((1 + len(kinds), len(parts), 1 << k), np.int64)
            for p, masks in enumerate(batch.column(1).to_pylist()):
                for m in masks:
                    counts[:, p, m["mask"]] = [m["n"], *[m[f"w{i}"] for i in range(len(kinds))]]
            got = interactions(counts[0], counts[1:])
            got |= dict(zip(kinds, got.pop("lost")))
            each = len(orders) * k
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), each))),
                 pa.array([w for w in words for _ in range(k)] * len(parts), pa.string()),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(parts) * len(orders))),
                 *[pa.array(got[c].reshape(-1)) for c in columns]],
                ["part", "filter_order", "step", *columns])

    return per.mapInArrow(expand, schema)


def text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's part, its verdict of the five filters and its labels.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of
    the code points in A-Z; D: any of ``#$%&*|``; E: the text of a smaller id.
    Only digests and verdicts are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text")).withColumn(
        "words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    rows = staged(rows.select(
        "doc_id", "source", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes"),
        (words < 200).alias("a"), (100 * distinct < 50 * words).alias("b"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d")), "filter-verdicts")
    # Joined on the id too, so the rows of a text with many copies are spread.
    firsts = rows.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"),
                                        F.max(F.col("toxic") == 1).alias("toxic"))
    return (rows.join(firsts, ["sha", "n_bytes", "doc_id"], "left")
            .withColumn("e", F.col("doc_id").isNotNull() & F.col("first").isNull())
            .drop("sha", "n_bytes", "first").join(told, "doc_id", "left"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = text_filters(docs, labels)
    return audit(rows, F.col("source"), {n: F.col(n.lower()) for n in "ABCDE"},
                 {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT f1.name || f2.name || f3.name || f4.name || f5.name AS filter_order,
         [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(list_slice(bits, 1, step)) - bits[step] AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
