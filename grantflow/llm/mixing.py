"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words.  A document is taken ``full``
times, where ``full`` is how often the whole source fits its target, and once
more if its hash lies below the source's threshold.  The threshold is found
without sorting documents: sizes are summed by (source, leading hash bits),
the bucket in which the running sum passes the budget is the boundary, and
only the documents of that bucket go to the next level, which looks at the
next bits.  After the last level the threshold is exact to one hash value.

Every step is a partial aggregate, a window over at most ``2**LEVEL_BITS``
buckets of one source, or a join on (source, bucket): a source that holds a
third of all documents is spread over its buckets like any other.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; rows with a null id are mixed like others (the hash covers id
and text); rows equal in id and text have the same hash and are taken or left
together; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from grantflow.llm.store import staged

LEVEL_BITS = 10
LEVELS = 5
#: Sources in code point order weigh 1, 2, 3, 1, 2, 3, ...
WEIGHT_CYCLE = 3
#: No source gives more than this many times its size.
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 50 bits of md5 over ``id:text`` as a non-negative long."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), text))
    return F.shiftright(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), 2)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> source, source_size, target, full, budget.

    Targets share the total by weight.  A target that would pass
    ``MAX_REPEAT`` times its source stops there and the excess goes to the
    others by weight: with sources ordered by capacity per weight, the capped
    ones are the first k for the least k at which the next source fits its
    share of what is left.  The table has one row per source, so the windows
    without a partition see that many rows, not documents.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("w", (F.row_number().over(by_name) - 1) % WEIGHT_CYCLE + 1) \
        .withColumn("cap", F.col("source_size") * MAX_REPEAT)
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    src = (src.withColumn("k", F.row_number().over(fill) - 1)
           .withColumn("left", (F.sum("source_size").over(every)
                                - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double"))
           .withColumn("w_left", (F.sum("w").over(every)
                                  - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")))
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")
    first = F.min(F.when(fits, F.struct("k", "left", "w_left"))).over(every)
    target = F.when(F.col("k") < F.col("at.k"), F.col("cap").cast("double")) \
        .otherwise(F.col("at.left") * F.col("w") / F.col("at.w_left"))
    full = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0))
    return (src.withColumn("at", first)
            .select("source", "source_size", target.alias("target"), full.cast("long").alias("full"))
            .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size")))


def _bucket(level: int) -> Column:
    return F.shiftright("h", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(2 ** LEVEL_BITS - 1)


def _boundary(rows: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """source, b, budget of the bucket in which each source passes its budget."""
    hist = rows.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("b")
    hist = hist.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "hist_source")
    over = hist.join(budgets, F.col("hist_source").eqNullSafe(F.col("source"))) \
        .where(F.col("upto") > F.col("budget"))
    return over.groupBy("source").agg(F.min(F.struct("b", (F.col("budget") - F.col("upto") + F.col("n"))
                                                     .alias("budget"))).alias("x")) \
        .select("source", "x.b", "x.budget")


def plan(rows: DataFrame) -> DataFrame:
    """(source, size, h) rows -> source, b, source_size, target, full, theta:
    a document whose hash has the leading bits b is taken ``full`` times, and
    once more if its hash is below ``theta``.

    One row per source and leading bits: documents meet the plan on that
    pair, so a large source is spread over its buckets.
    """
    sources = staged(source_targets(rows), "mix-sources")
    level_rows, budgets = rows, sources.select("source", "budget")
    theta = sources.select("source", F.lit(0).cast("long").alias("theta"))
    for level in range(LEVELS):
        cut = staged(_boundary(level_rows, budgets, level), f"mix-cut{level}")
        budgets = cut.select("source", "budget")
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        theta = (theta.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
                 .select("t.source", (F.col("theta") + F.shiftleft(F.col("b").cast("long"), shift)).alias("theta")))
        if level < LEVELS - 1:
            level_rows = staged(
                level_rows.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                           & (_bucket(level) == F.col("c.b")), "left_semi"),
                f"mix-level{level}")
    found = (sources.alias("s").join(theta.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
             .select("s.*", "theta"))
    keys = rows.groupBy("source", _bucket(0).alias("b")).agg(F.lit(1).alias("one"))
    return staged(keys.alias("k").join(found.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")))
                  .select("k.source", "k.b", "source_size", "target", "full", "theta"), "mix-plan")


def with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows that have source and h, with source_size, target and copies."""
    out = rows.withColumn("b", _bucket(0)).alias("r").join(
        planned.alias("p"), (F.col("r.b") == F.col("p.b")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    copies = F.col("full") + F.when(F.col("h") < F.col("theta"), 1).otherwise(0)
    return out.select(*[f"r.{c}" for c in rows.columns], "source_size", "target",
                      copies.cast("long").alias("copies"))


def sized(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What mixing needs of a document: id, source, size, h."""
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, h, source_size, target, copies, taken."""
    rows = staged(docs.select(*sized(id_col, text_col, source_col)), "mix-rows")
    return with_plan(rows, plan(rows)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    need = sized(id_col, text_col, source_col)
    rows = staged(docs.select(*need), "mix-rows")
    whole = docs.select(*need, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_plan(whole.select("source", "h", "row"), plan(rows)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


#: The same rule in DuckDB SQL: documents below the threshold are those whose
#: running size, in hash order with equal hashes together, fits the budget.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) >> 2 AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size,
             (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap,
             row_number() OVER o - 1 AS k,
             CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0) AS DOUBLE) AS lft,
             CAST(sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS DOUBLE) AS w_left
      FROM s
      WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST),
             p AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT k AS k0, lft AS l0, w_left AS w0 FROM f
      WHERE lft * w <= cap * w_left ORDER BY k LIMIT 1),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
             CASE WHEN k < k0 THEN CAST(cap AS DOUBLE) ELSE l0 * w / w0 END AS target
      FROM f, c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
      FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h
                               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
