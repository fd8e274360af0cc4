"""SimHash near-duplicates with multi-index hashing.

A document's fingerprint has the bits that are set in over half of the XXH64
hashes (seed 42) of its word shingles, repeats included.  Fingerprints link
when they differ in at most two bits.  Two 32-bit segments index the distinct
fingerprints.  A pair that differs in at most two bits differs in at most one
bit of the high segment, or in two there and in none of the low one.  So each
fingerprint looks up the 33 values within one bit of its high segment and the
one value of its low segment (34 look-ups), and each match is verified over
all 64 bits.

A segment value shared by more than ``CROWDED`` fingerprints is not matched
pair by pair: the look-ups that reach it enumerate the complete fingerprints
that are near enough (at most 529) and match those exactly, so work grows
with the number of fingerprints however similar they are.  Copies of a text
share a fingerprint and enter all of this once.

Defined cases: a null, empty or blank text has no words and fingerprint zero,
linked like any other; fewer words than a shingle are one shingle; rows with
null ids belong to their component but do not name it (the id of a component
of null ids only is null); repeated rows each have their row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grantflow.llm.components import components
from grantflow.llm.store import staged

SEED = 42
#: Fingerprints per segment value that are still compared pair by pair.
CROWDED = 256
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint as an unsigned number; words are split at blank ASCII
    characters and A-Z are lower-cased, both on the UTF-8 bytes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        h = np.fromiter((digest(b" ".join(words[i:i + width]), SEED) for i in range(at, stop)), np.uint64, stop - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.fromiter((fingerprint(t.as_py(), width) for t in part.column(1)), np.uint64, part.num_rows)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(fps.view(np.int64))],
                                      names=["id", "text_hash", "fp"])
    return run


def _masks(bits: int) -> Column:
    """All 32-bit numbers with that many bits set."""
    return F.array(*[F.lit(sum(1 << b for b in x)).cast("long") for x in combinations(range(32), bits)])


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(0xFFFFFFFF)


def _near(value: Column, radius: Column) -> Column:
    """The 32-bit values within ``radius`` (0, 1 or 2) bits of ``value``."""
    one = F.transform(_masks(1), lambda m: value.bitwiseXOR(m))
    two = F.transform(_masks(2), lambda m: value.bitwiseXOR(m))
    none = F.array().cast("array<bigint>")
    return F.concat(F.array(value), F.when(radius >= 1, one).otherwise(none),
                    F.when(radius >= 2, two).otherwise(none))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) -> pairs a < b within two bits."""
    fp = F.col("fp")
    index = fps.select(fp, F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), _high(fp).alias("value")),
        F.struct(F.lit(1).alias("seg"), _low(fp).alias("value")))).alias("x")).select("fp", "x.*")
    crowded = staged(index.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") > CROWDED).select("seg", "value"), "simhash-crowded")
    probes = fps.select(fp, F.explode(F.concat(
        F.transform(_near(_high(fp), F.lit(1)), lambda v: F.struct(F.lit(0).alias("seg"), v.alias("value"))),
        F.array(F.struct(F.lit(1).alias("seg"), _low(fp).alias("value"))))).alias("x")).select("fp", "x.*")
    some = not crowded.isEmpty()
    table = index.join(crowded, ["seg", "value"], "left_anti") if some else index
    found = (probes.alias("p").join(table.alias("t"), ["seg", "value"])
             .where("p.fp < t.fp AND bit_count(p.fp ^ t.fp) <= 2")
             .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")))
    if some:
        # The other half: within the bits that the first half leaves.
        hot = probes.join(crowded, ["seg", "value"])
        own = F.when(F.col("seg") == 0, _high(fp)).otherwise(_low(fp))
        left = F.lit(2) - F.bit_count(own.bitwiseXOR(F.col("value")))
        rest = F.when(F.col("seg") == 0, _low(fp)).otherwise(_high(fp))
        near = hot.select(F.col("fp").alias("a"), "seg", "value", F.explode(_near(rest, left)).alias("other"))
        whole = F.when(F.col("seg") == 0, F.shiftleft("value", 32).bitwiseOR(F.col("other"))) \
            .otherwise(F.shiftleft("other", 32).bitwiseOR(F.col("value")))
        exact = near.select("a", whole.alias("b")).where("a < b") \
            .join(fps.select(fp.alias("b")), "b", "left_semi").select("a", "b")
        found = found.union(exact)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3) -> DataFrame:
    """One row per document: id, text_hash (XXH64 of the text), fp (signed
    long), component_id, and kept: the component's row with the smallest id
    (of rows with that id, the smallest text_hash)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = staged(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
                  .mapInArrow(_fingerprints(width), f"id {kind}, text_hash long, fp long"), "simhash-rows")
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    fps = staged(rows.groupBy("fp").agg(F.min(mine).alias("least")), "simhash-fps")
    roots = components(links(fps.select("fp")))
    rooted = staged(fps.join(roots, F.col("fp") == F.col("node"), "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("least")), "simhash-least")
    named = staged(rooted.select("fp", "root").join(least, "root").select("fp", "least"), "simhash-named")
    return rows.join(named, "fp").select(
        "id", "text_hash", "fp", F.col("least.id").alias("component_id"), mine.eqNullSafe(F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each component, with the columns of ``docs``.  Rows meet
    their decision on id and text hash, so rows that repeat both stay or go
    together; drop exact duplicates first."""
    kept = near_duplicates(docs, id_col, text_col, width).where("kept").select("id", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id"))
                                & (F.col("r.text_hash") == F.col("k.text_hash")), "left_semi").select("row.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
