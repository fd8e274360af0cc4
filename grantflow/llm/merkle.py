"""Merkle manifest of a dataset as a postorder append log.

Each row is a leaf.  The leaves of a tree ascend by id; every 16 consecutive
nodes become one, level by level, until one is left, the subroot; the subroots
in order of their trees become the root in the same way.

**Ranks** need no sort in one task: rows are range-partitioned and sorted by
(tree, id), and a leaf's rank is its place in its partition plus the rows of
its tree in the partitions before (one small row per tree and partition).

**Builders** are aligned: each takes ``16 ** LEVELS`` consecutive leaves of a
tree and appends every node to its segment when it is complete, children
before their parent.  Tops of the segments are the leaves of the next round, so
a tree of ``n`` leaves takes ``log(n) / (4 * LEVELS)`` rounds, and no task
ever holds more than one segment of a tree, however large the tree is.

**Addresses** follow from subtree sizes alone (:func:`position`): before leaf
``e`` stand ``e`` leaves and, for each level ``g``, ``e // 16 ** g`` complete
nodes; the nodes that end with ``e`` follow it level by level.

**Proofs** are read from the log, top down: each segment passes to its leaves
the siblings found at their addresses, followed by those it got itself.

Defined cases: a null field is ``-``, so null and empty text differ; the null
tree comes first; null ids come before all others of their tree; rows that
share tree and id are ordered by their leaf, and rows equal in all fields are
leaves of their own with the same digest; a lone leaf is its own subroot, a
lone subroot the root, with proofs of no siblings; an empty table has no
tree and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grantflow.llm.store import staged

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels that one builder completes: segments of 4,096 leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
#: A tree: null or not (null trees first), and its name.
TREE = ["named", "tree"]


def position(level: int, index: int, leaves: int) -> int:
    """Where the log of a tree holds node ``index`` of ``level``."""
    last = min((index + 1) << FAN_BITS * level, leaves) - 1
    at, nodes = last + level, last >> FAN_BITS
    while nodes:
        at, nodes = at + nodes, nodes >> FAN_BITS
    return at


def height(leaves: int) -> int:
    h = 0
    while leaves > 1:
        h, leaves = h + 1, -(-leaves // FAN)
    return h


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The digests of all nodes of up to ``levels`` levels, in completion order."""
    log, open_runs = bytearray(), [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves, 1):
        node = leaf
        log += node
        for level in range(levels):
            open_runs[level].append(node)
            if i % (FAN << FAN_BITS * level) and i < len(leaves):
                break
            node = hashlib.sha256(b"".join(open_runs[level]).hex().encode()).digest()
            open_runs[level].clear()
            log += node
    return bytes(log)


def run_of(log: bytes, leaves: int, level: int, index: int) -> tuple[int, list[bytes]]:
    """Place of a node among the up to 16 of its run, and their digests."""
    first, n = index & -FAN, -(-leaves >> FAN_BITS * level)
    at = [32 * position(level, i, leaves) for i in range(first, min(first + FAN, n))]
    return index - first, [log[a:a + 32] for a in at]


def _levels(leaves: int) -> int:
    return min(LEVELS, height(leaves))


def _block(rank: Column) -> Column:
    return F.shiftright(rank, FAN_BITS * LEVELS)


def _above(size: Column) -> Column:
    """Nodes ``LEVELS`` levels above ``size`` nodes."""
    return _block(size + (1 << FAN_BITS * LEVELS) - 1)


def ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0 in its tree) and ``size`` of the tree."""
    by = [F.col(c).asc_nulls_first() for c in [*tree, *order]]
    rows = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("task", F.shiftright("at", 33))
    per = rows.groupBy(*tree, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*tree) if tree else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = staged(per.select(*tree, "task", (before - F.col("first")).alias("shift"),
                            F.sum("n").over(whole).alias("size")), f"{name}-tasks")
    return rows.join(per, [*tree, "task"]).withColumn("rank", F.col("at") + F.col("shift")) \
        .drop("at", "task", "shift")


def _clustered(rows: DataFrame) -> DataFrame:
    """The rows of a block together, by rank; no block has over 4,097 rows."""
    return rows.repartition(*TREE, "block").sortWithinPartitions(*TREE, "block", "rank")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*TREE, "size", "block", "segment"]
    key, leaves = None, []

    def made(rows):
        columns = zip(*[(*k[:2], k[2], k[3], append_log(x, _levels(k[2]))) for k, x in rows])
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        done = []
        for *k, digest in zip(*[batch.column(c).to_pylist() for c in range(5)]):
            if k != key:
                if leaves:
                    done.append((key, leaves))
                key, leaves = k, []
            leaves.append(digest)
        if done:
            yield made(done)
    if leaves:
        yield made([(key, leaves)])


def grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """(named, tree, size, rank, digest) -> the log, one table per round of
    (named, tree, size, block, segment); ``size`` counts the round's leaves."""
    rounds = []
    while True:
        rows = leaves.select(*TREE, "size", _block(F.col("rank")).alias("block"), "digest", "rank")
        schema = "named boolean, tree string, size long, block long, segment binary"
        rounds.append(staged(_clustered(rows).select(*TREE, "size", "block", "digest").mapInArrow(_segments, schema),
                             f"{name}-log{len(rounds)}"))
        tops = rounds[-1].select(*TREE, _above(F.col("size")).alias("size"), F.col("block").alias("rank"),
                                 top(F.col("segment")).alias("digest")).where("size > 1")
        if tops.isEmpty():
            return rounds
        leaves = tops


def top(segment: Column) -> Column:
    return F.substring(segment, -32, 32)


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(named, tree, digest) of every tree."""
    return functools.reduce(DataFrame.unionAll, [
        r.where(_above(F.col("size")) == 1).select(*TREE, top(F.col("segment")).alias("digest")) for r in rounds])


def _pack(place: int, run: list[bytes]) -> bytes:
    return bytes((place, len(run) - 1)) + b"".join(run[:place] + run[place + 1:])


def _unpack(path: bytes) -> list[tuple[str, str]]:
    """Per level the hex digests left and right of the node."""
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        out.append((path[at + 2:at + 2 + 32 * place].hex(), path[at + 2 + 32 * place:at + 2 + 32 * n].hex()))
        at += 2 + 32 * n
    return out


def _leaves_below(size: int, block: int) -> int:
    return min(size - (block << FAN_BITS * LEVELS), 1 << FAN_BITS * LEVELS)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf of a segment with its siblings up to the top of all."""
    for batch in batches:
        for named, tree, size, block, segment, path, root in zip(*[c.to_pylist() for c in batch.columns]):
            n, first = _leaves_below(size, block), block << FAN_BITS * LEVELS
            here = [b"".join(_pack(*run_of(segment, n, level, i >> FAN_BITS * level)) for level in range(_levels(size)))
                    for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([named] * n, pa.bool_()), pa.array([tree] * n, pa.string()),
                 pa.array(range(first, first + n), pa.int64()), pa.array([p + path for p in here], pa.binary()),
                 pa.array([root] * n, pa.binary())], [*TREE, "rank", "path", "root"])


def descend(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """Segments of the first round with ``path``, the siblings of their top up
    to the last root, and ``root``, that of their own tree.  ``above`` has
    (named, tree, path) of the trees' roots; without it their paths are empty."""
    known = None
    for i, log in reversed(list(enumerate(rounds))):
        if above is None:
            own = log.where(_above(F.col("size")) == 1).withColumn("path", F.unhex(F.lit("")))
        else:
            own = log.where(_above(F.col("size")) == 1).join(above.select(*TREE, "path"), TREE)
        own = own.withColumn("root", top(F.col("segment")))
        if known is not None:
            own = own.unionByName(log.join(known.withColumnRenamed("rank", "block"), [*TREE, "block"]))
        if i:
            known = staged(paths(own), f"merkle-paths{i}")
    return own


def paths(segments: DataFrame) -> DataFrame:
    """(named, tree, rank, path, root) of every leaf of the segments."""
    return segments.select(*TREE, "size", "block", "segment", "path", "root") \
        .mapInArrow(_paths, "named boolean, tree string, rank long, path binary, root binary")


def _folded(schema: pa.Schema):
    """Rows of one block: first its segment (rank -1), then its leaves."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out = [[] for _ in schema.names]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                r = dict(zip(names, row))
                if r["rank"] < 0:
                    n, first, segment = _leaves_below(r["size"], r["block"]), r["block"] << FAN_BITS * LEVELS, r["segment"]
                    levels, upper = range(_levels(r["size"])), _unpack(r["path"])
                    rest, runs = "".join(a + b for a, b in upper), {}
                    subroot, root = r["subroot"].hex(), r["root"].hex()
                    continue
                sides = []
                for level in levels:
                    index = r["rank"] - first >> FAN_BITS * level
                    if (level, index) not in runs:
                        place, run = run_of(segment, n, level, index)
                        runs[level, index] = b"".join(run[:place]).hex(), b"".join(run[place + 1:]).hex()
                    sides.append(runs[level, index])
                proof = hashlib.sha256(("".join(a + b for a, b in sides) + rest).encode()).hexdigest()
                node = r["tampered"].hex()
                for a, b in (*sides, *upper):
                    node = hashlib.sha256((a + node + b).encode()).hexdigest()
                for column, v in zip(out, (r["id"], r["digest"].hex(), subroot, root, proof, node, node == root)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema.names)

    return fold


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields, each with its length, ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                        F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, tampered: Column, found: dict[str, Column], id_col: str = "doc_id",
             tree_col: str = "source", fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Build and verify the manifest of ``docs``.

    The proofs hold for the rows as they are; they are checked against rows
    as they are ``found``: where ``tampered``, the fields named by ``found``
    have the values given there.  Returns (rows, log of the trees, log of the
    root): id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every row, and the tables of log segments, one per round.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    leaf, other = digest_of(list(cols.values())), digest_of([found.get(c, v) for c, v in cols.items()])
    tree = F.col(f"`{tree_col}`").cast("string")
    rows = docs.select(tree.isNotNull().alias("named"), F.coalesce(tree, F.lit("")).alias("tree"),
                       F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"),
                       F.when(tampered, other).otherwise(leaf).alias("tampered"))
    rows = staged(ranked(rows, TREE, ["id", "digest", "tampered"], "merkle-leaves"), "merkle-ranked")
    trees = grow(rows, "merkle-trees")
    subroots = staged(ranked(roots(trees), [], TREE, "merkle-subroots"), "merkle-subroots-ranked")
    one_tree = [F.lit(True).alias("named"), F.lit("").alias("tree")]
    whole = grow(subroots.select(*one_tree, "size", "rank", "digest"), "merkle-root")
    above = staged(subroots.select(*TREE, "rank").join(paths(descend(whole, None)).drop(*TREE), "rank").drop("rank"),
                   "merkle-above")
    segments = descend(trees, above).withColumnRenamed("root", "subroot").join(above.select(*TREE, "root"), TREE)
    both = segments.withColumn("rank", F.lit(-1).cast("long")).unionByName(
        rows.withColumn("block", _block(F.col("rank"))), allowMissingColumns=True)
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                        *[T.StructField(c, T.StringType()) for c in RESULT], T.StructField("verified", T.BooleanType())])
    return _clustered(both).mapInArrow(_folded(to_arrow_schema(out)), out), trees, whole


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against rows of which those
    whose crc32(id) is divisible by 5 have their text in lower case."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, picked, {"text": F.translate("text", UPPER, LOWER)})[0]


def _oracle(levels: int = 6) -> str:
    """Trees of up to ``16 ** levels`` leaves, level by level."""
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))")
    leaf = [f"sha256({' || '.join(field(lower if c == 'text' and low else c) for c in FIELDS)})" for low in (0, 1)]
    out = [f"""d AS (SELECT doc_id, source, {leaf[0]} AS leaf,
  CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf[1]} ELSE {leaf[0]} END AS other FROM documents)""",
           """d1 AS (SELECT *, row_number() OVER () AS r,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d)""",
           "t0 AS (SELECT s, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM d1)",
           "p0 AS (SELECT r, s, i, '' AS proof, other AS h FROM d1)"]

    def level(node: str, proof: str, k: int) -> None:
        out.append(f"""{node}g{k} AS (SELECT s, i // 16 AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM {node}{k} GROUP BY ALL)""")
        out.append(f"""{node}{k + 1} AS (SELECT s, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h,
  (n + 15) // 16 AS n FROM {node}g{k})""")
        left, right = "array_to_string(hs[1:p.i % 16], '')", "array_to_string(hs[p.i % 16 + 2:], '')"
        out.append(f"""{proof}{k + 1} AS (SELECT r, s, p.i // 16 AS i,
  CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN n = 1 THEN p.h ELSE sha256({left} || p.h || {right}) END AS h
  FROM {proof}{k} p JOIN {node}g{k} g USING (s) WHERE g.i = p.i // 16)""")

    for k in range(levels):
        level("t", "p", k)
    out.append(f"u0 AS (SELECT 0 AS s, s AS i, h, count(*) OVER () AS n FROM t{levels})")
    out.append(f"q0 AS (SELECT r, 0 AS s, s AS i, proof, h FROM p{levels})")
    for k in range(levels):
        level("u", "q", k)
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, t{levels}.h AS subroot, u{levels}.h AS root, sha256(proof) AS proof_sha256,
       q{levels}.h AS folded_root, q{levels}.h = u{levels}.h AS verified
FROM d1 JOIN t{levels} USING (s) JOIN q{levels} ON d1.r = q{levels}.r, u{levels}"""


ORACLE_SQL = _oracle()
