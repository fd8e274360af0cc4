"""The corpus pipeline against a plain version of its first four stages."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from grantflow.llm.store import staged
from tests.llm.odd import WORD, frame, key, linked, normal, nothing, simhash
from tests.llm.test_files_and_packing import check_packing, plain_targets


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], "unused"), f"test-{name}"))
    return out


def smallest(groups):
    return sorted(min(g, key=lambda r: key(r[0])) for g in groups.values())


@pytest.mark.parametrize("source", ["odd", "/root/testdata/sf0.001"])
def test_stages(spark, source):
    if source == "odd":
        docs = frame(spark).where("doc_id IS NOT NULL")
    else:
        docs = spark.read.parquet(f"{source}/documents.parquet")
    raw, told, exact, near, mixed, packed = stages(spark, docs)
    for stage in (told, exact, near, mixed):
        assert stage.columns == docs.columns

    rows = sorted((r.doc_id, r.text) for r in raw.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted((r.doc_id, r.text) for r in told.collect()) == rows

    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    rows = smallest(groups)
    assert sorted((r.doc_id, r.text) for r in exact.collect()) == rows

    prints = {r: simhash(r[1]) for r in rows}
    root, groups = linked(prints.values()), defaultdict(list)
    for r in rows:
        groups[root[prints[r]]].append(r)
    rows = smallest(groups)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == rows

    source_of = {(r.doc_id, r.text): r.source for r in near.collect()}
    size = defaultdict(int)
    for r in rows:
        size[source_of[r]] += len(WORD.findall(r[1]))
    names = sorted(size, key=key)
    target = plain_targets(size, {s: i % 3 + 1 for i, s in enumerate(names)})
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1]))
        taken[source_of[r]] += copies[r] * n
        largest[source_of[r]] = max(largest[source_of[r]], n)
    for s in names:
        assert target[s] - largest[s] <= taken[s] <= target[s] + 1e-6

    pieces = packed.toPandas().rename(columns={"doc_id": "id"})
    check_packing(pieces, [r for r, n in copies.items() for _ in range(n)])


def test_empty_table(spark):
    assert stages(spark, nothing(spark))[-1].count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
