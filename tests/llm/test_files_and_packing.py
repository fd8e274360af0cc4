import gzip
import hashlib
import io
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from grantflow.llm import mixing, packing, repair, warc
from grantflow.llm.pieces import token_ids, vocabulary
from tests.llm.odd import DOCS, WORD, crc, frame, key, nothing

BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def ids_of(name, text):
    return token_ids(vocabulary(name)).lib.encode(text or "", add_special_tokens=False).ids + [1]


# -- archives -----------------------------------------------------------------

BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100
PAGES = [(1, "http://a/", BIG), (2, "http://b/\r\nx: y", BIG), (3, None, BIG), (4, "http://d/", "small"),
         (5, "http://e/", "small"), (6, "http://f/", None), (7, "", ""), (8, "http://g/?q=日本", "y" * 300_000),
         (9, "http://h/", "z" * 999), (10, "http://i/", "z" * 999), (None, "http://j/", BIG),
         (11, "http://k/", "w" * 1000), (11, "http://k/", "w" * 1000)]
PAGE_SCHEMA = "page_id long, url string, html string, id string, sha string, keep string, value string, n string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*p, *"xxxxx") for p in rows], PAGE_SCHEMA).repartition(2)


def test_archive_round_trip(spark):
    folder, index = warc.normalise(spark, warc.write_monolithic(spark, pages(spark)))
    rows = warc.read_records(folder, index).collect()
    largest = defaultdict(list)
    for i, _, html in PAGES:
        largest[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        keep = max((x for x in largest[html or ""] if x is not None), default=None)
        again = len(body) >= 1000 and keep is not None and i != keep
        want.append((key(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                     key(keep if again else None)))
    got = [(key(r.id and int(r.id)), r.payload_bytes, r.payload_digest, r.record_type,
            key(r.refers_to and int(r.refers_to))) for r in rows]
    assert sorted(got) == sorted(want)


def test_archive_of_nothing(spark):
    folder, index = warc.normalise(spark, warc.write_monolithic(spark, pages(spark, [])))
    assert warc.read_records(folder, index).count() == 0


def test_normalised_archive_is_read_by_offset_and_from_its_start(spark):
    folder, index = warc.normalise(spark, warc.write_monolithic(spark, pages(spark)))
    rows = index.orderBy("archive", "offset").collect()
    for name in {r.archive for r in rows}:
        store, path = warc.open_store(f"{folder}/{name}")
        data = store.open_input_stream(path, compression=None).read()
        own = [r for r in rows if r.archive == name]
        cdx = store.open_input_stream(path + ".cdx", compression=None).read().decode().splitlines()[1:]
        assert [line.split()[-2] for line in cdx] == [str(r.offset) for r in own]
        whole = list(warc.split_records(warc.inflate(io.BytesIO(data).read)))
        assert whole == [gzip.decompress(data[r.offset:r.offset + r.length]) for r in own]


def test_urls_with_blanks_keep_the_fields_apart(spark):
    pages = spark.createDataFrame([(1, "http://x/a b\tc\u00a0d", "h" * 2000), (2, "http://x/é", "h" * 2000)],
                                  "page_id long, url string, html string")
    folder, index = warc.normalise(spark, warc.write_monolithic(spark, pages.coalesce(1)))
    lines = []
    for name in {r.archive for r in index.collect()}:
        store, path = warc.open_store(f"{folder}/{name}")
        lines += store.open_input_stream(path + ".cdx", compression=None).read().decode().splitlines()[1:]
    fields = sorted(line.split(" ") for line in lines)
    assert [f[:2] for f in fields] == [["http://x/a%20b%09c%C2%A0d", "warc/revisit"], ["http://x/é", "text/html"]]
    assert all(len(f) == 6 for f in fields)


def test_inflated_chunks_are_bounded():
    data = b"a" * 30_000_000 + b"b"
    chunks = list(warc.inflate(io.BytesIO(gzip.compress(data) + gzip.compress(b"c")).read))
    assert max(map(len, chunks)) <= warc.CHUNK
    assert hashlib.sha1(b"".join(chunks)).digest() == hashlib.sha1(data + b"c").digest()


def test_cut_off_streams_are_refused():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = gzip.compress(record * 3)
    assert list(warc.split_records(warc.inflate(io.BytesIO(packed).read))) == [record] * 3
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(packed[:-9]).read)))
    with pytest.raises(ValueError):
        list(warc.split_records([record[:-5]]))


# -- token shards -------------------------------------------------------------

@pytest.mark.parametrize("tasks", [100_000, 1])
def test_shards_round_trip(spark, monkeypatch, tasks):
    """Many tasks, and one that writes several shards of bounded text."""
    monkeypatch.setattr(repair, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(repair, "MOST_TASKS", tasks)
    folder, manifest = repair.write_shards(frame(spark), WORDS, end_id=1)
    rows = repair.read_shards(folder, manifest, "bigint").collect()
    assert manifest.count() > 2 and (manifest.select("task").distinct().count() <= 2) == (tasks == 1)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.append(0, np.cumsum([r.n_tokens for r in rows]))[:-1].tolist()
    ids = [r.id for r in rows]
    assert ids == sorted((d[0] for d in DOCS), key=lambda i: (i is not None, i or 0))
    want = sorted((key(d[0]), len(x), crc(x)) for d in DOCS for x in [ids_of(WORDS, d[1])])
    assert sorted((key(r.id), r.n_tokens, r.ids_crc32) for r in rows) == want
    empty = repair.read_shards(*repair.write_shards(nothing(spark), WORDS, end_id=1), "bigint")
    assert empty.count() == 0


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(100, 900, 1000)
    docs = [np.append(x, 1).astype(np.uint16) for x in [passage] * 40 + [np.full(n, 7) for n in (1, 2, 3, 500, 4097)]]
    shard = repair.Shard(repair.encode_shard(pa.array(range(len(docs))), docs, 1 << 16))
    assert all((x == y).all() for x, y in zip(shard.documents(0, len(docs)), docs))
    sizes = np.diff(shard.starts)
    assert sizes[:40].max() <= 3                                    # a copy is a symbol or two, and the end
    assert (shard.rules[:, 0] == shard.rules[:, 1]).any() and sizes[44] < 4097 / 8
    inside = np.ones(len(shard.symbols) - 1, bool)
    inside[shard.starts[1:-1] - 1] = False
    pairs = shard.symbols[:-1].astype(np.uint64) << np.uint64(32) | shard.symbols[1:]
    kinds, counts = np.unique(pairs[inside], return_counts=True)
    unequal = kinds >> np.uint64(32) != kinds & np.uint64(0xFFFFFFFF)
    assert counts[unequal].max(initial=0) < repair.LEAST and counts[~unequal].max(initial=0) < 2 * repair.LEAST


def test_random_access():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.zipf(1.3, n).clip(max=900), 1).astype(np.uint16) for n in rng.integers(0, 400, 300)]
    shard = repair.Shard(repair.encode_shard(pa.array(range(len(docs))), docs, 1 << 16))
    assert len(shard.rules) > 50 and len(shard.symbols) < sum(map(len, docs)) * 0.8
    for rule, size in zip(range(len(shard.rules)), shard.lengths.tolist()):
        assert len(repair.expand(np.array([shard.first + rule], np.uint32), shard.table)) == size
    for d, ids in enumerate(docs):
        assert (shard.ids(d) == ids).all()
        a, b = sorted(rng.integers(0, len(ids) + 2, 2).tolist())
        assert shard.ids(d, a, b).tolist() == ids[a:b].tolist()
    assert all((x == y).all() for x, y in zip(shard.documents(10, 200), docs[10:200]))


# -- packing ------------------------------------------------------------------

def check_packing(pieces: pd.DataFrame, texts: list, window=packing.WINDOW):
    """Every id once, sequences gapless; returns the share of padding."""
    s = pieces.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    full = s.groupby("sequence_id").length.sum()
    assert full.max() <= window and (s.length > 0).all()
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(ids_of(BYTE, text))
    for doc_id, own in pieces.groupby("id", dropna=False):
        docs = want.pop(None if pd.isna(doc_id) else doc_id)
        assert own.length.sum() == sum(map(len, docs))
        for r in own.itertuples():
            assert any(len(x) == r.doc_tokens and crc(x[r.start:r.start + r.length]) == r.ids_crc32 for x in docs)
        if len(docs) == 1:
            own = own.sort_values("start")
            assert (own.length.cumsum() - own.length == own.start).all()
    assert not want
    padded = sum(0 if n & (n - 1) == 0 else window - n for n in full)
    return padded / (padded + full.sum())


def test_packing_odd_rows(spark):
    pieces = packing.pack(frame(spark), BYTE, end_id=1).toPandas()
    check_packing(pieces, [d[:2] for d in DOCS])
    assert packing.pack(nothing(spark), BYTE, end_id=1).count() == 0


def test_packing_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for block in (8_000_000, 30_000):
        monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
        pieces = packing.pack(docs, BYTE, end_id=1).toPandas()
        assert check_packing(pieces, [(r.doc_id, r.text) for r in docs.collect()]) < 0.02


def test_least_squares_matches_its_conditions():
    rng = np.random.default_rng(2)
    columns = packing.combinations(16, 3)
    assert (columns.sum(1) == 16).all() and len({tuple(c) for c in columns.tolist()}) == len(columns)
    target = rng.integers(0, 100, 16).astype(float)
    x = packing.non_negative_least_squares(columns, target)
    a = np.zeros((17, len(columns)))
    for d in range(3):
        np.add.at(a, (columns[:, d], np.arange(len(columns))), 1)
    slope = a[1:].T @ (target - a[1:] @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max() < 1e-6


# -- mixing -------------------------------------------------------------------

def plain_targets(size, weight):
    """Shares by weight; what passes three times a source goes to the others."""
    target, left, open_ = {}, sum(size.values()), set(size)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        open_ -= over
    return target


def test_mixing(spark):
    rows = mixing.mix(frame(spark)).collect()
    assert len(rows) == len(DOCS)
    size = defaultdict(int)
    for d in DOCS:
        size[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted(size, key=key)
    target = plain_targets(size, {s: i % 3 + 1 for i, s in enumerate(names)})
    taken, below = defaultdict(int), defaultdict(dict)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        below[r.source].setdefault(r.h, set()).add(r.copies)
    for s in names:
        # Hash order decides, and the next hash would pass the target.
        order = [max(c) for _, c in sorted(below[s].items())]
        assert order == sorted(order, reverse=True) and all(len(c) == 1 for c in below[s].values())
        step = defaultdict(int)
        for r in rows:
            if r.source == s:
                step[r.h] += r.size
        assert taken[s] <= target[s] + 1e-6
        assert taken[s] + max(step.values()) >= target[s] - 1e-6
    again = mixing.mix(frame(spark).repartition(7)).collect()
    assert sorted((key(r.id), r.h, r.copies) for r in again) == sorted((key(r.id), r.h, r.copies) for r in rows)
    copies = mixing.mixed(frame(spark))
    assert copies.columns == frame(spark).columns and copies.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed(nothing(spark)).count() == 0
