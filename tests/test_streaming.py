"""Incremental ingest: only new files are processed; re-running is a no-op."""

import os

import pytest
from pyspark.sql import functions as F

from grantflow.plans.frames import landing_frame
from grantflow.streaming import ingest
from grantflow.streaming.ingest import committed, ingest_landing, paths

SMOKE = "/root/testdata/sf0.001"


def rows(spark, p):
    return sum(spark.read.parquet(p[t]).count() for t in ("grants", "quarantine"))


def test_a_replayed_batch_writes_what_it_wrote(spark, tmpdir_, monkeypatch):
    """The write of the counts fails: the batch is not shown, and the next run
    replays it into the same places."""
    p = paths(tmpdir_)
    g = landing_frame(spark, SMOKE).drop("row_no")
    g.write.parquet(p["landing"])
    with monkeypatch.context() as m:
        m.setattr(ingest.F, "current_timestamp", lambda: 1 / 0)
        with pytest.raises(Exception):
            ingest_landing(spark, p["landing"], g.schema, p["grants"], p["checkpoint"], p["ingest_runs"])
    assert rows(spark, p) == g.count() and not os.path.exists(p["ingest_runs"])
    ingest_landing(spark, p["landing"], g.schema, p["grants"], p["checkpoint"], p["ingest_runs"])
    assert rows(spark, p) == g.count()
    shown = [committed(spark, p[t], p["ingest_runs"]).count() for t in ("grants", "quarantine")]
    assert sum(shown) == g.count() and min(shown) > 0


def test_ingest_of_files_with_different_layouts(spark, tmpdir_):
    p = paths(tmpdir_)
    os.makedirs(p["landing"])
    for name, text in {
            "a.csv": 'Project/Area Number,source_id,Total Cost (Overall)\nA1,s,10\nA2,s,TBD\nA3,s,1,2\n',
            "b.csv": 'source_id,Project/Area Number\nt,"B1\nx"\n', "notes.txt": "no landing"}.items():
        with open(os.path.join(p["landing"], name), "w") as f:
            f.write(text)
    schema = "`Project/Area Number` string, `Total Cost (Overall)` string, source_id string"
    ingest_landing(spark, p["landing"], spark.createDataFrame([], schema).schema, p["grants"], p["checkpoint"],
                   p["ingest_runs"], fmt="csv", files_per_trigger=1)
    good = spark.read.parquet(p["grants"]).collect()
    assert sorted((r.grant_id, r.source_id, r.amount and str(r.amount)) for r in good) == [
        ("A1", "s", "10.00"), ("B1\nx", "t", None)]
    bad = {tuple(r.quarantine_reasons): (r.grant_id, r.record) for r in spark.read.parquet(p["quarantine"]).collect()}
    assert bad == {("amount_invalid",): ("A2", None), ("unreadable",): (None, "A3,s,1,2")}
    counts = {r.source_id: (r.n_rows, r.n_quarantined) for r in spark.read.parquet(p["ingest_runs"]).collect()}
    assert counts == {"s": (3, 2), "t": (1, 0)}


def test_json_files_of_several_batches(spark, tmpdir_):
    p = paths(tmpdir_)
    os.makedirs(p["landing"])
    for i in range(3):
        with open(os.path.join(p["landing"], f"{i}.json"), "w") as f:
            f.write(f'{{"Project/Area Number": "A{i}", "source_id": "s"}}\n{{"Project/Area\n')
    schema = spark.createDataFrame([], "`Project/Area Number` string, source_id string").schema
    ingest_landing(spark, p["landing"], schema, p["grants"], p["checkpoint"], p["ingest_runs"], fmt="json",
                   files_per_trigger=1)
    assert schema.names == [f.name for f in schema.fields] == ["Project/Area Number", "source_id"]
    good = spark.read.parquet(p["grants"]).collect()
    assert sorted(r.grant_id for r in good) == ["A0", "A1", "A2"] and {r.batch_id for r in good} == {0, 1, 2}
    assert [r.record for r in spark.read.parquet(p["quarantine"]).collect()] == ['{"Project/Area'] * 3


def test_ingest_incremental_and_idempotent(spark, tmpdir_):
    p = paths(tmpdir_)
    g = landing_frame(spark, SMOKE).drop("row_no")
    first, second = g.filter(F.col("source_id") != "mkt_building"), g.filter(F.col("source_id") == "mkt_building")
    first.write.mode("append").parquet(p["landing"])
    ingest_landing(spark, p["landing"], g.schema, p["grants"], p["checkpoint"], p["ingest_runs"])
    n1 = rows(spark, p)
    assert n1 == first.count()

    # Nothing new: a second run writes nothing and changes nothing.
    ingest_landing(spark, p["landing"], g.schema, p["grants"], p["checkpoint"], p["ingest_runs"])
    assert rows(spark, p) == n1

    # New drop: only the new files are processed.
    second.write.mode("append").parquet(p["landing"])
    ingest_landing(spark, p["landing"], g.schema, p["grants"], p["checkpoint"], p["ingest_runs"])
    assert rows(spark, p) == g.count()
    good, bad = spark.read.parquet(p["grants"]), spark.read.parquet(p["quarantine"])
    assert good.where(F.size("quarantine_reasons") > 0).isEmpty() and bad.where(F.size("quarantine_reasons") == 0).isEmpty()
    assert good.select("grant_id").unionAll(bad.select("grant_id")).distinct().count() == g.count()
    # Few files: a batch's rows of a source lie together.
    assert len(good.inputFiles()) == good.select("batch_id", "source_id").distinct().count()
    runs = spark.read.parquet(p["ingest_runs"])
    assert runs.agg(F.sum("n_rows")).first()[0] == g.count()
    assert os.path.isdir(p["checkpoint"])


def test_stream_ingest_returns_the_rows_kept_out_as_well(spark):
    from grantflow.plans import io_q
    out = io_q.stream_ingest(spark, SMOKE)
    assert out.count() == spark.read.parquet(f"{SMOKE}/orders.parquet").count()
    assert {bool(r.quarantine_reasons) for r in out.select("quarantine_reasons").distinct().collect()} == {True, False}


def test_stream_query_lands_by_size_and_reads_many_files_a_batch(spark, monkeypatch):
    from grantflow.plans import io_q
    seen = []

    def ingest(spark, landing, schema, *rest, files_per_trigger):
        seen.append((len(spark.read.parquet(landing).inputFiles()), files_per_trigger))
        ingest_landing(spark, landing, schema, *rest, files_per_trigger=files_per_trigger)

    ingest_landing = io_q.ingest_landing
    monkeypatch.setattr(io_q, "ingest_landing", ingest)
    monkeypatch.setattr(io_q, "STREAM_FILE_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    out = io_q._streamed(spark, sf)
    assert rows(spark, out) == spark.read.parquet(f"{sf}/orders.parquet").count()
    (files, each), = seen
    assert files >= 15 and 3 <= each < files
