"""Operators on literal frames: conform, validation, mapping, catalog, runs,
model calls, relational model, serve."""

import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantflow.functions.dates import as_of_literal
from grantflow.operators import catalog as CO
from grantflow.operators import inference as INF
from grantflow.operators import mapping as M
from grantflow.operators import model, quality, runs, serve
from grantflow.operators.conform import conform, quarantine_reason_counts, split_quarantine
from grantflow.schema import vocabulary_rows
from grantflow.sources import catalog as SC

WIDE = ["Research Project Title", "Project Title (English)", "Project/Area Number",
        "Project Period (FY)", "Principal Investigator", "Research Institution",
        "Total Cost (Overall)", "Keywords"]


def wide(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in WIDE))


def test_conform_sample_row(spark):
    df = wide(spark, [("研究", "A study", "24K01234", "2024-07-31 – 2026-03-31",
                       "YAMADA Taro", "Univ", "2860000.0", "kw")])
    r = conform(df).first()
    assert r.grant_id == "24K01234"
    assert r.project_title == "研究"
    assert (r.start_date, r.end_date) == (dt.date(2024, 7, 31), dt.date(2026, 3, 31))
    assert r.amount == Decimal("2860000.00")
    assert (r.investigator_given_name, r.investigator_family_name) == ("YAMADA", "Taro")
    assert r.organization_name == "Univ" and r.project_description == "kw"
    assert r.quarantine_reasons == []


def test_conform_policies_and_quarantine(spark):
    df = wide(spark, [(None, "English", "1", "2024-02-30 – 2025-01-01", "Solo", "U", "abc", None),
                      ("T", "E", "2", "2024-01-01 - 2025-01-01", None, None, None, None)])
    first = conform(df).orderBy("grant_id").collect()
    assert first[0].project_title is None            # first listed column wins for the column
    co = conform(df, policy="coalesce").orderBy("grant_id").collect()
    assert co[0].project_title == "English"           # first non-null value per row
    assert first[0].quarantine_reasons == ["start_date_invalid", "amount_invalid"]
    assert first[1].quarantine_reasons == ["period_format"]
    good, bad = split_quarantine(conform(df))
    assert good.count() + bad.count() == df.count()   # no row is lost
    counts = {r.reason: r.n_rows for r in quarantine_reason_counts(conform(df)).collect()}
    assert counts == {"start_date_invalid": 1, "amount_invalid": 1, "period_format": 1}


def test_conform_is_idempotent_on_typed_columns(spark):
    df = wide(spark, [("T", "E", "9", "2024-01-01 – 2025-01-01", "A B", "U", "10", "k")])
    once = conform(df).drop("quarantine_reasons")
    again = conform(once.select(
        F.col("project_title").alias("Research Project Title"),
        F.col("grant_id").alias("Project/Area Number"),
        F.col("organization_name").alias("Research Institution"),
        F.col("amount").cast("string").alias("Total Cost (Overall)"),
        F.col("project_description").alias("Keywords"))).drop("quarantine_reasons")
    a, b = once.first(), again.first()
    for c in ["grant_id", "project_title", "amount", "organization_name", "project_description"]:
        assert a[c] == b[c]


def test_validate_rules(spark):
    from grantflow.schema import GRANT_SCHEMA
    base = {c.name: None for c in GRANT_SCHEMA.fields}
    ok = dict(base, grant_id="g", DOI="10.1/x", resource="https://r", project_title="t",
              funder_name="f", funder_id="fid", funding_type="grant", internal_award_number="i",
              amount=Decimal("1.00"), currency="EUR", country_code="ES",
              investigator_role="co-lead", investigator_ORCID="https://orcid.org/1",
              ROR="https://ror.org/1")
    bad = dict(ok, currency="euro", country_code="ESP", investigator_role="boss",
               investigator_ORCID="0000-0001", ROR="ror:1", project_title=None)
    nocur = dict(ok, currency=None)
    df = spark.createDataFrame([ok, bad, nocur], GRANT_SCHEMA)
    got = [r.violations for r in quality.validate(df).collect()]
    assert got[0] == []
    assert got[1] == ["missing:project_title", "currency_format", "country_format",
                      "role_invalid", "orcid_not_url", "ror_not_url"]
    assert got[2] == ["currency_missing"]


def test_mapping_validation_golden(spark):
    cached = {"Project Title": "award-title", "Principal Investigator": "principal-investigator",
              "Award Amount": "award-amount", "Grant ID": "award-number", "Start Date": "award-start",
              "End Date": "award-end", "Organization": "funder", "Co-PIs": "co-investigator",
              "Abstract": "project-description", "Keywords": "null"}
    rows = spark.createDataFrame([(k, v) for k, v in cached.items()], "source_col string, target_col string")
    valid, rejected = M.validate_mapping(spark, rows)
    assert sorted(r.source_col for r in valid.collect()) == ["Award Amount", "Grant ID", "Keywords"]
    assert rejected.count() == 7


def test_vocabulary_is_35_distinct_with_later_text():
    rows = vocabulary_rows()
    assert len(rows) == 35
    by_key = {k: (o, d) for o, k, d, _ in rows}
    assert by_key["@start-date"][0] == 7                       # first position kept
    assert by_key["@start-date"][1] == "Actual start date of award"   # later text wins


def test_resolve_mappings_cache_first(spark):
    datasets = spark.createDataFrame(
        [("s1", "h1", "p1"), ("s2", "h2", "p2"), ("s3", "h3", "p3")],
        "source string, columns_hash string, prompt string")
    cache = spark.createDataFrame([("s1", "h1", "A", "award-number")],
                                  "source string, columns_hash string, source_col string, target_col string")
    calls = []

    def fn(prompts):
        calls.extend(prompts)
        return ['```json\n{"X": "award-amount", "Y": "bogus"}\n```' if p == "p2" else "not json"
                for p in prompts]

    valid, failed, rejected = M.resolve_mappings(spark, datasets, cache, fn)
    v = sorted((r.source, r.source_col, r.target_col) for r in valid.collect())
    assert v == [("s1", "A", "award-number"), ("s2", "X", "award-amount")]
    assert [r.source for r in failed.collect()] == ["s3"]
    assert [r.target_col for r in rejected.collect()] == ["bogus"]
    assert "p1" not in calls                                   # cache hit never reaches the model


def test_complete_isolates_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, prompt string")

    def fn(prompts):
        if any(p.endswith("3") for p in prompts):
            raise RuntimeError("boom")
        return [p.upper() for p in prompts]

    out = INF.outcome(INF.complete(df, "prompt", fn, partitions=3)).orderBy("id").collect()
    assert [r.status for r in out].count("failed") == 2           # p3 and p13 only
    assert out[4].response == "P4" and out[3].response is None and "boom" in out[3].error


def test_complete_offline_default_fails_rows_not_job(spark):
    df = spark.createDataFrame([("x",)], "prompt string")
    r = INF.complete(df, "prompt").first()
    assert r.response is None and "no model function" in r.error


def test_catalog_projection_and_last_wins(spark):
    rows = spark.createDataFrame(
        [("F1", "S one", "ES", "Funder", "u1", "CSV", "act", "true", 0),
         ("F1", "S one", "ES", "Funder", "u2", "xls", "act", "no", 1),
         ("F2", None, "NA", "Aggregator", "u3", "html", None, None, 2)],
        "Funder string, Source_name string, Country string, Type string, `Link to dump` string, "
        "Format string, Action string, `Skip SSL Verify` string, __ord long")
    cat = SC.catalog_from_rows(rows).orderBy("source_id").collect()
    assert [r.source_id for r in cat] == ["S_one-act"]          # id-less row dropped, dup -> last
    r = cat[0]
    assert (r.data_link, r.parser, r.skip_ssl_verify, r.status) == ("u2", "excel", False, "Not started")
    rule2 = SC.catalog_from_rows(rows, id_rule="funder").orderBy("source_id").collect()
    assert [x.source_id for x in rule2] == ["F1-act"]   # aggregator without a name: no id


def test_catalog_required_columns():
    assert SC.missing_required(["Funder", "Format"]) == ["Source_name", "Country", "Type", "Link to dump"]
    assert SC.dedupe_names(["a", "b", "a", "a", "a.1"]) == ["a", "b", "a.2", "a.3", "a.1"]


def test_expand_actions(spark):
    df = spark.createDataFrame(
        [(1, [("x", "u"), ("", "u"), ("y", None)], "solo", "d"), (2, [], "solo", "d"),
         (3, None, None, "d")],
        "id int, actions array<struct<name:string,data_link:string>>, single string, link string")
    got = sorted(tuple(r) for r in CO.expand_actions(df, "actions", "single", "link")
                 .select("id", "action_name", "action_link").collect())
    assert got == [(1, "x", "u"), (2, "solo", "d"), (3, "", "d")]


def test_latest_per_key_and_status(spark):
    r = spark.createDataFrame(
        [("src_1", "a", dt.datetime(2024, 1, 1), "success", dt.datetime(2024, 1, 1, 5), 2, 2097152),
         ("src_1", "a", dt.datetime(2024, 1, 3), "failed", dt.datetime(2024, 1, 3, 5), 1, 10),
         ("src_1", "b", dt.datetime(2024, 1, 2), "success", dt.datetime(2024, 1, 2, 5), 1, 1048576)],
        "source_name string, action string, run_ts timestamp_ntz, status string, "
        "timestamp timestamp_ntz, file_count long, total_bytes long")
    latest = runs.latest_per_key(r, ["source_name", "action"], ["run_ts"]).orderBy("action").collect()
    assert [x.status for x in latest] == ["failed", "success"]
    cat = spark.createDataFrame([("src_1", "a", "F", "csv"), ("src_1", "b", "F", "csv"), ("src_9", "a", "G", "api")],
                                "source_id string, action string, funder string, format string")
    st = {(x.source_id, x.action): x
          for x in runs.source_status(cat, r, as_of_literal("2024-01-04 05:00:00")).collect()}
    b = st["src_1", "b"]
    assert b.downloaded and b.age_days == 2.0 and b.size_mb == 1.0
    assert b.download_path == "raw/src_1/b/20240102_000000"
    assert st["src_1", "a"].download_path == "raw/src_1/a/20240101_000000"      # the failed run is no download
    none = st["src_9", "a"]
    assert (none.downloaded, none.file_count, none.size_mb) == (False, 0, 0.0)


def test_run_metadata_has_the_base_fields(spark):
    files = spark.createDataFrame([("s", "a", dt.datetime(2024, 1, 1), '{"type": "X", "pages": 3}', "csv")],
                                  "source_name string, action string, run_ts timestamp_ntz, props string, format string")
    extra = runs.run_metadata(files, "props").first().extra
    assert extra == {"source_id": "", "funder": "", "source_name": "s", "country": "", "type": "X",
                     "status": "Downloaded", "format": "csv", "timestamp": "", "pages": "3"}


def test_merge_extras_last_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "9", "c": "3"})],
                               "base map<string,string>, extra map<string,string>")
    got = df.select(runs.merge_extras(F.col("base"), F.col("extra"))).first()[0]
    assert got == {"a": "1", "b": "9", "c": "3"}


def test_model_roundtrip(spark):
    df = wide(spark, [("T1", None, "1", "2024-01-01 – 2025-01-01", "A B", "U1", "5", None),
                      ("T2", None, "2", "2024-01-01 – 2025-01-01", "A B", "U1", "6", None),
                      ("T3", None, "3", None, None, None, None, None)])
    flat = conform(df).drop("quarantine_reasons")
    t = model.normalise(flat)
    assert t["organization"].count() == 1 and t["investigator"].count() == 1
    back = model.reassemble(t)
    assert back.count() == 3
    assert quality.orphans(t["investigator"], t["organization"], "organization_id").count() == 0
    assert quality.duplicate_keys(flat.union(flat), "grant_id").count() == 3


def test_model_keeps_rows_that_conflict(spark):
    """Equal ids and titles, other amounts and organizations: nothing is lost."""
    flat = conform(wide(spark, [("T", None, "1", None, "A B", "U1", "1.00", None),
                                ("T", None, "1", None, "A B", "U1", "2.00", None),
                                ("T", None, "1", None, "A B", "U1", "2.00", None),
                                ("T", None, "1", None, None, None, "3.00", None)])).drop("quarantine_reasons")
    flat = flat.withColumn("organization_id", F.lit("given")).withColumn(
        "ROR", F.when(F.col("amount") == 1, "https://ror.org/1"))
    t = model.normalise(flat)
    back = model.reassemble(t)
    cols = flat.columns
    want = model.with_keys(flat).select(*cols)
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, want.collect()))
    assert [r.organization_id for r in model.conflicts(t["organization"], "organization_id").collect()] == ["given"]


def test_bucketed_tables_join_where_they_lie(spark, tmpdir_):
    flat = conform(wide(spark, [(f"T{i}", None, str(i % 40), None, "A B", f"U{i % 3}", "1.00", None) for i in range(200)]))
    tables = model.normalise(flat.drop("quarantine_reasons"), materialize=True)
    saved = model.write_bucketed(tables, "bucket_test", tmpdir_ + "/buckets", 4)
    join = saved["grant_party"].join(saved["grant_project"], "grant_project_id")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        assert join.count() == tables["grant_party"].count()
        plan = join._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set(conf, old)
    rows = [sorted(map(str, model.reassemble(t).collect())) for t in (tables, saved)]
    assert rows[0] == rows[1] and len(rows[0]) == 200


def test_append_twice_adds_once(spark, tmpdir_):
    flat = conform(wide(spark, [("T", None, "1", None, "A B", "U1", None, None),
                                (None, None, "2", None, "A B", "U1", None, None)])).drop("quarantine_reasons")
    rows = flat.withColumns({c: F.lit("x") for c in ("DOI", "resource", "funder_name", "funder_id", "funding_type",
                                                    "internal_award_number", "source_id")})
    path = tmpdir_ + "/appended"
    for _ in range(2):
        rejected = serve.append_grants(rows, path)
        assert [r.grant_id for r in rejected.collect()] == ["2"]
    assert [r.grant_id for r in serve.read_grants(spark, path).collect()] == ["1"]


def test_append_of_repeated_keys(spark, tmpdir_):
    """One row per key of a load is written, the others come back."""
    flat = conform(wide(spark, [("T", None, i, None, "A B", u, None, None) for i, u in (("1", "U1"), ("1", "U2"), ("2", "U"))]))
    rows = flat.drop("quarantine_reasons").withColumns({c: F.lit("x") for c in (
        "DOI", "resource", "funder_name", "funder_id", "funding_type", "internal_award_number", "source_id")})
    path = tmpdir_ + "/repeated"
    rejected = serve.append_grants(rows.coalesce(1), path).collect()
    assert [(r.grant_id, r.organization_name, r.violations) for r in rejected] == [("1", "U2", ["key_repeated"])]
    assert sorted((r.grant_id, r.organization_name) for r in serve.read_grants(spark, path).collect()) == [
        ("1", "U1"), ("2", "U")]


def test_append_compares_keys_not_rows(spark, tmpdir_, monkeypatch):
    """Few of many rows are new, then most: only keys and row numbers are staged to tell them."""
    flat = conform(wide(spark, [("T", None, str(i), None, "A B", "U", None, None) for i in range(40)]))
    rows = flat.drop("quarantine_reasons").withColumns({c: F.lit("x") for c in (
        "DOI", "resource", "funder_name", "funder_id", "funding_type", "internal_award_number", "source_id")})
    path = tmpdir_ + "/keys"
    seen = {}
    real = serve.staged
    monkeypatch.setattr(serve, "staged", lambda df, name: seen.setdefault(name, df.columns) and real(df, name))
    for upto in (10, 12, 40, 40):
        assert serve.append_grants(rows.where(F.col("grant_id").cast("int") < upto), path).count() == 0
        got = [r.grant_id for r in serve.read_grants(spark, path).select("grant_id").collect()]
        assert sorted(got, key=int) == [str(i) for i in range(upto)]
    assert [n for n, columns in seen.items() if "project_title" in columns] == ["append-checked"]


def test_index_lists_ids_and_shuffles_no_pieces(spark, tmpdir_):
    rows = spark.range(500).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("grant_id"),
                                   F.concat(F.lit("study number "), "id").alias("project_title"))
    rows = rows.unionAll(rows.where("grant_id = '7'"))              # a repeated row is listed twice, found as before
    path, index = tmpdir_ + "/g", tmpdir_ + "/i"
    serve.publish_grants(rows, path)
    serve.publish_index(rows.coalesce(1), index)
    pieces = spark.read.parquet(index)
    assert pieces.count() < 2000 and pieces.agg(F.sum(F.size("ids"))).first()[0] > 5000
    grants = serve.read_grants(spark, path)
    for text, n in (("number 7", 12), ("study", 501), ("7x", 0)):
        search = serve.GrantSearch(contains={"project_title": text})
        found = serve.search_indexed(grants, pieces, search).count()
        assert found == serve.search_grants(grants, search).count() == n


def test_model_gets_slices_of_a_batch(spark, monkeypatch):
    """A task holds few prompts as text at once; other columns pass as they are."""
    rows = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") != 5, F.repeat(F.lit("é"), 1000)).alias("prompt"),
                                            F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    got = INF.complete(rows, "prompt", lambda prompts: [str(len(prompts))] * len(prompts)).orderBy("id").collect()
    assert [(r.id, r.n) for r in got] == [(i, None if i % 2 else i) for i in range(300)]
    assert got[5].response is None and got[5].error is None
    monkeypatch.setattr(INF, "PART", 50_000)
    batch = pa.RecordBatch.from_pydict({"prompt": ["x" * 1000] * 300})
    sizes = [p.num_rows for p in INF._parts(batch)]
    assert sum(sizes) == 300 and max(sizes) <= 50


def test_lookup_reads_the_row_groups_that_may_hold_the_id(spark, tmpdir_):
    """Ids of every source span the same range, so only the bloom filters tell
    the files apart."""
    path = tmpdir_ + "/bloom"
    g = spark.range(8000).select(F.sha2(F.col("id").cast("string"), 256).alias("grant_id"),
                                 F.concat(F.lit("s"), F.col("id") % 8).alias("source_id"))
    serve.publish_grants(g, path)
    wanted = g.where("source_id = 's3'").first().grant_id
    found = serve.grant_by_id(spark, serve.read_grants(spark, path), wanted)
    assert [r.source_id for r in found.collect()] == ["s3"]

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        plan = plan.inputPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
        return plan.metrics().apply("numOutputRows").value()

    df = serve.grant_by_id(spark, serve.read_grants(spark, path), wanted)
    df._jdf.queryExecution().toRdd().count()
    assert 0 < scanned(df) <= 1000                       # of eight files with 1,000 rows each


@pytest.mark.parametrize("listed", [1000, 0])
def test_indexed_search_finds_what_a_scan_finds(spark, tmpdir_, monkeypatch, listed):
    monkeypatch.setattr(serve, "LISTED", listed)
    titles = ["Ocean Currents", "ocean", "An OCEANIC study", "xx", None, "", "日本語の研究", "o c e a n", "ÉTUDE océan"]
    rows = spark.createDataFrame([(f"s{i % 3}" if i % 5 else None, str(i) if i % 7 else None, titles[i % 9], f"u{i % 4} lab")
                                  for i in range(300)], "source_id string, grant_id string, project_title string, "
                                                        "organization_name string")
    path, index = tmpdir_ + "/g", tmpdir_ + "/i"
    serve.publish_grants(rows, path)
    serve.publish_index(rows, index)
    serve.publish_index(rows.where("source_id = 's1'"), index)          # again: nothing twice
    grants, pieces = serve.read_grants(spark, path), spark.read.parquet(index)
    for contains in ({"project_title": "OCEAN"}, {"project_title": "ocean", "organization_name": "u1 LAB"},
                     {"project_title": "本語の"}, {"project_title": "xx"}, {"project_title": "nowhere"}, {"project_title": ""},
                     {"project_title": "oc", "organization_name": "u2 l"}, {"project_title": "océ"}):
        search = serve.GrantSearch(contains=contains)
        want = sorted(map(str, serve.search_grants(grants, search).collect()))
        assert sorted(map(str, serve.search_indexed(grants, pieces, search).collect())) == want
    assert any(serve.search_grants(grants, serve.GrantSearch(contains={"project_title": "本語の"})).collect())


def test_many_layouts_are_one_plan(spark):
    maps = [(f"s{i}", "h", f"c{i}", "project-title") for i in range(50)] + [
        ("s1", "h", "a", "@amount"), ("s1", "h", "b", "award-amount"), ("s1", "h", "x", "null")]
    stored = spark.createDataFrame(maps, "source string, columns_hash string, source_col string, target_col string")
    rows = spark.createDataFrame([(f"s{i}", "h", {f"c{i}": f"t{i}", "a": "1", "b": None if i else "2"}) for i in range(51)],
                                 "source string, columns_hash string, values map<string,string>")
    got = {r.source: r for r in M.conform_layouts(rows, M.layout_feeds(spark, stored)).collect()}
    assert all(got[f"s{i}"].project_title == f"t{i}" for i in range(50))
    assert got["s1"].amount == 1 and got["s0"].amount is None and got["s50"].quarantine_reasons == ["layout_unmapped"]
    first = M.conform_layouts(rows, M.layout_feeds(spark, stored), policy="first_column").where("source = 's1'").first()
    assert first.amount is None                          # of the better key, which is null here


def test_model_is_called_once_per_prompt(spark, tmpdir_):
    datasets = spark.createDataFrame([("s", str(i), f"p{i}") for i in range(4)],
                                     "source string, columns_hash string, prompt string")
    cache = spark.createDataFrame([], "source string, columns_hash string, source_col string, target_col string")
    log = tmpdir_

    def fn(prompts):
        import uuid
        for p in prompts:
            open(f"{log}/{p}-{uuid.uuid4().hex}", "w").close()
        return ['{"a": "DOI"}' if p != "p3" else "?" for p in prompts]

    import os
    valid, failed, rejected = M.resolve_mappings(spark, datasets, cache, fn)
    assert (valid.count(), failed.count(), rejected.count(), valid.count()) == (3, 1, 0, 3)
    assert len([f for f in os.listdir(log) if f.startswith("p")]) == 4


def test_conform_mapped_uses_the_vocabulary(spark):
    pairs = [("Amt", "@amount"), ("Total", "award-amount"), ("Name", "project-title"), ("Odd", "null")]
    assert M.crosswalked(pairs) == [("Total", "amount"), ("Name", "project_title"), ("Amt", "amount")]
    df = spark.createDataFrame([("5", None, "T", "s")], "Amt string, Total string, Name string, source_id string")
    r = M.conform_mapped(df, pairs, lineage=["source_id"]).first()
    assert (float(r.amount), r.project_title, r.source_id, len(r.columns_hash)) == (5.0, "T", "s", 32)


def test_serve_publish_idempotent_and_search(spark, tmpdir_):
    df = conform(wide(spark, [("Urgent T", None, "1", "2024-01-01 – 2025-01-01", "A B", "U", "500", None),
                              ("Other", None, "2", "2023-01-01 – 2024-01-01", "A B", "U", "50", None)])) \
        .drop("quarantine_reasons").withColumn("source_id", F.lit("s1"))
    path = tmpdir_ + "/grants"
    serve.publish_grants(df, path)
    serve.publish_grants(df, path)
    g = serve.read_grants(spark, path)
    assert g.count() == 2
    assert serve.grant_by_id(spark, g, "2").first().project_title == "Other"
    s = serve.GrantSearch(contains={"project_title": "URGENT"}, start_from=dt.date(2024, 1, 1),
                          amount_min=100)
    assert [r.grant_id for r in serve.search_grants(g, s).collect()] == ["1"]
    other = df.withColumn("source_id", F.lit("s2"))
    serve.publish_grants(other, path)                       # another source: s1 untouched
    assert serve.read_grants(spark, path).count() == 4


@pytest.mark.parametrize("fmt,route", [("csv", "file"), ("XLS", "file"), ("api", "api"),
                                       ("html", "html"), ("pdf", "unsupported")])
def test_dispatch(spark, fmt, route):
    got = spark.range(1).select(CO.dispatch(F.lit(fmt), F.lit("x"), F.lit("https://e.org"))).first()[0]
    assert got == route
    tagged = spark.range(1).select(CO.dispatch(F.lit("api"), F.lit("OpenAIRE-x"), F.lit("u"))).first()[0]
    assert tagged == "project_api"
