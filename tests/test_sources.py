"""Readers on hand-written files: CSV damage set, JSON shapes, project API,
Excel (injected reader), HTML blocks, landing listing."""

import io
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from grantflow.sources import catalog as SC
from grantflow.sources import csv_records as CR
from grantflow.sources import csv_tolerant as CT
from grantflow.sources import excel as XL
from grantflow.sources import json_shapes as J
from grantflow.sources import landing as L
from grantflow.sources.html_pages import _BlockParser, scrape_blocks


def write(path, name, data, mode="w", encoding="utf-8"):
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    if isinstance(data, bytes):
        with open(p, "wb") as f:
            f.write(data)
    else:
        with open(p, mode, encoding=encoding) as f:
            f.write(data)
    return p


def test_csv_damage_set(spark, tmpdir_):
    d = os.path.join(tmpdir_, "csv")
    write(d, "a.csv", 'id,name,amount\n1,alpha,10\n2,"multi\nline",20\n\n3,short\n4,over,30,EXTRA\n'
                      '5,"quote ""in"" text",NA\n')
    rows = CT.read_tolerant_csv(spark, d)
    kept, bad = CT.split_overflow(rows)
    got = {r.id: (r.name, r.amount) for r in kept.collect()}
    assert got == {"1": ("alpha", "10"), "2": ("multi\nline", "20"), "3": ("short", None),
                   "5": ('quote "in" text', None)}
    assert [(r["id"], r["__overflow"]) for r in bad.collect()] == [("4", "4,over,30,EXTRA")]


def test_csv_latin1_and_header_offset(spark, tmpdir_):
    d = os.path.join(tmpdir_, "latin")
    write(d, "l.csv", "Report title\nid,name\n1,Müller\n".encode("latin-1"))
    rows = CT.read_tolerant_csv(spark, d, header_row=1, multiline=False)
    assert [(r.id, r.name) for r in rows.collect()] == [("1", "Müller")]


def test_csv_repeated_headers(spark, tmpdir_):
    d = os.path.join(tmpdir_, "rep")
    write(d, "r.csv", "a,b,a\n1,2,3\n")
    rows = CT.read_tolerant_csv(spark, d)
    assert rows.columns[:3] == ["a", "b", "a.1"]
    assert tuple(rows.first()[:3]) == ("1", "2", "3")


def test_csv_each_file_has_its_own_header(spark, tmpdir_):
    d = os.path.join(tmpdir_, "mixed")
    write(d, "a.csv", "id,name\n1,x\nid,name\n,\n2,3,4,5\n")
    write(d, "b.csv", "name,id\ny,6\n")
    write(d, "c.csv", "id,Títol\n7,ñ\n".encode("latin-1"))
    for multiline in (True, False):
        kept, bad = CT.split_overflow(CT.read_tolerant_csv(spark, d, multiline=multiline))
        got = sorted(((r.id, r.name, r["Títol"]) for r in kept.collect()), key=str)
        assert got == sorted([("1", "x", None), ("id", "name", None), (None, None, None), ("6", "y", None),
                              ("7", None, "ñ")], key=str)
        assert [r["__overflow"] for r in bad.collect()] == ["2,3,4,5"]


def test_sniff_needs_no_prefix_and_names_what_it_cannot_tell(spark, tmpdir_):
    d = os.path.join(tmpdir_, "sniff2")
    wide = [f"column_{i}" for i in range(900)]               # a header beyond 4,096 characters
    write(d, "wide.csv", ";".join(wide) + "\n" + ";".join("1" * 900) + "\n")
    write(d, "uneven.csv", "a;b\n" + "1;2\n" * 30 + "1;2;3\n")
    write(d, "prose.csv", "no table\nat all, here\n")
    rows, unknown = CT.read_sniffed(spark, d)
    assert rows.count() == 32 and len(rows.columns) == 904
    assert [os.path.basename(r.path) for r in unknown.collect()] == ["prose.csv"]


def plain_records(text, quote='"'):
    """One task: records by the state of every character."""
    out, at, inside, field_start = [], "", False, True
    i = 0
    while i < len(text):
        c = text[i]
        if inside and c == quote:
            if text[i + 1:i + 2] == quote:
                at, i = at + quote, i + 1
            else:
                inside = False
        elif not inside and c == quote and field_start:
            inside = True
        elif not inside and c == "\n":
            out.append(at)
            at, field_start, i = "", True, i + 1
            continue
        field_start = not inside and c == ","
        at, i = at + c, i + 1
    return [r for r in [*out, at] if r.strip()], inside


@pytest.mark.parametrize("seed", range(4))
def test_records_of_split_files_are_those_of_one_task(spark, tmpdir_, seed):
    """Small splits that end inside quotes, escaped and stray quotes."""
    rng = random.Random(seed)
    d = os.path.join(tmpdir_, "split")
    want = {}
    for f in range(3):
        cell = lambda: rng.choice(["x", "", '5" pipe', '"a,b"', '"two\nlines"', '"say ""hi"""', '"\n\n,"', '""', '"q"junk',
                                   '"long ' + "text\n" * rng.randrange(40) + '"', "it's"])
        text = "id,a,b\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(300))
        write(d, f"{f}.csv", text)
        records, inside = plain_records(text)
        assert not inside
        want[f"{f}.csv"] = records
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    try:
        rows = CR.Records(spark, d).rows
        assert rows.sparkSession.read.text(d).rdd.getNumPartitions() > 20
        got = rows.orderBy("file", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r.file), []).append(r.text)
    assert by == want


def test_lines_of_a_record_are_staged_as_one_row(spark, tmpdir_, monkeypatch):
    """Past the first record of a split, pieces are records: what is grouped
    does not grow with the lines; small pieces give the same records."""
    d = os.path.join(tmpdir_, "pieces")
    text = "id,a\n" + "".join(f'{i},"{"word" * (i % 3)}\n{chr(10).join("w" * 30)}"\n' for i in range(200))
    write(d, "f.csv", text)
    want = plain_records(text)[0]
    found = CR.Records(spark, d)
    assert found._lines.count() <= 240                       # of 6,600 lines
    assert found._lines.where(~found._whole).count() <= 40
    assert [r.text for r in found.rows.orderBy("line").collect()] == want
    write(d, "g.csv", 'id,a\n1,"x\n' + "2,y\n" * 500)         # ends inside quotes
    monkeypatch.setattr(CR, "PIECE", 50)
    got = CR.Records(spark, d).rows.orderBy("file", "line").collect()
    assert [r.text for r in got if r.file.endswith("f.csv")] == want
    assert [(r.line, r.text) for r in got if r.file.endswith("g.csv")] == [
        (0, "id,a"), (1, '1,"x'), *((i + 2, "2,y") for i in range(500))]


def test_lines_are_written_below_their_header(spark, tmpdir_):
    from grantflow.plans.io_q import write_lines
    rows = spark.range(0, 10, 1, 3).select(F.when(F.col("id") != 4, F.concat(F.lit("é"), "id")).alias("line"))
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = os.path.join(tmpdir_, encoding)
        write_lines(rows.where("id > 2"), "h,ä", path, encoding)
        parts = sorted(p for p in os.listdir(path) if p.startswith("part"))
        texts = [open(os.path.join(path, p), encoding=encoding).read() for p in parts]
        assert [t for t in texts if t][0].startswith("h,ä\né3\n") and "".join(texts).count("h,ä\n") == 2
        assert "".join(texts).replace("h,ä\n", "").split() == [f"é{i}" for i in (3, 5, 6, 7, 8, 9)]


def test_layouts_below_title_lines(spark, tmpdir_):
    """Three layouts under title lines, more than one split each: every row."""
    d = os.path.join(tmpdir_, "titles")
    heads = {"a": ("id,name", 2000), "b": ("name,id,year", 1000), "c": ("id;x", 500)}
    for f, (head, n) in heads.items():
        write(d, f"{f}.csv", f'Export of "{f}\n' + head + "\n" + "".join(
            ",".join(f"{c}{i}" for c in head.split(",")) + "\n" for i in range(n)))
    for multiline in (True, False):
        rows = CT.read_tolerant_csv(spark, d, header_row=1, multiline=multiline)
        assert rows.columns == ["id", "name", "year", "id;x", "__overflow", "__file"]
        assert rows.count() == 3500
        assert rows.where("id = 'id7' AND name = 'name7'").count() == 2 and rows.where("year IS NOT NULL").count() == 1000


def test_a_thousand_layouts_are_one_plan(spark, tmpdir_):
    d = os.path.join(tmpdir_, "many")
    for i in range(1000):
        write(d, f"f{i:04}.csv", f"id,c{i % 7},own{i}\n{i},x,y{i}\n")
    rows = CT.read_mapped(spark, d)
    few = CT.read_mapped(spark, [os.path.join(d, "f0001.csv"), os.path.join(d, "f0002.csv")])
    plan = [df._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n") for df in (rows, few)]
    assert plan[0] == plan[1]
    got = rows.select(F.element_at("values", "id").alias("id"), "values").collect()
    assert len(got) == 1000 and all(r["values"][f"own{r.id}"] == f"y{r.id}" for r in got)


def test_dialects_with_quotes(spark, tmpdir_):
    d = os.path.join(tmpdir_, "dialect")
    write(d, "semi.csv", 'id;text;z\n' + "".join(f'{i};"x;y;{";" * (i % 5)}";z\n' for i in range(30)))
    write(d, "single.csv", "id|text\n" + "".join(f"{i}|'a|b{'|' * (i % 3)}'\n" for i in range(30)))
    write(d, "lines.csv", 'id,text\n' + "".join(f'{i},"one;two\nthree, four{"," * (i % 4)}\n"\n' for i in range(30)))
    write(d, "broken.csv", 'a;b\n' + "1;2\n" * 30 + '3;"4\n')
    got = {os.path.basename(r.path): (r.delimiter, r.quote) for r in CT.sniff_dialect(spark, d).collect()}
    assert got == {"semi.csv": (";", '"'), "single.csv": ("|", "'"), "lines.csv": (",", '"'), "broken.csv": (";", '"')}
    rows, unknown = CT.read_sniffed(spark, d)
    assert unknown.count() == 0 and rows.where("__overflow IS NOT NULL").count() == 0
    assert {(r.id, r.text) for r in rows.where("id = '3'").collect()} == {
        ("3", "x;y;;;;"), ("3", "a|b"), ("3", "one;two\nthree, four,,,\n")}
    assert rows.where("a = '1'").count() == 30 and rows.count() == 121


def test_files_with_odd_names(spark, tmpdir_):
    """Names that a URI escapes are read again under their own name."""
    d = os.path.join(tmpdir_, "odd names")
    names = ["a b.csv", "c+d.csv", "é%20f.csv", "g;h=i.csv"]
    for n in names:
        write(d, n, "id;v\n1;x\n")
    rows, unknown = CT.read_sniffed(spark, d)
    assert sorted(os.path.basename(r["__file"]) for r in rows.collect()) == sorted(names) and unknown.count() == 0
    verdicts = CT.verify_files(spark, d).collect()
    assert sorted((os.path.basename(r.path), r.verdict, r.n_rows) for r in verdicts) == [
        (n, "sniffed", 1) for n in sorted(names)]


def test_surplus_fields(spark, tmpdir_):
    d = os.path.join(tmpdir_, "surplus")
    write(d, "s.csv", 'a,b\n1,2,\n3,4,,,\n5,6,,,7\n8,"9,9"\n10,11,""\n12,13,"x"\n14\n')
    kept, bad = CT.split_overflow(CT.read_tolerant_csv(spark, d))
    assert {r.a: r.b for r in kept.collect()} == {"1": "2", "3": "4", "8": "9,9", "10": "11", "14": None}
    assert sorted(r["__overflow"] for r in bad.collect()) == ['12,13,"x"', "5,6,,,7"]


def test_sniff_and_verify(spark, tmpdir_):
    d = os.path.join(tmpdir_, "sniff")
    write(d, "semi.csv", "a;b;c\n1;2;3\n4;5;6\n")
    write(d, "tab.csv", "a\tb\n1\t2\n")
    write(d, "empty.csv", "")
    seps = {os.path.basename(r.path): r.delimiter for r in CT.sniff_dialect(spark, d).collect()}
    assert seps == {"semi.csv": ";", "tab.csv": "\t"}
    v = os.path.join(tmpdir_, "verify")
    write(v, "good.csv", "x,y\n1,2\n")
    write(v, "bad.csv", "x,y\n1,2\n3,4,5\n")
    write(v, "empty.csv", "")
    ver = {os.path.basename(r.path): (r.verdict, r.success, r.verification_passed)
           for r in CT.verify_files(spark, v).collect()}
    # Zero-byte files are skipped by Spark's file listing: they get no row,
    # which is the same outcome as the "empty -> failed" rung.
    assert ver == {"good.csv": ("strict", True, True), "bad.csv": ("skip_bad", True, True)}


def test_catalog_reader_missing_columns(spark, tmpdir_):
    d = os.path.join(tmpdir_, "cat")
    write(d, "c.csv", "Funder,Source_name,Format\nF,S,csv\n")
    raw = SC.read_catalog(spark, d)
    assert SC.missing_required(raw.columns) == ["Country", "Type", "Link to dump"]


def test_json_file_shapes(spark):
    docs = ['[{"a": 1}, {"a": 2}]', '{"meta": {"n": 1}, "empty": [], "rows": [{"a": 3}], "more": [{"a": 9}]}',
            '{"empty": [], "x": 5}', '{"x": 6}', '42']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = {r.i: r.recs for r in df.select("i", J.file_records("d").alias("recs")).collect()}
    assert [len(got[i]) for i in range(5)] == [2, 1, 1, 1, 1]
    assert '"a":3' in got[1][0].replace(" ", "")          # first non-empty list in key order
    assert got[4] == ["42"]


def test_api_pages(spark):
    pages = ['[{"k": 1}]', '{"data": [], "results": [{"k": 2}]}', '{"results": [{"k": 3}], "next": "p2"}',
             '{"k": 4, "has_more": true}', '{"data": [{"k": 5}], "next": null}', '"x"']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string")
    got = {r.i: (len(r.recs), r.more) for r in df.select(
        "i", J.api_records("p").alias("recs"), J.api_has_more("p").alias("more")).collect()}
    assert got == {0: (1, False), 1: (0, False), 2: (1, True), 3: (1, True), 4: (1, False), 5: (0, False)}


def test_project_api(spark):
    proj_a = ('{"metadata": {"oaf:entity": {"oaf:project": {"code": {"$": "C1"}, "acronym": "A", '
              '"title": {"$": "T"}, "startdate": "2020-01-01", "fundingtree": {"funder": '
              '[{"shortname": {"$": "EC"}}, {"shortname": ""}, {"shortname": "NIH"}]}}}}}')
    proj_b = '{"metadata": {"code": 7, "fundingtree": {"funder": {"shortname": "ERC"}}}}'
    bodies = [
        (1, '{"response": {"header": {"total": {"$": "250"}}, "results": {"result": [' + proj_a + "]}}}"),
        (2, '{"response": {"header": {"total": "250"}, "results": {"result": ' + proj_b + "}}}"),
        (3, '{"response": {"header": {"total": {"count": 250}}, "results": {}}}'),
        (4, '{"response": {"header": {"total": 250}, "results": {"result": [' + proj_a + "]}}}"),
    ]
    df = spark.createDataFrame([("s", p, b) for p, b in bodies], "source string, page long, body string")
    pages = {r.page: r for r in J.project_pages(df).collect()}
    assert [pages[p].after_empty for p in (1, 2, 3, 4)] == [False, False, False, True]
    assert [pages[p].beyond_announced for p in (1, 2, 3, 4)] == [False, False, False, True]
    assert pages[1].total == 250 and pages[1].expected_pages == 3
    flat = J.flatten_projects(df).orderBy("page").collect()
    assert [(r.code, r.acronym, r.title, r.start_date, r.end_date, r.funder) for r in flat] == [
        ("C1", "A", "T", "2020-01-01", None, "EC; NIH"), ("7", "", "", None, None, "ERC"),
        ("C1", "A", "T", "2020-01-01", None, "EC; NIH")]
    many = spark.range(1, 2001).select(F.lit("s").alias("source"), F.col("id").alias("page"), F.lit(
        '{"response": {"header": {"total": 5}, "results": {"result": {"id": "x", "metadata": 3}}}}').alias("body"))
    assert J.flatten_projects(many).where("raw_id = 'x'").count() == 2000      # no page is dropped
    totals = spark.createDataFrame([('{"response": {"header": {"total": "12.5"}}}',),
                                    ('{"response": {}}',)], "b string")
    assert [r[0] for r in totals.select(J.project_total("b")).collect()] == [None, 0]


def test_read_json_files(spark, tmpdir_):
    d = os.path.join(tmpdir_, "json")
    write(d, "a.json", '{"items": [{"x": 1}, {"x": 2}]}')
    write(d, "metadata.json", '{"source_id": "s"}')
    assert J.read_json_files(spark, d).count() == 2


def test_flatten_columns(spark, tmpdir_):
    d = os.path.join(tmpdir_, "nested")
    write(d, "n.json", '{"a": {"b": 1, "c": {"d": "x"}}, "l": [1, 2]}\n')
    flat = J.read_json_flat(spark, d)
    assert sorted(flat.columns) == ["a.b", "a.c.d", "l"]
    r = flat.first()
    assert (r["a.b"], r["a.c.d"], r["l"]) == (1, "x", "[1,2]")


def test_fields_of_all_files_are_merged(spark, tmpdir_):
    d = os.path.join(tmpdir_, "unknown")
    write(d, "a.json", '{"a": {"b": 1}, "n": null, "we ird": true, "x": 1, "OBJECT": {"VOID": "v"}}\n[1]\nno json\n')
    write(d, "b.json", '{"a": {"b": 2.5, "c": "t"}, "x": "text", "big": 123456789012345678901234567890}\n')
    flat = J.read_json_flat(spark, d)
    assert dict(flat.dtypes) == {"a.b": "double", "a.c": "string", "n": "string", "we ird": "boolean", "x": "string",
                                 "OBJECT.VOID": "string", "big": "decimal(30,0)"}
    rows = {r["a.b"]: r for r in flat.collect()}
    assert (rows[1.0]["x"], rows[1.0]["OBJECT.VOID"], rows[2.5]["x"], rows[2.5]["a.c"]) == ("1", "v", "text", "t")
    df = spark.createDataFrame([(1, '{"k": {"v": 1}}'), (2, "7"), (3, None), (4, '{"k": 3}')], "i int, record string")
    got = {r.i: (r["k"], r["__record"]) for r in J.flatten_records(df).collect()}
    assert got == {1: ('{"v":1}', None), 2: (None, "7"), 3: (None, None), 4: ("3", None)}
    none = spark.createDataFrame([(1, "7")], "i int, record string")
    assert J.flatten_records(none).columns == ["i", "__record"]
    assert J.discover_schema(none.limit(0)) == ""


def test_excel_injected_reader(spark, tmpdir_):
    d = os.path.join(tmpdir_, "xl")
    write(d, "book.xlsx", b"id,name\n1,a\n2,b\n")
    write(d, "broken.xlsx", b"\x00\x01")

    def reader(content: bytes) -> pd.DataFrame:     # stands in for read_excel
        if content.startswith(b"\x00"):
            raise ValueError("not a workbook")
        return pd.read_csv(io.BytesIO(content), dtype=str)

    rows = XL.read_excel_files(spark, d, reader)
    good = XL.to_columns(rows, ["id", "name"]).orderBy("row_no").collect()
    assert [(r.id, r.name) for r in good] == [("1", "a"), ("2", "b")]
    assert rows.filter(F.col("error").isNotNull()).count() == 1


def test_scrape_blocks(spark):
    html = ('<div class="views-row"><h3 class="field--name-title"> First </h3><p>x</p></div>'
            '<div class="views-row other"><div><span class="field--name-title">Second</span></div></div>')
    p = _BlockParser("views-row", "field--name-title")
    p.feed(html)
    assert p.blocks == ["First", "Second"]
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r.text for r in scrape_blocks(spark, pages, "views-row", "field--name-title").collect()]
    assert got == ["First", "Second"]


def test_landing_listing(spark, tmpdir_):
    root = os.path.join(tmpdir_, "raw")
    for run in ("20240101_000000", "20240201_000000", "latest", ".tmp"):
        write(os.path.join(root, "source_name=s", "action=a", f"run_ts={run}"), "data.json", "{}")
    write(os.path.join(root, "source_name=s", "action=a", "run_ts=20240201_000000"), "data.csv", "x\n1\n")
    write(os.path.join(root, "source_name=s", "action=a", "run_ts=20240201_000000"), "metadata.json", "{}")
    listing = L.list_landed(spark, root)
    latest = L.latest_run_files(listing)
    assert {r.run_ts for r in latest.collect()} == {"20240201_000000"}
    picked = L.pick_files(latest).collect()
    assert [r.file_name for r in picked] == ["data.csv"]


def test_csv_quote_none_and_empty_header(spark, tmpdir_):
    d = os.path.join(tmpdir_, "q")
    write(d, "q.csv", 'id,text\n1,He said "hi\n2,ok\n')
    rows = CT.read_tolerant_csv(spark, d, quote="", multiline=False)
    assert sorted((r["id"], r["text"]) for r in rows.collect()) == [("1", 'He said "hi'), ("2", "ok")]
    e = os.path.join(tmpdir_, "e")
    write(e, "e.csv", "\n1,2\n")
    assert CT.read_tolerant_csv(spark, e, multiline=False).count() == 0
