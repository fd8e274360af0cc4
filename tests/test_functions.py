"""Column helpers on literal frames, including the golden values."""

import datetime as dt
import itertools
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from grantflow.functions import dates as D
from grantflow.functions import html as H
from grantflow.functions import ids as I
from grantflow.functions import text as T


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_source_id(spark):
    assert one(spark, I.clean_source_id, "Auxílios em, 2024²!") == "Auxílios_em_2024²"
    assert one(spark, I.clean_source_id, None) == ""


def test_source_id_rules(spark):
    df = spark.createDataFrame(
        [("La Marató", "Fund X", "Funder", "Ajuts 2024"), ("Agg One", "F", "Aggregator", "a"),
         ("N", "Solo Funder", "funder", None)], "name string, funder string, type string, action string")
    r1 = [r[0] for r in df.select(I.source_id_by_name("name", "action")).collect()]
    assert r1 == ["La_Marató-Ajuts_2024", "Agg_One-a", "N-"]
    r2 = [r[0] for r in df.select(I.source_id_by_funder("funder", "name", "type", "action")).collect()]
    assert r2 == ["Fund_X-Ajuts_2024", "Agg_One", "Solo_Funder"]


def test_parser_type(spark):
    got = [r[0] for r in spark.createDataFrame(
        [("CSV",), ("xls",), ("excel",), ("api",), ("html",), ("pdf",), (None,)], "f string")
        .select(I.parser_type("f")).collect()]
    assert got == ["standard_csv", "excel", "excel", "api", "html", "standard_csv", "standard_csv"]


def test_columns_hash_golden(spark):
    cols = ["Project Title", "Principal Investigator", "Award Amount", "Grant ID", "Start Date",
            "End Date", "Organization", "Co-PIs", "Abstract", "Keywords"]
    got = spark.range(1).select(I.columns_hash(F.array(*[F.lit(c) for c in cols]))).first()[0]
    assert got == "01d69b14889b962842de32c9a46968bd"


def test_parse_date(spark):
    vals = ["2024-07-31", "2024-7-1", "2024-02-30", "2024-07-31x", "abc", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(D.parse_date("v")).collect()]
    assert got == [dt.date(2024, 7, 31), dt.date(2024, 7, 1), None, None, None, None]


def test_split_period(spark):
    vals = ["2024-07-31 – 2026-03-31", "2024-07-31", "2024-07-31 - 2026-03-31", None]
    got = spark.createDataFrame([(v,) for v in vals], "v string").select(
        D.split_period("v").alias("p")).select("p.*").collect()
    assert tuple(got[0]) == (dt.date(2024, 7, 31), dt.date(2026, 3, 31), True)
    assert tuple(got[1]) == (None, None, False)
    assert tuple(got[2]) == (None, None, False)


def test_split_name(spark):
    vals = ["Ada Lovelace", "Plato", "Ada  Lovelace", "山田 太郎", None]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(T.split_name("v").alias("n")).select("n.*").collect()]
    assert got == [("Ada", "Lovelace"), (None, None), ("Ada", ""), ("山田", "太郎"), (None, None)]


def test_age_and_freshness(spark):
    as_of = D.as_of_literal("2024-02-08 00:00:00")
    rows = [("2024-02-01 00:00:00",), ("2024-01-31 23:59:59",), ("garbage",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(D.parse_ts("t").alias("ts"))
    got = df.select(D.is_fresh("ts", as_of, 7).alias("f"),
                    D.is_fresh("ts", as_of, 7, force=True).alias("forced")).collect()
    assert [r.f for r in got] == [True, False, False, False]   # exactly 7 days is fresh
    assert not any(r.forced for r in got)


def test_truthy(spark):
    vals = ["True", "1", "yes", "Y", "t", "no", "0", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(I.truthy("v")).collect()]
    assert got == [True] * 5 + [False] * 3


def test_url_filename(spark):
    df = spark.createDataFrame([("https://x.org/a/b/file.csv?x=1", "s1", "", "csv"),
                                ("https://x.org/", "s2", "act", "excel"),
                                ("not a url", "s3", None, "api")],
                               "u string, s string, a string, f string")
    got = [r[0] for r in df.select(I.url_filename("u", "s", "a", "f")).collect()]
    assert got == ["file.csv", "s2_act.xlsx", "s3.api"]


def test_fences(spark):
    cases = {
        "```json\n{\"a\": \"b\"}\n```": '{"a": "b"}',
        "```\n{\"a\": 1}\n```": '{"a": 1}',
        "  {\"a\": 1}\n\t": '{"a": 1}',
    }
    for raw, want in cases.items():
        assert one(spark, T.strip_fences, raw) == want
    assert one(spark, T.strip_fences_braces, '"a": "b"') == '{"a": "b"}'
    assert one(spark, T.extract_fenced_json, 'see ```json\n{"x": 1}\n``` ok') == '{"x": 1}'
    assert one(spark, T.extract_fenced_json, "no fence") is None


def test_parse_mapping(spark):
    got = one(spark, T.parse_mapping, '{"A": "award-number", "B": null, "C": {"x": 1}}')
    assert got == {"A": "award-number", "B": "null", "C": '{"x":1}'}
    assert one(spark, T.parse_mapping, "[1, 2]") is None
    assert one(spark, T.parse_mapping, "garbage") is None


def test_response_text(spark):
    env = '{"choices": [{"message": {"content": "hi"}}]}'
    assert one(spark, T.response_text, env) == "hi"
    assert one(spark, T.response_text, '{"choices": []}') == ""


def test_cost_breakdown_and_keywords(spark):
    assert one(spark, T.cost_breakdown, "2024:780000 2025:2080000") == {"2024": "780000", "2025": "2080000"}
    assert one(spark, T.keyword_list, "a / b c / d") == ["a", "b c", "d"]


def test_na_tokens(spark):
    vals = ["NA", "n/a", "", "nan", "x", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(T.na_to_null("v")).collect()]
    assert got == [None, None, None, None, "x", None]


class _Walk(HTMLParser):
    """Reference walk: text nodes outside script/style, stripped, non-empty."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out, self.buf = 0, [], []

    def _flush(self):
        s = "".join(self.buf).strip()
        if s:
            self.out.append(s)
        self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self._flush()
        self.skip -= tag in ("script", "style")

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)


def test_html_to_text_matches_parser_walk(spark):
    page = ('<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style>'
            '<script>var t="</p>";</script></head><body><!-- c --><p>a &lt; b&nbsp;</p>'
            '<div class="ad"> x <b>y</b></div>\n  <p>caf&eacute;? no: &copy; &middot; &quot;q&quot; &amp</p></body></html>')
    page = page.replace("&eacute;", "é")
    w = _Walk()
    w.feed(page)
    w.close()
    w._flush()
    assert one(spark, H.html_to_text, page) == "\n".join(w.out)


def test_html_real_pages_match_parser_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = pages.select("html", H.html_to_text("html").alias("t")).collect()
    for r in got:
        w = _Walk()
        w.feed(r.html)
        w.close()
        w._flush()
        assert r.t == "\n".join(w.out)


def test_all_references_are_decoded(spark):
    """Against the standard library: names whole, open and cut short, numbers
    of every range, and what only looks like a reference."""
    import html
    import random

    rng = random.Random(5)
    names = sorted(html.entities.html5)
    parts = ["&", "&&", "&#", "&#x", "&#;", "x", " ", ";", "<", "&amp;lt;", "&notit;", "&notin;", "&gtdot;", "&ltfoo;", "&AMPx",
             "&#x80;", "&#150", "&#13;", "&#11;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xFDD0;",
             "&#x1F600;", "&#65", "&#x0041;", "&#000066;", "&unknownname;", "&" + "q" * 40 + ";", "&copy", "&eacuteé", "\n"]
    texts = ["".join(rng.choices([*parts, "&" + rng.choice(names), "&" + rng.choice(names)[:-1] + rng.choice("ax ;")], k=6))
             for _ in range(3000)] + ["&" + n for n in names] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.o for r in df.select(H.decode_all_references(F.col("t")).alias("o")).collect()]
    wrong = [(t, g, html.unescape(t)) for t, g in zip(texts, got) if g != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_truncate(spark):
    df = spark.createDataFrame([("é" * 10,)], "v string")
    r = df.select(T.truncate("v", 4).alias("t"), T.is_truncated("v", 4).alias("f")).first()
    assert r.t == "éééé" and r.f


def test_html_text_against_the_standard_parser(spark):
    """An independent walk: html.parser instead of this package's patterns."""
    from html.parser import HTMLParser

    from grantflow.functions.html import html_to_text

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip and data.strip():
                self.out.append(data.strip())

    pages = ["<p title='x>y'>a &eacute; &ndash; &#233; &euro; &amp;lt; &lt;b&gt;</p><a href=\"q>\">z</a>",
             "<style>p{}</style><p>one &amp; two</p><script>if (a<b) {}</script>three&nbsp;",
             "<!DOCTYPE html><html><body>5 &gt; 4 &copy; &hellip; &#x41;<br/>x</body></html>",
             "<p>&amp;eacute; &Aacute;&ouml;</p>", "no tags", ""]
    want = []
    for p in pages:
        w = Walk()
        w.feed(p)
        w.close()
        want.append("\n".join(w.out))
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    assert [r.t for r in rows.select("i", html_to_text("h").alias("t")).orderBy("i").collect()] == want


def test_text_chunks_cover_the_whole_text(spark):
    from grantflow.sources.html_pages import text_chunks
    text = "".join(chr(97 + i % 26) for i in range(70_001))
    pages = spark.createDataFrame([(1, f"<p>{text}</p>"), (2, ""), (3, None)], "page_id int, html string")
    rows = text_chunks(pages, 32_000).orderBy("page_id", "chunk_no").collect()
    assert "".join(r.chunk for r in rows if r.page_id == 1) == text
    assert [(r.page_id, r.chunk_no) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]


def test_text_chunks_keep_lines_whole(spark):
    from grantflow.sources.html_pages import text_chunks
    rng = random.Random(4)
    lines = ["T" + "xé𝄞 "[i % 3] * rng.randrange(1, 60) for i in range(400)]
    lines[200] = "T" + "y" * 950                                   # longer than a chunk
    text = "\n".join(lines)
    pages = spark.createDataFrame([(1, "".join(f"<p>{x}</p>" for x in lines))], "page_id int, html string")
    chunks = [r.chunk for r in text_chunks(pages, 300).orderBy("chunk_no").collect()]
    assert "".join(chunks) == text and max(map(len, chunks)) <= 300
    titles = [x for c in chunks for x in c.split("\n") if x.startswith("T")]
    assert [x for x in titles if "y" not in x] == [x for x in lines if "y" not in x]
    at = text.index(lines[200])
    for end in itertools.accumulate(map(len, chunks[:-1])):
        assert text[end - 1] == "\n" or at < end < at + 951


def test_file_records_by_type_and_any_key(spark):
    from grantflow.sources import json_shapes as J
    docs = ['{"note": "[\\"x\\"]", "rows": [{"a": 1}, {"a": 2}]}', """{"it's": [{"a": 3}]}"""]
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select(J.file_records("d").alias("r")).collect()
    assert [[x.replace(" ", "") for x in r.r] for r in rows] == [['{"a":1}', '{"a":2}'], ['{"a":3}']]
