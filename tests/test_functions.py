import pytest
from pyspark.sql import functions as F

from crawlweave.functions import content, extract, http, urls
from crawlweave.plans import registry

NORMALIZED = [
    ("http://Example.com/a/", "https://example.com/a"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com:443/x?b=2&a=1#top", "https://example.com/x?a=1&b=2"),
    ("http://example.com:8080/x", "https://example.com:8080/x"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("ftp://example.com/", None),
    ("mailto:x@example.com", None),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), NORMALIZED)
def test_normalized(spark, raw, want):
    got = one(spark, urls.normalized(F.lit(raw)))
    assert got == want
    if want:
        assert one(spark, urls.normalized(F.lit(got))) == got


def test_resolve_and_scope(spark):
    base = F.lit("http://example.com/a/b?q=1")
    for href, want in (("c", "http://example.com/a/c"), ("/c#x", "http://example.com/c"), ("../c", "http://example.com/c"), ("//other.org/z", "http://other.org/z"), ("javascript:void(0)", None)):
        assert one(spark, urls.resolved(F.lit(href), base)) == want
    for name, want in (("blog.example.com", "example.com"), ("a.b.co.uk", "b.co.uk"), ("localhost", "localhost"), ("127.0.0.1", "127.0.0.1")):
        assert one(spark, urls.registrable(F.lit(name))) == want


def test_http(spark):
    for code, body, want in ((200, True, "success_with_body"), (200, False, "empty_body"), (301, False, "redirect"), (404, True, "not_found"), (429, True, "rate_limited"), (502, True, "unexpected")):
        assert one(spark, http.action(F.lit(code), F.lit(body))) == want
    now = F.lit("2026-07-03 12:00:00").cast("timestamp")
    for value, want in (("10", 10_000), ("-1", None), ("soon", None), ("Fri, 03 Jul 2026 12:00:10 GMT", 10_000), ("Fri, 03 Jul 2026 11:00:00 GMT", 0)):
        assert one(spark, http.retry_after_ms(F.lit(value), now)) == want
    r = one(spark, http.retry(F.lit("server_error"), F.lit(4), F.lit(5), F.lit(None).cast("long")))
    assert (r["retry"], r["delay_ms"]) == (False, None)
    assert one(spark, http.retry(F.lit("rate_limited"), F.lit(9), F.lit(5), F.lit(None).cast("long")))["delay_ms"] == 5000


def test_content(spark):
    assert one(spark, content.kind(F.lit("Text/HTML; charset=x"))) == "html"
    assert one(spark, content.extension(F.lit("video/quicktime"))) == ".mov"
    assert bytes(one(spark, content.decoded(F.lit("aGk="), F.lit("image/png"), "auto"))) == b"hi"
    assert bytes(one(spark, content.decoded(F.lit("aGk="), F.lit("text/plain"), "auto"))) == b"aGk="
    assert one(spark, content.decoded(F.lit("a"), F.lit(None).cast("string"), "base64")) is None
    assert one(spark, content.srcset(F.lit("a.png 1x, b.png 2x,,"))) == ["a.png", "b.png"]
    assert one(spark, content.format_bytes(F.lit(1536))) == "1.5 KB"


def test_parsers():
    page = extract.read_html('<title> A&amp;B </title><img src="i.png"><a href="x">t  <b>u</b></a><link rel="ICON" href="f"><link rel="canonical" href="g"><a href=" ">no</a>')
    assert page["title"] == "A&B"
    assert [(x["source"], x["href"], x["anchor"]) for x in page["links"]] == [("a.href", "x", "t u"), ("img.src", "i.png", None), ("link.href", "f", None)]
    assert extract.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")) == (3, 2)
    assert extract.media_facts("pdf", b"not-a-valid-pdf")[1] == "failed"
    assert extract.pdf_facts(b"%PDF-1.4\n<< /Type /Pages /Count 1 >> << /Type /Page >>") == {"pageCount": 1}


def test_format_bytes_of_every_page(spark, tmp_path):
    """Ties of the one digit stay and go up, as toFixed(1) has it."""
    sizes = {256: "256 B", 768: "768 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1792: "1.8 KB", 2304: "2.3 KB", 2816: "2.8 KB", 3000: "2.9 KB", 1310720: "1.3 MB"}
    spark.createDataFrame([(n, "x" * n) for n in sizes], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in registry.format_bytes(spark, str(tmp_path)).collect()} == sizes


def test_site_graph_report_has_domains_without_links(spark, tmp_path):
    rows = [(1, "https://a.example.com/", '<a href="/x">x</a>'), (2, "https://example.org/", "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in registry.site_graph_report(spark, str(tmp_path)).collect()} == {("example.com", 1, 1, 1, 1), ("example.org", 1, 0, 0, 0)}


ODD_TITLES = ("A&amp;B &lt;i&gt; &quot;q&quot; it&#x27;s", "ends in&amp", "&amp;&amp", "&lt &gt;&ampx; &amp;lt; & &&amp;", "x&notit; y", "")


def against_sql(spark, tmp_path, name):
    """The query's rows and those of its SQL over pages with odd titles."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, f"https://example.com/{k}", f'<html><head><title> {t} </title></head><a href="/x?a=1&amp;b=2">x</a></html>') for k, t in enumerate(ODD_TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = c.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_titles_are_those_of_the_sql(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "title_extract")
    assert got == want and got[1] == (1, "ends in&amp")
    assert extract.read_html("<title>ends in&amp</title>")["title"] == "ends in&"


def test_contents_are_those_of_the_sql(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "contents_build")
    assert got == want and len(got) == len(ODD_TITLES)
