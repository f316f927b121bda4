"""Addresses against the standard library's, and literal cases of links, roots and units."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from finrecon.sources import links

BASES = ("http://a.b/c/d/e?x=1", "http://a.b", "https://a.b:80/c/", "http://a.b/c/d#f")
LINKS = ("../f.pdf", "f.pdf", "../../../g.pdf#p", "?q", "..", "./x/./y/../z.pdf", "/r/../s.pdf?t=/../u", "//h.i/j.pdf", "https://k.l/m", "n/o.pdf", ".", "p/")


def test_addresses_equal_the_standard_librarys(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = {(r["b"], r["x"]): r["y"] for r in spark.createDataFrame(rows, "b string, x string").select("b", "x", links.absolute(F.col("x"), F.col("b")).alias("y")).collect()}
    assert got == {(b, x): urljoin(b, x) for b, x in rows}


def test_each_address_once_with_its_first_text(spark):
    html = "<a href=\"/a.pdf\">One</a> <a href='/b.pdf'>no</a> <a href=\"x.html\">no</a><a href=\"http://s.t/a.pdf\">Two</a><p data-url=\"c.pdf#p\" onclick=\"location='d.pdf'\"></p>http://s.t/a.pdf //u.v/e.pdf?w"
    pages = spark.createDataFrame([(1, "http://s.t/q/", html), (2, "http://s.t", None)], "page_id long, url string, html string")
    got = [(r["link"], r["text"]) for r in links.document_links(pages).orderBy("place").collect()]
    assert got == [("http://s.t/a.pdf", "One"), ("http://s.t/q/c.pdf#p", ""), ("http://s.t/q/d.pdf", ""), ("https://u.v/e.pdf?w", "")]


def test_roots(spark):
    text = "at https://Own.Example.com/x, (http://www.bseindia.com/y) www.third.co.in and http://other.org. https://own.example.com/z"
    got = [r["root"] for r in links.site_roots(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), ["id"], "other").orderBy("place").collect()]
    assert got == ["http://other.org", "https://own.example.com", "https://www.bseindia.com", "https://www.third.co"]


def test_units(spark):
    measures = spark.createDataFrame([(1, 1, "xbrli:pure"), (1, 2, " INR "), (1, 3, "crore"), (2, 1, "hundred thousand"), (3, 1, None)], "f long, ord int, measure string")
    facts = [(1, 1, "5", "0"), (2, 1, "5", "0"), (3, 1, "0", "-7"), (3, 2, "20,000,000", "-7"), (4, 1, "20000", "-4"), (5, 1, "2000", "-4"), (6, 1, "x", None)]
    got = {r["f"]: r["unit"] for r in links.filing_units(measures, spark.createDataFrame(facts, "f long, ord int, value_text string, decimals string"), ["f"]).collect()}
    assert got == {1: 1e-7, 2: 0.01, 3: 1e-7, 4: 1e-7, 5: 0.01, 6: 0.01}
