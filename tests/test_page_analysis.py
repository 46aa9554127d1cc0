"""HTML6-HTML10 on small documents (the reference's page-analysis cases)."""

from pyspark.sql import functions as F

from crawlscope.functions import html as H

PAGE = """<html lang="de"><head><title>  Hallo &amp; Welt </title>
<meta name="generator" content="WordPress 6.4">
<meta content="Kurzbeschreibung" name="description">
<meta name="viewport" content="width=device-width">
<meta name="robots" content="NOINDEX, follow">
<meta property="og:image" content="x.png"><meta property="og:title" content="T">
<link rel="stylesheet canonical" href="https://s.example/">
<link rel="stylesheet" href="https://cdn.example/bootstrap.min.css">
<script src="https://code.jquery.com/jquery.js"></script>
<!-- <h1>commented</h1> -->
</head><body><h1>A</h1><h1 class="x">B</h1><form></form></body></html>"""


def _one(spark, html, headers=None):
    df = spark.createDataFrame([(html, headers or {})], "html string, headers map<string,string>")
    dec = H.decomment(F.col("html"))
    markup = H.clean(F.col("html"))
    h = F.transform_keys(F.col("headers"), lambda k, v: F.lower(k))
    return df.select(H.seo(markup).alias("seo"), H.tech(dec, h).alias("tech"), H.has_form(markup).alias("form"),
                     H.interesting_headers(h).alias("details")).first()


def test_seo_record(spark):
    r = _one(spark, PAGE)
    s = r.seo
    assert s.title == "Hallo & Welt"
    assert s.description == "Kurzbeschreibung"
    assert s.h1_count == 2
    assert s.canonical == "https://s.example/"
    assert s.lang == "de"
    assert s.has_viewport is True
    assert s.robots == "NOINDEX, follow"
    assert list(s.og_tags) == ["og:title", "og:image"]
    assert r.form is True


def test_tech_detection_order_and_headers(spark):
    r = _one(spark, PAGE, {"Server": "nginx/1.24.0", "X-Powered-By": "PHP/8.2.1", "ETag": "", "Via": "1.1 cdn"})
    assert list(r.tech) == ["WordPress", "jQuery", "Bootstrap", "nginx", "PHP"]
    assert dict(r.details) == {"server": "nginx/1.24.0", "x-powered-by": "PHP/8.2.1", "via": "1.1 cdn"}


def test_empty_page(spark):
    r = _one(spark, "")
    assert (r.seo.title, r.seo.h1_count, r.seo.lang, r.seo.has_viewport, list(r.seo.og_tags)) == ("", 0, "", False, [])
    assert list(r.tech) == []


def _issues(spark, rows):
    schema = ("code int, ct string, title string, description string, h1 int, viewport boolean, lang string, "
              "canonical string, robots string, ms double, size bigint")
    df = spark.createDataFrame(rows, schema)
    seo = F.struct(F.col("title").alias("title"), F.col("description").alias("description"),
                   F.col("h1").alias("h1_count"), F.col("canonical").alias("canonical"), F.col("lang").alias("lang"),
                   F.col("viewport").alias("has_viewport"), F.col("robots").alias("robots"))
    return [list(r[0]) for r in df.select(H.issues(F.col("code"), F.col("ct"), seo, F.col("ms"), F.col("size"))).collect()]


def test_issue_rules(spark):
    clean = (200, "text/html", "T", "D", 1, True, "de", "c", "", 100.0, 1000)
    rows = [
        clean,
        (404, "text/html", "T", "D", 1, True, "de", "c", "", 100.0, 1000),
        (200, "text/html", "", "D", 0, True, "de", "c", "", 100.0, 1000),
        (200, "text/html", "x" * 61, "d" * 161, 2, False, "", "", "noindex", 5000.0, 3_000_000),
        (200, "image/png", "", "", 0, False, "", "", "", 3000.0, 2_000_000),
        (200, "text/html", "x" * 60, "d" * 160, 1, True, "de", "c", "", 3000.0, 2_000_000),
    ]
    assert _issues(spark, rows) == [
        [],
        ["http_error"],
        ["no_title", "no_h1"],
        ["title_long", "description_long", "multiple_h1", "no_viewport", "no_lang", "no_canonical", "noindex",
         "slow", "large"],
        [],
        [],
    ]


def test_tags_are_scanned_once(spark):
    """Values are bound, so a page's plan holds a pattern a few times only, whatever reads it."""
    from crawlscope.operators import links as L
    from crawlscope.operators import pages as P

    pages = P.stored_pages_as_fetches(spark.createDataFrame([("https://s.example/", PAGE)], "url string, html string"))
    for df in (P.with_findings(pages), L.extract_links(pages), L.extract_links(pages, mode="rendered")):
        assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") <= 10


def test_attributes_of_a_tag(spark):
    tag = "<a HREF=one href='two' data-x='a > b' empty= '' bare title=\"x &amp; 'y'\"z=1 q=a\"b>"
    found = spark.createDataFrame([(tag,), ("<p>",)], "t string").select(H.attributes(F.col("t")).alias("a")).collect()
    assert found[0].a == {"href": "one", "data-x": "a > b", "empty": "", "bare": "", "title": "x & 'y'", "z": "1", "q": 'a"b'}
    assert found[1].a == {}
