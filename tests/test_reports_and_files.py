"""SNK5/SNK6 tracker tables, FLT9/FLT11/FLT12, J8/J9, AGG8, SNK8."""

from pyspark.sql import functions as F

from crawlscope.operators import files as FL
from crawlscope.operators import links as L
from crawlscope.sinks import reports as RP

ERR_SCHEMA = ("site string, url string, status string, http_status_code int, "
              "referring_pages array<struct<url:string,link_text:string>>")


def _errors(spark):
    return spark.createDataFrame([
        ("s", "https://s/tot", "error", 404, [("https://s/a", "Mehr | Infos"), ("https://s/b", "  ")]),
        ("s", "https://s/x|y", "error", 0, []),
    ], ERR_SCHEMA)


def test_markdown_rows(spark):
    got = {r.url: r.line for r in RP.markdown_rows(_errors(spark)).collect()}
    assert got["https://s/tot"] == "| https://s/tot | 404 | error | [Mehr \\| Infos](https://s/a)<br>https://s/b |"
    assert got["https://s/x|y"] == "| https://s/x\\|y | - | error | - |"
    assert RP.markdown_header()[1] == "| --- | --- | --- | --- |"


def test_wiki_rows(spark):
    got = {r.url: r.line for r in RP.wiki_rows(_errors(spark)).collect()}
    assert got["https://s/tot"] == '|[https://s/tot]|404|error|"Mehr | Infos" [https://s/a] \\\\ [https://s/b]|'
    assert got["https://s/x|y"] == "|[https://s/x|y]|-|error|-|"


def test_extension_filter(spark):
    links = spark.createDataFrame([(u,) for u in ["https://s/a.pdf", "https://s/b.DOCX", "https://s/c.zip",
                                                  "https://s/d.pdf?v=2"]], "url string")
    sel = FL.parse_extensions(".PDF; docx")
    assert sel == ["pdf", "docx"]
    assert sorted(r.url for r in FL.extension_filter(links, sel).collect()) == [
        "https://s/a.pdf", "https://s/b.DOCX", "https://s/d.pdf?v=2"]
    assert FL.extension_filter(links, []).count() == 4


def test_same_site_files_in_html(spark):
    html = ('<a href="https://www.s.example/x.pdf">a</a><a href="https://s.example/y.pdf">b</a>'
            '<a href="https://test.s.example/z.pdf">c</a><a href="https://s.example/page">d</a>'
            '<a href="https://solar.s.example/w.pdf">e</a><embed src="/e.pdf"><iframe src="about:blank"></iframe>'
            '<object data="https://www.s.example/o.pdf"></object>')
    pages = spark.createDataFrame([("www.s.example", "https", "https://www.s.example/p", html)],
                                  "site string, site_scheme string, url string, html string")
    got = [(r.target_url, r.kind) for r in L.extract_links(pages).orderBy("position").collect()]
    assert got == [("https://www.s.example/x.pdf", "a"), ("https://s.example/y.pdf", "a"),
                   ("https://test.s.example/z.pdf", "a"), ("https://www.s.example/e.pdf", "embed"),
                   ("https://www.s.example/o.pdf", "object")]
    env = spark.createDataFrame([(u,) for u, _ in got], "url string").select(
        "url", FL.is_foreign_environment(F.col("url"), F.lit("www.s.example")).alias("foreign"))
    assert [r.foreign for r in env.collect()] == [False, False, True, False, False]


def test_head_get_merge_and_summary(spark):
    answers = spark.createDataFrame([
        ("https://s/a.pdf", "HEAD", 200, "application/pdf", "1234", ""),
        ("https://s/b.pdf", "HEAD", 404, "text/html", "", ""),
        ("https://s/c.pdf", "HEAD", 405, "", "", ""),
        ("https://s/c.pdf", "GET", 206, "application/pdf", "1", "bytes 0-0/2048"),
    ], "url string, method string, status_code int, content_type string, content_length string, content_range string")
    checks = FL.merge_head_get(answers)
    got = {r.url: (r.status_code, r.size_bytes, r.checked_by_get) for r in checks.collect()}
    assert got == {"https://s/a.pdf": (200, 1234, False), "https://s/b.pdf": (404, 0, False),
                   "https://s/c.pdf": (206, 2048, True)}
    links = spark.createDataFrame([("s", "https://s/a.pdf", "https://s/p1"), ("s", "https://s/b.pdf", "https://s/p2"),
                                   ("s", "https://s/c.pdf", "https://s/p3"), ("s", "https://test.s/d.pdf", "https://s/p4")],
                                  "site string, url string, first_source string")
    checked = FL.check_files(links, checks)
    s = FL.summary(checked).first()
    assert (s.total, s.ok, s.failed) == (4, 2, 2)
    lines = {r.url: r.line for r in FL.tsv_lines(checked).collect()}
    assert lines["https://s/c.pdf"] == "206\t2,0 KB\thttps://s/c.pdf\thttps://s/p3"
    assert lines["https://s/b.pdf"] == "404\t\thttps://s/b.pdf\thttps://s/p2"
    assert lines["https://test.s/d.pdf"].startswith("no answer\t\t")


def test_tracker_table_file_per_site(spark):
    import glob
    import os
    import tempfile
    out = tempfile.mkdtemp(prefix="tracker-test-")
    errors = _errors(spark).unionByName(spark.createDataFrame(
        [("t", "https://t/z", "error", 500, [])], ERR_SCHEMA))
    RP.write_markdown_table(errors, out)
    files = sorted(glob.glob(os.path.join(out, "site=s", "*.txt")))
    lines = [line.rstrip("\n") for f in files for line in open(f, encoding="utf-8")]
    assert lines[:2] == RP.markdown_header()
    assert sorted(lines[2:]) == sorted(r.line for r in RP.markdown_rows(_errors(spark)).collect())
    assert os.path.isdir(os.path.join(out, "site=t"))
