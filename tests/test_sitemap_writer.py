"""SET3/J4/J5/W5/G5/AGG5 and the XML sinks on the reference's sitemap cases."""

import glob
import os
import tempfile
import xml.etree.ElementTree as ET

from crawlscope.operators import sitemap as SM
from crawlscope.sinks import sitemap_xml as SX

SCHEMA = ("site string, url string, status string, http_status_code int, content_type string, depth int, "
          "redirect_url string, last_modified string")
B = "https://www.s.example"
ROWS = [
    ("www.s.example", f"{B}/", "ok", 200, "text/html; charset=utf-8", 0, "", "Sat, 16 May 2026 15:46:36 GMT"),
    ("www.s.example", f"{B}/alt", "redirect", 301, "", 1, f"{B}/neu", ""),
    ("www.s.example", f"{B}/sister", "redirect_external", 301, "", 1, "https://solar.s.example/x", ""),
    ("www.s.example", f"{B}/foreign", "redirect_external", 301, "", 1, "https://other.example/", ""),
    ("www.s.example", f"{B}/empty", "redirect", 301, "", 1, "  ", ""),
    ("www.s.example", f"{B}/a1", "redirect", 301, "", 2, f"{B}/ziel", ""),
    ("www.s.example", f"{B}/a2", "redirect", 301, "", 1, f"{B}/ziel", ""),
    ("www.s.example", f"{B}/a3", "redirect", 301, "", 3, f"{B}/ziel#x", ""),
    ("www.s.example", f"{B}/wärmepumpe", "ok", 200, "text/html", 1, "", ""),
    ("www.s.example", f"{B}/w2", "redirect", 301, "", 1, f"{B}/w%C3%A4rmepumpe", ""),
    ("www.s.example", f"{B}/gone", "error", 404, "text/html", 1, "", ""),
    ("www.s.example", f"{B}/doc", "ok", 200, "application/pdf", 1, "", ""),
]


def _rows(spark):
    return SM.sitemap_rows(spark.createDataFrame(ROWS, SCHEMA))


def test_direct_and_resolved_rows(spark):
    got = {(r.url, r.is_resolved, r.depth, r.priority, r.last_modified) for r in _rows(spark).collect()}
    assert got == {
        (f"{B}/", False, 0, "1.0", "Sat, 16 May 2026 15:46:36 GMT"),
        (f"{B}/wärmepumpe", False, 1, "0.8", ""),
        (f"{B}/neu", True, 1, "0.8", ""),
        (f"{B}/ziel", True, 1, "0.8", ""),
    }


def test_plan_counts(spark):
    plan = SM.sitemap_plan(_rows(spark)).first()
    assert (plan.total_urls, plan.resolved_targets) == (4, 2)


def test_priority_floor(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(d,) for d in range(8)], "d int")
    got = [r[0] for r in df.select(SM.priority(F.col("d"))).collect()]
    assert got == ["1.0", "0.8", "0.6", "0.4", "0.2", "0.1", "0.1", "0.1"]


def test_xml_files_and_split(spark):
    rows = _rows(spark)
    out = tempfile.mkdtemp(prefix="sitemap-test-")
    SX.write_sitemaps(rows, out, max_urls=3)
    folder = os.path.join(out, "site=www.s.example")
    assert sorted(os.listdir(out)) == ["site=www.s.example"] or not glob.glob(os.path.join(out, "_writing", "*"))
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap.xml"]
    ns = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    names = [e.find(f"{ns}loc").text for e in ET.parse(os.path.join(folder, "sitemap.xml")).getroot().findall(f"{ns}sitemap")]
    assert names == ["sitemap-1.xml", "sitemap-2.xml"]
    locs = []
    for name in names:
        root = ET.parse(os.path.join(folder, name)).getroot()
        locs.append([u.find(f"{ns}loc").text for u in root.findall(f"{ns}url")])
        for u in root.findall(f"{ns}url"):
            lm = u.find(f"{ns}lastmod")
            assert lm is None or lm.text
    assert len(locs[0]) == 3 and sorted(sum(locs, [])) == sorted(r.url for r in rows.collect())


def test_parse_documents(spark):
    docs = spark.createDataFrame([
        ("s", "u1", '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
                    "<url><loc> https://s/a </loc></url><url><loc></loc></url></urlset>"),
        ("s", "u2", "<urlset><url><loc>https://s/b</loc></url></urlset>"),
        ("s", "idx", "<sitemapindex><sitemap><loc>u1</loc></sitemap><url><loc>https://s/ignored</loc></url></sitemapindex>"),
        ("s", "bad", "<urlset><url><loc>https://s/c</loc>"),
        ("s", "amp", "<urlset><url><loc>https://s/c?a&b</loc></url></urlset>"), ("s", "none", None),
        ("s", "pi", '<?xml version="1.0"?><?xml-stylesheet href="x"?><!-- <x> --><urlset><url><loc>https://s/d</loc></url></urlset>'),
    ], "site string, doc_url string, xml string")
    got = {r.doc_url: (r.is_index, list(r.locs)) for r in SM.parse_sitemap_documents(docs).collect()}
    assert got == {"u1": (False, ["https://s/a"]), "u2": (False, ["https://s/b"]), "idx": (True, ["u1"]),
                   "bad": (False, []), "amp": (False, []), "none": (False, []), "pi": (False, ["https://s/d"])}
    roots = spark.createDataFrame([("s", "idx")], "site string, doc_url string")
    assert sorted(r.url for r in SM.load_sitemap_urls(docs, roots).collect()) == ["https://s/a"]


def test_options_normalize_and_w3c(spark):
    res = spark.createDataFrame([("s", "https://S.example/a b", 200, "Sat, 16 May 2026 15:46:36 GMT")],
                                "site string, url string, http_status_code int, last_modified string")
    sm = spark.createDataFrame([("s", "https://s.example/a%20b")], "site string, url string")
    assert SM.not_in_sitemap(res, sm).count() == 1
    assert SM.not_in_sitemap(res, sm, normalize=True).count() == 0
    assert SM.sitemap_flag(res, sm, normalize=True).first().missing_from_sitemap is False
    from pyspark.sql import functions as F
    rows = res.withColumn("priority", F.lit("1.0"))
    xml = SX.url_elements(rows, lastmod="w3c").first().xml
    assert "<lastmod>2026-05-16T15:46:36Z</lastmod>" in xml
