"""Registered queries over awkward markup and broken sitemap documents.

The inputs are built from every row of ``pages``; the expected rows are stated
in SQL for each page, not parsed out of the markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import links as L
from ..operators import sitemap as SM
from .catalog import _pages, query

# "@" stands for the page's id.
AWKWARD = (
    "<title data-x='a>b'>B&uuml;ro &#8211; &amp;&#x41;@ &copy &nope; &#128;</title>"
    "<!-- <a href='/comment'>no</a> --><a title=\"a > b\" href=\"/gt@\">A &lt; <b title='>'>b</b></a>"
    "<a title='see href=/no here' href='/yes@'>yes</a>"
    "<script>var s = \"<!--\";</script><a href=/after@>after</a><!-- c -->"
    "<style>a > b { content: '<a href=/style>' }</style><a HREF = '/uml&auml;ut@?a=1&amp;b=2'>\u00a0x\u00a0</a>"
    "<a name='top'>anchor</a><a class=\"c\"href=\"p//q@\">tight</a><a href='mailto:x@x.example'>mail</a>"
    "<object data='/o@.pdf'></object><iframe src='/i@.pdf;v=1'></iframe><embed src='/e@.pdf'>"
    "<form action='?a>b'><h1 class='>'>one</h1><meta name='description' content=' it&#39;s '>"
)


def awkward_pages(spark, d) -> DataFrame:
    """One awkward page for each stored page, on one host of its own."""
    i = F.col("page_id").cast("string")
    return _pages(spark, d).select(
        "page_id", F.lit("h.example").alias("site"), F.lit("https").alias("site_scheme"),
        F.concat(F.lit("https://h.example/d/"), i).alias("url"), F.replace(F.lit(AWKWARD), F.lit("@"), i).alias("html"))


@query("html1_awkward_links", """
SELECT 'h.example' AS site, 'https://h.example/d/' || i AS source_url, position, target_url, target_norm, link_text, kind
FROM (SELECT CAST(page_id AS VARCHAR) AS i FROM pages), LATERAL (VALUES
  (0, 'https://h.example/gt' || i, 'https://h.example/gt' || i, 'A <b', 'a'),
  (1, 'https://h.example/yes' || i, 'https://h.example/yes' || i, 'yes', 'a'),
  (2, 'https://h.example/after' || i, 'https://h.example/after' || i, 'after', 'a'),
  (3, 'https://h.example/umläut' || i || '?a=1&b=2', 'https://h.example/uml%C3%A4ut' || i || '?a=1&b=2', 'x', 'a'),
  (5, 'https://h.example/d/p/q' || i, 'https://h.example/d/p/q' || i, 'tight', 'a'),
  (7, 'https://h.example/e' || i || '.pdf', 'https://h.example/e' || i || '.pdf', '', 'embed'),
  (8, 'https://h.example/i' || i || '.pdf;v=1', 'https://h.example/i' || i || '.pdf;v=1', '', 'iframe'),
  (9, 'https://h.example/o' || i || '.pdf', 'https://h.example/o' || i || '.pdf', '', 'object')
) v(position, target_url, target_norm, link_text, kind)""")
def html1_awkward_links(spark, d):
    """HTML1-HTML3, URL2, URL3, SET6 on markup with quoted ">", decoy attributes, comments in scripts and entities."""
    return L.extract_links(awkward_pages(spark, d))


@query("html4_awkward_links", """
SELECT 'h.example' AS site, 'https://h.example/d/' || i AS source_url, position, target_url, target_norm, link_text, kind
FROM (SELECT CAST(page_id AS VARCHAR) AS i FROM pages), LATERAL (VALUES
  (0, 'https://h.example/gt' || i, 'https://h.example/gt' || i, 'A < b', 'a'),
  (1, 'https://h.example/yes' || i, 'https://h.example/yes' || i, 'yes', 'a'),
  (2, 'https://h.example/after' || i, 'https://h.example/after' || i, 'after', 'a'),
  (3, 'https://h.example/umläut' || i || '?a=1&b=2', 'https://h.example/uml%C3%A4ut' || i || '?a=1&b=2', 'x', 'a'),
  (5, 'https://h.example/d/p/q' || i, 'https://h.example/d/p/q' || i, 'tight', 'a'),
  (7, 'https://h.example/d/' || i, 'https://h.example/d/' || i, 'self', 'a'),
  (8, 'https://h.example/d/' || i || '#part', 'https://h.example/d/' || i, 'part', 'a'),
  (9, 'https://h.example/o' || i || '.pdf', 'https://h.example/o' || i || '.pdf', '', 'object'),
  (10, 'https://h.example/i' || i || '.pdf;v=1', 'https://h.example/i' || i || '.pdf;v=1', '', 'iframe'),
  (11, 'https://h.example/e' || i || '.pdf', 'https://h.example/e' || i || '.pdf', '', 'embed')
) v(position, target_url, target_norm, link_text, kind)""")
def html4_awkward_links(spark, d):
    """HTML4 on the same pages, with an empty href (the page itself) and a fragment: embeds in document order."""
    pages = awkward_pages(spark, d).withColumn("html", F.concat("html", F.lit('<a href="">self</a><a href="#part"> part </a>')))
    return L.extract_links(pages, mode="rendered")


@query("html7_awkward_seo", """
SELECT page_id, 'Büro – &A' || page_id || ' © &nope; €' AS title, 'it''s' AS description,
  1 AS h1_count, true AS has_form FROM pages""")
def html7_awkward_seo(spark, d):
    """HTML6 + HTML7 on the same pages."""
    pages = awkward_pages(spark, d).select("page_id", H.clean(F.col("html")).alias("m"))
    seo = H.seo(F.col("m"))
    return pages.select("page_id", seo["title"].alias("title"), seo["description"].alias("description"),
                        seo["h1_count"].alias("h1_count"), H.has_form(F.col("m")).alias("has_form"))


@query("src2_awkward_documents", """
SELECT 'h.example' AS site, 'https://h.example/s' || page_id || '.xml' AS doc_url, page_id % 10 IN (6, 9) AS is_index,
  'https://h.example/' || page_id || CASE WHEN page_id % 10 IN (6, 9) THEN '.xml' ELSE '?a=1&b=2' END AS loc
FROM pages WHERE page_id % 10 NOT IN (1, 2)""")
def src2_awkward_documents(spark, d):
    """SRC2 over documents with processing instructions, comments, a doctype
    or a prefix, with other root elements and mixed children, and over
    malformed ones, which give no rows."""
    i = F.col("page_id").cast("string")
    entries = F.concat(F.lit("<url><loc> https://h.example/"), i, F.lit("?a=1&amp;b=2\t</loc></url><url><loc>  </loc></url>"))
    urlset = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entries, F.lit("</urlset>"))
    child = F.concat(F.lit("<sitemap><loc>https://h.example/"), i, F.lit(".xml</loc></sitemap>"))
    kind = F.col("page_id") % 10
    xml = (
        F.when(kind == 1, F.concat(F.lit("<urlset><url><loc>https://h.example/?a&b"), i, F.lit("</loc></url></urlset>")))
        .when(kind == 2, F.concat(F.lit("<urlset><url><loc>https://h.example/"), i, F.lit("</url></urlset>")))
        .when(kind == 3, F.concat(F.lit('<?xml version="1.0"?>\n<?xml-stylesheet type="text/xsl" href="a.xsl"?>'), urlset))
        .when(kind == 4, F.concat(F.lit("<!-- made by <tool> -->\n"), urlset))
        .when(kind == 5, F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE urlset>'), urlset))
        .when(kind == 6, F.concat(F.lit("<sitemapindex>"), child, F.lit("</sitemapindex>")))
        # any root will do, and one sitemap child makes any document an index
        .when(kind == 7, F.concat(F.lit("<URLSET>"), entries, F.lit("</URLSET>")))
        .when(kind == 8, F.concat(F.lit("<feed>"), entries, F.lit("</feed>")))
        .when(kind == 9, F.concat(F.lit("<urlset>"), entries, child, F.lit("</urlset>")))
        .otherwise(urlset))
    docs = _pages(spark, d).select(F.lit("h.example").alias("site"), F.concat(F.lit("https://h.example/s"), i, F.lit(".xml")).alias("doc_url"), xml.alias("xml"))
    return SM.parse_sitemap_documents(docs).select("site", "doc_url", "is_index", F.explode("locs").alias("loc"))
