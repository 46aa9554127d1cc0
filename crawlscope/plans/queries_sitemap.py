"""Registered queries: sitemap documents, sitemap writers, seeds, dates,
sorting, gateway and freshness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordering as OR
from ..operators import robots as R
from ..operators import runs as RU
from ..operators import sitemap as SM
from ..sinks import sitemap_xml as SX
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import (
    SQL_F2, SQL_F4, SQL_ROBOTS, SQL_SET3, _pages, fixture_pages, fixture_sitemap_rows, lit, query, with_,
)

SQL_DOCS = f"""
dsrc AS (
  SELECT page_id, {lit(FX.BASE)} || '/p/' || CAST(page_id AS VARCHAR) AS url FROM pages WHERE page_id % 4 <> 1
  UNION ALL SELECT page_id, '{FX.BASE}/only-sitemap/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id < 5),
dfile AS (SELECT CAST(page_id % 7 + floor(page_id / 7000) * 7 AS INTEGER) AS file_no, url FROM dsrc),
docs AS (
  SELECT DISTINCT {lit(FX.SITE)} AS site, '{FX.BASE}/sitemap-' || CAST(file_no AS VARCHAR) || '.xml' AS doc_url, false AS is_index
  FROM dfile
  UNION ALL SELECT {lit(FX.SITE)}, '{FX.BASE}/sitemap.xml', true),
doc_locs AS (
  SELECT {lit(FX.SITE)} AS site, '{FX.BASE}/sitemap-' || CAST(file_no AS VARCHAR) || '.xml' AS doc_url, url AS loc FROM dfile
  UNION ALL
  SELECT site, '{FX.BASE}/sitemap.xml', doc_url FROM docs WHERE NOT is_index)"""


def parsed_docs(spark, d) -> DataFrame:
    return SM.parse_sitemap_documents(FX.sitemap_documents(spark, d))


@query("src2_sitemap_parse", with_(SQL_DOCS) + """
SELECT docs.site, docs.doc_url, docs.is_index, doc_locs.loc FROM docs JOIN doc_locs USING (site, doc_url)""")
def src2_sitemap_parse(spark, d):
    """SRC2: ``<loc>`` entries of every sitemap document (namespaced or not,
    trimmed, empty skipped); an index lists its child documents."""
    p = parsed_docs(spark, d)
    return p.select("site", "doc_url", "is_index", F.explode("locs").alias("loc"))


@query("src3_sitemap_index", with_(SQL_DOCS) + """
SELECT DISTINCT site, loc AS url FROM doc_locs WHERE doc_url <> '""" + FX.BASE + """/sitemap.xml'""")
def src3_sitemap_index(spark, d):
    """SRC3 + SET5: page URLs reachable from the root index (depth <= 3)."""
    roots = FX.sitemap_documents(spark, d).where(F.col("doc_url").endswith("/sitemap.xml")).select("site", "doc_url")
    return SM.load_sitemap_urls(FX.sitemap_documents(spark, d), roots)


@query("src4_sitemap_file", with_(SQL_DOCS) + f"""
, one AS (SELECT DISTINCT site, loc AS url FROM doc_locs WHERE doc_url = '{FX.BASE}/sitemap-0.xml')
SELECT site, url, (SELECT regexp_extract(min(url), '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || '/' FROM one) AS base_url FROM one""")
def src4_sitemap_file(spark, d):
    """SRC4: one local sitemap file as a seed list with its site base."""
    one = parsed_docs(spark, d).where(F.col("doc_url").endswith("/sitemap-0.xml"))
    return SM.sitemap_file_seeds(one).select("site", "url", "base_url")


def sitemap_probe_candidates(spark, d) -> DataFrame:
    """SRC7 input: robots Sitemap lines and well-known paths of every host,
    with logged probe answers. Rule: a robots-listed sitemap answers 200
    (text/xml) when the host name has odd length, else 404; the well-known
    path number (host length mod 5) answers HEAD 200 without a telling type and
    a ranged GET 206 with an XML prolog; the path before it answers HEAD 405
    and such a GET (which doesn't count); other paths 404."""
    robots = FX.robots_files(spark, d)
    sitemaps = R.robots_sitemaps(robots)
    bases = robots.select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/")).alias("base_url"))
    cands = SM.sitemap_candidates(sitemaps, bases)
    odd = F.length("site") % 2 == 1
    from_robots = F.col("priority") < F.lit(1 << 40)
    k = F.col("priority") - F.lit(1 << 40)
    head = F.when(from_robots, F.when(odd, 200).otherwise(404)).otherwise(
        F.when(k == F.length("site") % 5, 200).when(k == F.length("site") % 5 - 1, 405).otherwise(404))
    ranged = ~from_robots & k.isin(F.length("site") % 5, F.length("site") % 5 - 1)
    return cands.select(
        "site", "priority", "url", head.alias("head_status"),
        F.when(from_robots & odd, F.lit("text/xml")).otherwise(F.lit("application/octet-stream")).alias("head_content_type"),
        F.when(ranged, 206).otherwise(404).alias("get_status"),
        F.when(ranged, F.lit('<?xml version="1.0"?><urlset>')).otherwise(F.lit("")).alias("get_prefix"),
    )


@query("src7_sitemap_choice", with_(SQL_ROBOTS) + f"""
, rs AS (SELECT site, CAST(line_no AS BIGINT) AS priority, value AS url FROM rl3
         WHERE starts_with(lower(line), 'sitemap:') AND value <> ''),
wk AS (SELECT site, CAST({1 << 40} + k AS BIGINT) AS priority,
         regexp_replace('https://' || site || '/', '/+$', '') || p AS url
       FROM (SELECT DISTINCT site FROM robots),
            (SELECT unnest({[p for p in SM.WELL_KNOWN_SITEMAP_PATHS]}) AS p,
                    generate_subscripts({[p for p in SM.WELL_KNOWN_SITEMAP_PATHS]}, 1) - 1 AS k)),
c AS (SELECT * FROM rs UNION ALL SELECT * FROM wk),
v AS (SELECT *, priority < {1 << 40} AS fr, priority - {1 << 40} AS k FROM c),
ok AS (SELECT site, priority, url FROM v
       WHERE (fr AND length(site) % 2 = 1) OR (NOT fr AND k = length(site) % 5))
SELECT site, arg_min(url, priority) AS sitemap_url FROM ok GROUP BY site""")
def src7_sitemap_choice(spark, d):
    """SRC7: first valid sitemap per host (robots entries, then well-known paths)."""
    return SM.choose_sitemap(sitemap_probe_candidates(spark, d))


@query("src10_seed_intake", with_(SQL_F4) + f"""
, seeds AS (SELECT site, url FROM f4 UNION ALL SELECT {lit(FX.SITE)}, url FROM pages)
SELECT DISTINCT site, {O.full_normalize('url', 'site', lit(FX.SITE_SCHEME))} AS url, 1 AS depth,
  '{FX.BASE}/p/0' AS parent FROM seeds
WHERE lower({O.part('url', 'netloc')}) = site AND {O.full_normalize('url', 'site', lit(FX.SITE_SCHEME))} <> '{FX.BASE}/p/0'""")
def src10_seed_intake(spark, d):
    """SRC10 + SET4: sitemap URLs (and every stored page URL, rejected for
    another host) entering the frontier at depth 1."""
    from .catalog import fixture_sites
    seeds = FX.sitemap_urls(spark, d).unionByName(
        _pages(spark, d).select(F.lit(FX.SITE).alias("site"), "url"))
    return SM.seed_intake(seeds, fixture_sites(spark, d)).select("site", "url", "depth", "parent")


def _xml_escape_sql(e: str) -> str:
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("snk1_sitemap_xml", with_(SQL_F2, SQL_SET3) + f"""
SELECT site, url, '<url><loc>' || {_xml_escape_sql('url')} || '</loc>' ||
  CASE WHEN last_modified <> '' THEN '<lastmod>' || {_xml_escape_sql('last_modified')} || '</lastmod>' ELSE '' END ||
  '<priority>' || priority || '</priority></url>' AS xml FROM rows""")
def snk1_sitemap_xml(spark, d):
    """SNK1: one ``<url>`` element per sitemap row (lastmod only when set)."""
    return SX.url_elements(fixture_sitemap_rows(spark, d)).select("site", "url", "xml")


SPLIT_PART_SIZE = 50


@query("snk2_sitemap_split_parts_of_50", with_(SQL_F2, SQL_SET3) + f"""
, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY is_resolved, depth, url) AS seq FROM rows),
p AS (SELECT *, CAST(ceil(seq / {SPLIT_PART_SIZE}.0) AS INTEGER) AS part, max(CAST(ceil(seq / {SPLIT_PART_SIZE}.0) AS INTEGER))
        OVER (PARTITION BY site) AS parts FROM n)
SELECT site, url, CAST(seq AS BIGINT) AS seq, part,
  CASE WHEN parts > 1 THEN 'sitemap-' || CAST(part AS VARCHAR) || '.xml' ELSE 'sitemap.xml' END AS file_name FROM p""")
def snk2_sitemap_split(spark, d):
    """SNK2 + W6 + SRT4: sitemap rows in order (direct first, then depth, URL)
    split into parts of 50 URLs (the default part size is 50,000; 50 makes
    the fixture span several parts) with the file each row goes to."""
    parts = SM.with_parts(fixture_sitemap_rows(spark, d), max_urls=SPLIT_PART_SIZE)
    return parts.select("site", "url", "seq", "part", SX.part_file_name(F.col("part"), F.col("parts")).alias("file_name"))


AS_OF = "2026-06-01"


@query("dt1_content_age", with_(SQL_F2) + f"""
, t AS (SELECT site, try_strptime(regexp_replace(regexp_replace(trim(last_modified), '^[A-Za-z]{{3}},\\s*', ''),
          '\\s+(GMT|UTC)$', ''), '%d %b %Y %H:%M:%S') AS ts FROM r2)
SELECT site, CASE WHEN ts IS NULL THEN 'unknown' WHEN date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') < 30 THEN '<30d'
  WHEN date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') < 365 THEN '<365d' ELSE '>=365d' END AS age_bucket,
  CAST(count(*) AS BIGINT) AS pages FROM t GROUP BY ALL""")
def dt1_content_age(spark, d):
    """DT1: pages per Last-Modified age bucket (as of 2026-06-01)."""
    return RU.content_age(fixture_pages(spark, d), AS_OF)


@query("dt1_last_modified_display", with_(SQL_F2) + """
, t AS (SELECT url, last_modified, try_strptime(regexp_replace(regexp_replace(trim(last_modified), '^[A-Za-z]{3},\\s*', ''),
          '\\s+(GMT|UTC)$', ''), '%d %b %Y %H:%M:%S') AS ts FROM r2)
SELECT url, CASE WHEN last_modified = '' THEN '' WHEN ts IS NULL THEN substr(last_modified, 1, 10)
  ELSE strftime(ts, '%Y-%m-%d') END AS last_modified_date FROM t""")
def dt1_last_modified_display(spark, d):
    """DT1: Last-Modified text as an ISO date ('' when empty, first 10
    characters when unparseable)."""
    r = fixture_pages(spark, d)
    return r.select("url", RU.last_modified_display(F.col("last_modified")).alias("last_modified_date"))


@query("srt1_sort_results", with_(SQL_F2) + """
SELECT site, url, last_modified, CAST(row_number() OVER (PARTITION BY site ORDER BY last_modified = '', last_modified, url)
  AS BIGINT) AS sort_pos FROM r2""")
def srt1_sort_results(spark, d):
    """SRT1: result rows sorted by last-modified text ascending, empty values last."""
    r = fixture_pages(spark, d)
    empty = F.coalesce(F.col("last_modified"), F.lit("")) == ""
    out = OR.sequence_within_groups(r, ["site"], [empty, F.col("last_modified"), F.col("url")], out_col="sort_pos")
    return out.select("site", "url", "last_modified", "sort_pos")


@query("srt1_sort_results_desc", with_(SQL_F2) + """
SELECT site, url, load_time_ms, CAST(row_number() OVER (PARTITION BY site ORDER BY load_time_ms DESC, url DESC)
  AS BIGINT) AS sort_pos FROM r2""")
def srt1_sort_results_desc(spark, d):
    """SRT1: result rows by load time descending (URL breaks ties)."""
    r = fixture_pages(spark, d)
    out = OR.sequence_within_groups(r, ["site"], [F.col("load_time_ms").desc(), F.col("url").desc()], out_col="sort_pos")
    return out.select("site", "url", "load_time_ms", "sort_pos")


@query("flt13_gateway_intercept", with_(SQL_F2) + f"""
SELECT site, url AS start_url, redirect_url AS final_url, {O.registrable(O.part('url', 'netloc'))} AS start_domain,
  {O.registrable(O.part('redirect_url', 'netloc'))} AS final_domain FROM r2
WHERE redirect_url <> '' AND {O.registrable(O.part('url', 'netloc'))} <> {O.registrable(O.part('redirect_url', 'netloc'))}""")
def flt13_gateway_intercept(spark, d):
    """FLT13: redirected probes whose final registrable domain differs."""
    r = fixture_pages(spark, d)
    probes = r.select("site", F.col("url").alias("start_url"), F.col("redirect_url").alias("final_url"),
                      (F.col("redirect_url") != "").alias("redirected"))
    return RU.gateway_intercepts(probes)


def fixture_cache(spark, d) -> DataFrame:
    """Cache entries of earlier previews: pages with page_id mod 3 <> 2;
    even ids kept their validator, odd ids an old one; age page_id mod 30 days."""
    f = FX.fetch_log(spark, d)
    i = F.col("page_id")
    v = RU.validator(F.col("response_headers")["ETag"], F.col("last_modified"), F.col("page_size"))
    return f.where(i % 3 != 2).select(
        "url", F.when(i % 2 == 0, v).otherwise(F.lit('etag:"old"')).alias("cached_validator"),
        (F.to_timestamp(F.lit(AS_OF)) - F.make_interval(days=(i % 30).cast("int"))).alias("cached_at"))


@query("flt15_stale_pages", with_(SQL_F2) + f"""
, v AS (SELECT page_id, url, CASE WHEN h_etag <> '' THEN 'etag:' || h_etag WHEN last_modified <> '' THEN 'lm:' || last_modified
          WHEN page_size > 0 THEN 'len:' || CAST(page_size AS VARCHAR) ELSE '' END AS validator FROM f2),
c AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN validator ELSE 'etag:"old"' END AS cached_validator,
        TIMESTAMP '{AS_OF}' - to_days(CAST(page_id % 30 AS INTEGER)) AS cached_at FROM v WHERE page_id % 3 <> 2)
SELECT v.url, v.validator, CASE WHEN c.cached_at IS NULL THEN false
  WHEN v.validator <> '' AND coalesce(c.cached_validator, '') <> '' THEN v.validator = c.cached_validator
  ELSE epoch(TIMESTAMP '{AS_OF}') - epoch(c.cached_at) <= {RU.CACHE_TTL_DAYS} * 86400 END AS fresh
FROM v LEFT JOIN c USING (url)""")
def flt15_stale_pages(spark, d):
    """FLT15: validator per page and whether the cached preview is fresh."""
    f = FX.fetch_log(spark, d)
    pages = f.select("url", RU.validator(F.col("response_headers")["ETag"], F.col("last_modified"),
                                         F.col("page_size")).alias("validator"))
    return RU.freshness(pages, fixture_cache(spark, d), AS_OF).select("url", "validator", "fresh")
