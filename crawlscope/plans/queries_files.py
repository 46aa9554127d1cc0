"""Registered queries: file links and their reachability check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import files as FL
from ..operators import links as L
from ..operators import ordering as OR
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import SQL_F2, links_sql, lit, query, with_

EXTENSION_SELECTION = "pdf; .DOCX"

SQL_F6 = f"""
f6 AS (
  SELECT {lit(FX.SITE)} AS site, {lit(FX.SITE_SCHEME)} AS site_scheme, page_id, '{FX.BASE}/p/' || CAST(page_id AS VARCHAR) AS url,
    '<html><body>' || CASE WHEN page_id % 5 = 0 THEN '<p><a href="https://' ||
      CASE WHEN page_id % 3 = 0 THEN 'www.site.example' WHEN page_id % 3 = 1 THEN 'site.example' ELSE 'test.site.example' END
      || '/files/doc' || CAST((page_id % 20 + 20 * (page_id // 100)) AS VARCHAR) || '.pdf">Document ' || CAST((page_id % 20 + 20 * (page_id // 100)) AS VARCHAR) || '</a></p>'
      ELSE '<p>no files</p>' END
      || CASE WHEN page_id % 25 = 10 THEN '<iframe src="https://solar.site.example/files/doc' || CAST((page_id % 20 + 20 * (page_id // 100)) AS VARCHAR)
              || '.pdf"></iframe>' ELSE '' END
      || CASE WHEN page_id % 10 = 0 THEN '<embed src="/files/doc' || CAST((page_id % 20 + 20 * (page_id // 100)) AS VARCHAR) || '.pdf?v=2">' ELSE '' END
      || '<a href="https://site.example/p/1">page</a></body></html>' AS html
  FROM pages)"""

SQL_F7 = f"""
docs AS (SELECT DISTINCT (page_id % 20 + 20 * (page_id // 100)) AS doc FROM f6 WHERE contains(html, '/files/doc')),
f7 AS (
  SELECT '{FX.BASE}/files/doc' || CAST(doc AS VARCHAR) || '.pdf' AS url, 'HEAD' AS method,
    CASE WHEN doc % 20 = 5 THEN 405 WHEN doc % 20 = 10 THEN 404 ELSE 200 END AS status_code, 'application/pdf' AS content_type,
    CASE WHEN doc % 20 = 5 THEN '' ELSE CAST((doc + 1) * 1000 AS VARCHAR) END AS content_length, '' AS content_range FROM docs
  UNION ALL
  SELECT '{FX.BASE}/files/doc' || CAST(doc AS VARCHAR) || '.pdf', 'GET', 206, 'application/pdf', '1',
    'bytes 0-0/' || CAST((doc + 1) * 1000 AS VARCHAR) FROM docs WHERE doc % 20 = 5),
j9 AS (
  SELECT h.url,
    CAST(CASE WHEN h.status_code IN (405, 501) AND g.url IS NOT NULL THEN g.status_code ELSE h.status_code END AS INTEGER)
      AS status_code,
    CASE WHEN h.status_code IN (405, 501) AND g.url IS NOT NULL THEN g.content_type ELSE h.content_type END AS content_type,
    CASE WHEN h.status_code IN (405, 501) AND g.url IS NOT NULL THEN g.content_range ELSE h.content_range END AS cr,
    CASE WHEN h.status_code IN (405, 501) AND g.url IS NOT NULL THEN g.content_length ELSE h.content_length END AS cl,
    h.status_code IN (405, 501) AND g.url IS NOT NULL AS checked_by_get
  FROM (SELECT * FROM f7 WHERE method = 'HEAD') h LEFT JOIN (SELECT * FROM f7 WHERE method = 'GET') g ON g.url = h.url),
j9s AS (
  SELECT url, status_code, content_type, checked_by_get,
    CAST(CASE WHEN regexp_matches(regexp_extract(coalesce(cr, ''), '/([^/]*)$', 1), '^[0-9]+$')
              THEN CAST(regexp_extract(coalesce(cr, ''), '/([^/]*)$', 1) AS BIGINT)
              WHEN regexp_matches(coalesce(cl, ''), '^[0-9]+$') THEN CAST(cl AS BIGINT) ELSE 0 END AS BIGINT) AS size_bytes
  FROM j9)"""

SQL_FILES = f"""
ff AS (SELECT lk.site, lk.target_norm AS url, lk.source_url, lk.position, f2.depth AS source_depth
       FROM lk JOIN f2 ON f2.url = lk.source_url WHERE {O.is_file('lk.target_norm')}),
w3 AS (SELECT site, url, arg_min(source_url, (source_depth, source_url, position)) AS first_source FROM ff GROUP BY site, url),
j8 AS (
  SELECT w3.site, w3.url, w3.first_source, CAST(coalesce(j9s.status_code, 0) AS INTEGER) AS status_code,
    CAST(coalesce(j9s.size_bytes, 0) AS BIGINT) AS size_bytes,
    CASE WHEN j9s.url IS NULL THEN 'no answer' ELSE '' END AS error_message,
    coalesce(j9s.status_code, 0) BETWEEN 200 AND 299 AS ok,
    (w3.site <> '' AND {O.without_environment(O.part('w3.url', 'netloc'))} = {O.without_environment('w3.site')}
      AND {O.environment(O.part('w3.url', 'netloc'))} <> {O.environment('w3.site')}) AS foreign_environment
  FROM w3 LEFT JOIN j9s ON j9s.url = w3.url)"""


def file_links(spark, d) -> DataFrame:
    """F6 page markup -> HTML1 links -> file targets with source depth."""
    links = L.extract_links(FX.file_link_pages(spark, d))
    depth = FX.fetch_log(spark, d).select(F.col("url").alias("source_url"), F.col("depth").alias("source_depth"))
    files = links.where(FL.same_site_file(F.col("target_norm"), F.col("site")))
    return files.join(depth, "source_url").select("site", F.col("target_norm").alias("url"), "source_url", "position",
                                                  "source_depth", "kind", "target_url")


def first_sources(spark, d) -> DataFrame:
    return FL.first_source(file_links(spark, d))


def checked_files(spark, d) -> DataFrame:
    return FL.check_files(first_sources(spark, d), FL.merge_head_get(FX.file_check_answers(spark, d)))


@query("flt12_same_site_files", with_(SQL_F2, SQL_F6, links_sql("f6")) + f"""
SELECT site, target_norm AS url, source_url, position, kind, {O.environment(O.part('target_norm', 'netloc'))} AS environment
FROM lk WHERE {O.is_file('target_norm')}""")
def flt12_same_site_files(spark, d):
    """HTML1 second arm + FLT12 + HTML3: file links on the site modulo environment
    prefix (sister sub-domains dropped), embeds included."""
    from ..functions import urls as U
    fl = file_links(spark, d)
    return fl.select("site", "url", "source_url", "position", "kind",
                     U.environment(U.url_part(F.col("url"), "netloc")).alias("environment"))


@query("w3_first_source", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + "SELECT site, url, first_source FROM w3")
def w3_first_source(spark, d):
    """First page (by depth, URL, position) linking each file."""
    return first_sources(spark, d)


@query("flt9_extension_filter", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + """
SELECT site, url FROM w3 WHERE ends_with(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '.pdf')""")
def flt9_extension_filter(spark, d):
    """FLT9: file links filtered by the selection "pdf; .DOCX"."""
    return FL.extension_filter(first_sources(spark, d), FL.parse_extensions(EXTENSION_SELECTION)).select("site", "url")


@query("j9_head_get", with_(SQL_F6, SQL_F7) + "SELECT url, status_code, content_type, size_bytes, checked_by_get FROM j9s")
def j9_head_get(spark, d):
    """HEAD answers with the GET fallback for 405/501 and the size rule."""
    return FL.merge_head_get(FX.file_check_answers(spark, d))


@query("j8_file_check", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + """
SELECT site, url, first_source, status_code, size_bytes, error_message, ok, foreign_environment FROM j8""")
def j8_file_check(spark, d):
    """J8 + FLT11: file links with check result, reachability and environment."""
    return checked_files(spark, d)


@query("agg8_file_summary", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + """
SELECT site, CAST(count(*) AS BIGINT) AS total, CAST(count_if(ok) AS BIGINT) AS ok,
  CAST(count_if(NOT ok) AS BIGINT) AS failed, CAST(count_if(foreign_environment) AS BIGINT) AS foreign_environment
FROM j8 GROUP BY site""")
def agg8_file_summary(spark, d):
    """AGG8: total, reachable, failed and foreign-environment files."""
    return FL.summary(checked_files(spark, d))


@query("srt2_file_order", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + """
SELECT site, url, ok, CAST(row_number() OVER (PARTITION BY site ORDER BY ok, url) AS BIGINT) AS pos FROM j8""")
def srt2_file_order(spark, d):
    """SRT2: failed files first, then by URL."""
    c = checked_files(spark, d)
    return OR.sequence_within_groups(c, ["site"], ["ok", "url"], out_col="pos").select("site", "url", "ok", "pos")


def _size_sql(e: str) -> str:
    kb = f"printf('%.1f KB', round_even({e} / 1024.0, 1))"
    mb = f"printf('%.1f MB', round_even({e} / 1048576.0, 1))"
    return f"(CASE WHEN {e} <= 0 THEN '' ELSE replace(CASE WHEN {e} < 1048576 THEN {kb} ELSE {mb} END, '.', ',') END)"


@query("snk8_file_tsv", with_(SQL_F2, SQL_F6, links_sql("f6"), SQL_F7, SQL_FILES) + f"""
SELECT site, url, concat_ws(chr(9), CASE WHEN error_message <> '' THEN error_message ELSE CAST(status_code AS VARCHAR) END,
  CASE WHEN ok THEN {_size_sql('size_bytes')} ELSE '' END, url, first_source) AS line FROM j8""")
def snk8_file_tsv(spark, d):
    """SNK8: tab-separated export line per checked file."""
    return FL.tsv_lines(checked_files(spark, d))
