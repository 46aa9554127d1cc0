"""Registered queries: one per operator of the inventory, each with the
equivalent DuckDB SQL used as the correctness oracle.

Every query reads the given tables (``pages``, ``events``) or inputs derived
from them row by row (``crawlscope.sources.fixtures``), so its work grows with
the tables. Arrays are flattened to joined strings and counts cast to BIGINT
so both engines produce comparable columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import status as S
from ..functions import urls as U
from ..operators import crawl as C
from ..operators import links as L
from ..operators import pages as P
from ..operators import robots as R
from ..operators import sitemap as SM
from ..operators import stats as ST
from ..sources import fixtures as FX
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


# ---------------------------------------------------------------------------
# Shared SQL building blocks (DuckDB)
# ---------------------------------------------------------------------------
lit = O.lit
N = "(SELECT count(*) FROM pages)"
PURL = f"'{FX.BASE}/p/' || CAST(page_id AS VARCHAR)"

SQL_PAGES_AS_FETCHES = f"""
pf AS (
  SELECT lower({O.part('url', 'netloc')}) AS site, lower({O.part('url', 'scheme')}) AS site_scheme, page_id, url, html,
    200 AS http_status_code, '' AS redirect_url, 'text/html; charset=utf-8' AS content_type, '' AS error_message,
    CAST(0.0 AS DOUBLE) AS load_time_ms, CAST(strlen(html) AS BIGINT) AS page_size
  FROM pages)"""

SQL_F2 = f"""
f2c AS (
  SELECT page_id, html, CAST(CASE WHEN page_id = 0 THEN 200 WHEN page_id % 11 = 3 THEN 301 WHEN page_id % 13 = 5 THEN 404
      WHEN page_id % 17 = 9 THEN 500 WHEN page_id % 19 = 7 THEN 0 ELSE 200 END AS INTEGER) AS http_status_code
  FROM pages),
f2 AS (
  SELECT {lit(FX.SITE)} AS site, {lit(FX.SITE_SCHEME)} AS site_scheme, page_id, {PURL} AS url, http_status_code,
    CASE WHEN http_status_code <> 301 THEN '' WHEN page_id % 3 = 0 THEN '{FX.BASE}/p/' || CAST(page_id + 1 AS VARCHAR)
         WHEN page_id % 3 = 1 THEN '{FX.BASE}/alias/' || CAST(page_id % 5 AS VARCHAR) ELSE {lit(FX.EXTERNAL_LOGIN)} END
      AS redirect_url,
    CASE WHEN page_id % 23 = 1 THEN 'application/pdf' ELSE {lit(FX.HTML_TYPE)} END AS content_type,
    CASE WHEN http_status_code = 0 THEN 'timed out' ELSE '' END AS error_message,
    CAST((page_id * 37) % 4000 AS DOUBLE) AS load_time_ms,
    CAST((page_id * 7919) % 2500000 AS BIGINT) AS page_size,
    CASE WHEN page_id % 4 = 0 THEN '' ELSE {lit(FX.LAST_MODIFIED)} END AS last_modified,
    CAST(length(bin(page_id + 1)) - 1 AS INTEGER) AS depth,
    CASE WHEN page_id = 0 THEN '' ELSE '{FX.BASE}/p/' || CAST((page_id - 1) // 2 AS VARCHAR) END AS parent_url,
    page_id % 29 = 4 AS has_form,
    CASE WHEN page_id % 3 = 0 THEN 'nginx/1.24.0' WHEN page_id % 3 = 1 THEN 'Apache/2.4' ELSE '' END AS h_server,
    CASE WHEN page_id % 4 = 0 THEN 'PHP/8.2.1' ELSE '' END AS h_powered,
    CASE WHEN page_id % 2 = 0 THEN '"e' || CAST(page_id AS VARCHAR) || '"' ELSE '' END AS h_etag,
    CASE WHEN page_id % 5 = 0 THEN 'HIT' ELSE '' END AS h_xcache,
    html
  FROM f2c),
r2 AS (
  SELECT *,
    CASE WHEN http_status_code = 0 AND error_message <> '' THEN 'error'
         WHEN redirect_url <> '' THEN (CASE WHEN lower({O.part('redirect_url', 'netloc')}) <> site
                                            THEN 'redirect_external' ELSE 'redirect' END)
         WHEN http_status_code >= 400 THEN 'error' ELSE 'ok' END AS status
  FROM f2)"""

SQL_F3 = f"""
f3 AS (
  SELECT {lit(FX.SITE)} AS site, {PURL} AS source_url, 1 AS position,
         '{FX.BASE}/p/' || CAST(2 * page_id + 1 AS VARCHAR) AS target_url, 'link 1' AS link_text
    FROM pages WHERE 2 * page_id + 1 < {N}
  UNION ALL
  SELECT {lit(FX.SITE)}, {PURL}, 2, '{FX.BASE}/p/' || CAST(2 * page_id + 2 AS VARCHAR), 'link 2'
    FROM pages WHERE 2 * page_id + 2 < {N}
  UNION ALL
  SELECT {lit(FX.SITE)}, {PURL}, 3, '{FX.BASE}/p/' || CAST((7 * page_id + 3) % {N} AS VARCHAR), 'link 3' FROM pages
  UNION ALL
  SELECT {lit(FX.SITE)}, {PURL}, 4, '{FX.BASE}/p/0', 'link 4' FROM pages WHERE page_id > 0)"""

SQL_F4 = f"""
f4 AS (
  SELECT {lit(FX.SITE)} AS site, {PURL} AS url FROM pages WHERE page_id % 4 <> 1
  UNION ALL
  SELECT {lit(FX.SITE)}, '{FX.BASE}/only-sitemap/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id < 5)"""

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
SQL_ROBOTS = f"""
robots AS (
  SELECT {lit(FX.SITE)} AS site, {lit(FX.ROBOTS_TXT)} AS text FROM pages WHERE page_id = 0
  UNION ALL
  SELECT site, 'User-agent: OtherBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *  # everyone else'
      || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY page_id), '') || chr(10) || 'Disallow: /*.html$' || chr(10)
      || 'Sitemap: https://' || site || '/sitemap.xml' AS text
  FROM (SELECT {_HOST} AS site, page_id,
          CASE WHEN page_id % 9 = 0 THEN 'Allow: ' || {_PATH} || '*' WHEN page_id % 3 = 0 THEN 'Disallow: ' || {_PATH}
          END AS line FROM pages)
  GROUP BY site),
rl AS (
  SELECT site, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS raw,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) - 1 AS line_no
  FROM robots),
rl2 AS (
  SELECT site, line_no, {O.strip(f"regexp_replace({O.strip('raw')}, '#.*$', '')")} AS line FROM rl),
rl3 AS (
  SELECT site, line_no, line, {O.strip("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value,
    last_value(CASE WHEN starts_with(lower(line), 'user-agent:') THEN {O.strip("regexp_extract(line, '^[^:]*:(.*)$', 1)")}
      END IGNORE NULLS) OVER (PARTITION BY site ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS agent
  FROM rl2 WHERE line <> ''),
rules AS (
  SELECT site, line_no, value AS pattern, starts_with(lower(line), 'allow:') AS allow,
    '^' || replace(regexp_replace(CASE WHEN ends_with(value, '$') THEN regexp_replace(value, '\\$$', '') ELSE value END,
        '([\\\\.+?^${{}}()|\\[\\]])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END
      AS regex,
    CAST(length(value) AS INTEGER) AS length
  FROM rl3
  WHERE NOT starts_with(lower(line), 'user-agent:') AND agent = '*' AND value <> ''
    AND (starts_with(lower(line), 'disallow:') OR starts_with(lower(line), 'allow:')))"""


def robots_path_sql(u: str) -> str:
    p = f"regexp_extract({O.part(u, 'path')}, {lit(O.PATH_PARAMS_RE)}, 1)"
    p = f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
    qq = O.part(u, "query")
    return f"(CASE WHEN {qq} <> '' THEN {p} || '?' || {qq} ELSE {p} END)"


def allowed_sql(urls_cte: str) -> str:
    """CTE ``al(site, url, allowed)`` over a CTE with (site, url)."""
    return f"""
ju AS (SELECT DISTINCT site, url, {robots_path_sql('url')} AS path FROM {urls_cte}),
hits AS (SELECT ju.site, ju.url, r.length, r.allow FROM ju JOIN rules r ON ju.site = r.site
         WHERE regexp_matches(ju.path, r.regex)),
best AS (SELECT site, url, arg_max(allow, length * 2 + CAST(allow AS INTEGER)) AS allow FROM hits GROUP BY site, url),
al AS (SELECT ju.site, ju.url, coalesce(best.allow, true) AS allowed FROM ju LEFT JOIN best USING (site, url))"""


def links_sql(src: str) -> str:
    """CTE ``lk`` = HTML1 over a CTE with (site, site_scheme, url, html)."""
    m = O.clean("html")
    skip_a = " OR ".join(f"starts_with(href, {lit(p)})" for p in O.SKIP_HREF_PREFIXES)
    skip_e = " OR ".join(f"starts_with(href, {lit(p)})" for p in O.SKIP_EMBED_PREFIXES)
    netloc = f"lower({O.part('target_url', 'netloc')})"
    return f"""
lm AS (SELECT site, site_scheme, url AS source_url, {m} AS m FROM {src}),
lp AS (SELECT *, regexp_split_to_array(m, '(?i)<a\\s') AS pcs, list_concat(list_concat(
                regexp_extract_all(m, '(?is)<embed\\s[^>]*>', 0), regexp_extract_all(m, '(?is)<iframe\\s[^>]*>', 0)),
                regexp_extract_all(m, '(?is)<object\\s[^>]*>', 0)) AS ems FROM lm),
la AS (SELECT site, site_scheme, source_url, unnest(pcs[2:]) AS piece,
              CAST(generate_subscripts(pcs[2:], 1) - 1 AS INTEGER) AS position FROM lp),
lat AS (SELECT *, '<a ' || regexp_extract(piece, '^([^>]*)>?', 1) AS tag,
               regexp_extract(piece, '(?is)^[^>]*>(.*?)(?:</a\\s*>|$)', 1) AS inner_html FROM la),
lac AS (SELECT site, site_scheme, source_url, position, {O.has_attr('tag', 'href')} AS present,
               {O.strip(O.attr('tag', 'href'))} AS href, substr({O.text_of('inner_html')}, 1, {O.LINK_TEXT_MAX_CHARS}) AS link_text,
               'a' AS kind FROM lat),
le AS (SELECT site, site_scheme, source_url, unnest(ems) AS tag,
              CAST(len(pcs) - 1 + generate_subscripts(ems, 1) - 1 AS INTEGER) AS position FROM lp),
lec AS (SELECT site, site_scheme, source_url, position,
               CASE WHEN lower(regexp_extract(tag, '^<(\\w+)', 1)) = 'object' THEN {O.has_attr('tag', 'data')}
                    ELSE {O.has_attr('tag', 'src')} END AS present,
               {O.strip(f"CASE WHEN lower(regexp_extract(tag, '^<(\\w+)', 1)) = 'object' THEN {O.attr('tag', 'data')} ELSE {O.attr('tag', 'src')} END")} AS href,
               '' AS link_text, lower(regexp_extract(tag, '^<(\\w+)', 1)) AS kind FROM le),
lall AS (
  SELECT * FROM lac WHERE present AND href <> '' AND NOT ({skip_a})
  UNION ALL
  SELECT * FROM lec WHERE present AND href <> '' AND NOT ({skip_e})),
lres AS (SELECT site, site_scheme, source_url, position, {O.resolve('source_url', 'href')} AS target_url, link_text, kind
         FROM lall),
lk AS (SELECT site, source_url, position, target_url,
              {O.full_normalize('target_url', 'site', 'site_scheme')} AS target_norm, link_text, kind
       FROM lres
       WHERE {netloc} = site OR ({O.is_file('target_url')} AND {O.without_environment(netloc)} = {O.without_environment('site')}))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


# ---------------------------------------------------------------------------
# Real pages (stored fetches of many sites)
# ---------------------------------------------------------------------------

@query("url1_normalize", f"SELECT page_id, url, {O.normalize('url')} AS url_norm FROM pages")
def url1_normalize(spark, d):
    """URL1 over every page URL."""
    return _pages(spark, d).select("page_id", "url", U.normalize(F.col("url")).alias("url_norm"))


@query("url4_url9_projections", f"""
SELECT page_id, {O.host(O.part('url', 'netloc'))} AS host, {O.environment(O.part('url', 'netloc'))} AS environment,
  {O.without_environment(O.part('url', 'netloc'))} AS site_host, {O.registrable(O.part('url', 'netloc'))} AS registrable,
  {O.is_file('url')} AS is_file, {O.extension('url')} AS extension,
  ({O.host(O.part('url', 'netloc'))} <> '' AND {O.host(O.part('url', 'netloc'))} = {O.without_environment(O.part('url', 'netloc'))}) AS same_host_as_site
FROM pages""")
def url_projections(spark, d):
    """URL4 URL5 URL6 URL7 URL8 URL9: host, environment, host without
    environment prefix, registrable domain, file flag and extension of every
    page URL (same_host_as_site: URL4 between the host and the host without
    environment prefix)."""
    u = F.col("url")
    nl = U.url_part(u, "netloc")
    return _pages(spark, d).select(
        "page_id", U.host_without_port(nl).alias("host"), U.environment(nl).alias("environment"),
        U.without_environment(nl).alias("site_host"), U.registrable_domain(nl).alias("registrable"),
        U.is_file(u).alias("is_file"), U.file_extension(u).alias("extension"),
        U.same_host(nl, U.without_environment(nl)).alias("same_host_as_site"),
    )


def real_links(spark, d) -> DataFrame:
    return L.extract_links(P.stored_pages_as_fetches(_pages(spark, d)))


@query("html1_links", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + "SELECT * FROM lk")
def html1_links(spark, d):
    """HTML1 + HTML2 + HTML3 + URL2 + URL3 + SET6 over every stored page."""
    return real_links(spark, d)


@query("agg6_links_per_page", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + """
SELECT pf.site, pf.url, CAST(count(lk.source_url) AS BIGINT) AS links_found
FROM pf LEFT JOIN lk ON pf.site = lk.site AND pf.url = lk.source_url GROUP BY pf.site, pf.url""")
def agg6_links_per_page(spark, d):
    """AGG6: links found per page (duplicates, files and embeds included)."""
    pages = P.stored_pages_as_fetches(_pages(spark, d))
    return L.links_per_page(pages, L.extract_links(pages))


@query("agg7_referrers", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + f"""
, first AS (SELECT site, target_norm, source_url, arg_min(link_text, position) AS link_text
            FROM lk GROUP BY site, target_norm, source_url),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, target_norm ORDER BY source_url) AS rk FROM first)
SELECT site, target_norm, CAST(count(*) AS BIGINT) AS n_sources,
  string_agg(CASE WHEN rk <= {O.MAX_REFERRERS} THEN source_url || ' ' || link_text END, chr(10) ORDER BY rk) AS referrers
FROM ranked GROUP BY site, target_norm""")
def agg7_referrers(spark, d):
    """W1 + W2 + AGG7: first link per (target, source), at most 50 referrers
    per target in source order."""
    r = L.referrers_per_target(real_links(spark, d))
    return r.select("site", "target_norm", F.col("n_sources").cast("bigint").alias("n_sources"), F.array_join(
        F.transform("referring_pages", lambda x: F.concat(x["url"], F.lit(" "), x["link_text"])), "\n"
    ).alias("referrers"))


def _seo_sql(m: str) -> str:
    title = O.text_of(f"regexp_extract({m}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
    desc = f"coalesce({O.strip(O.attr(O.first_tag_where(m, 'meta', 'name', 'description'), 'content'))}, '')"
    canon_tag = (f"list_filter({O.tags(m, 'link')}, lambda t: list_contains(regexp_split_to_array("
                 f"{O.strip(O.attr('t', 'rel'))}, {lit(O.WS + '+')}), 'canonical'))[1]")
    og = ", ".join(
        f"CASE WHEN len(list_filter({O.tags(m, 'meta')}, lambda t: {O.attr('t', 'property')} = {lit(p)})) > 0 "
        f"THEN {lit(p)} END" for p in O.OG_PROPERTIES)
    return f"""{title} AS title, {desc} AS description,
  CAST(len(regexp_extract_all({m}, '(?i)<h1[\\s>/]', 0)) AS INTEGER) AS h1_count,
  coalesce({O.attr(canon_tag, 'href')}, '') AS canonical,
  coalesce({O.attr(O.tags(m, 'html') + '[1]', 'lang')}, '') AS lang,
  ({O.first_tag_where(m, 'meta', 'name', 'viewport')}) IS NOT NULL AS has_viewport,
  coalesce({O.attr(O.first_tag_where(m, 'meta', 'name', 'robots'), 'content')}, '') AS robots,
  concat_ws(',', {og}) AS og_tags"""


def _seo_cols(df: DataFrame) -> DataFrame:
    return df.select("*", "seo.*").drop("seo").withColumn("og_tags", F.array_join("og_tags", ","))


@query("html7_seo", f"SELECT page_id, url, {_seo_sql(O.clean('html'))} FROM pages")
def html7_seo(spark, d):
    """HTML7: SEO record of every stored page."""
    pages = _pages(spark, d).select("page_id", "url", H.clean(F.col("html")).alias("_markup"))
    return _seo_cols(pages.select("page_id", "url", H.seo(F.col("_markup")).alias("seo")))


@query("html6_forms", f"SELECT page_id, url, regexp_matches({O.clean('html')}, '(?i)<form[\\s>/]') AS has_form FROM pages")
def html6_forms(spark, d):
    """HTML6: form flag of every stored page."""
    return _pages(spark, d).select("page_id", "url", H.has_form(H.clean(F.col("html"))).alias("has_form"))


def fixture_pages(spark, d) -> DataFrame:
    """F2 fetch log with FLT1 status."""
    return P.with_status(FX.fetch_log(spark, d))


def _issues_sql() -> str:
    is_html = "contains(lower(content_type), 'html')"
    return f"""concat_ws(',',
    CASE WHEN http_status_code >= 400 THEN 'http_error' END,
    CASE WHEN {is_html} AND title = '' THEN 'no_title' END,
    CASE WHEN {is_html} AND length(title) > {O.TITLE_MAX_CHARS} THEN 'title_long' END,
    CASE WHEN {is_html} AND description = '' THEN 'no_description' END,
    CASE WHEN {is_html} AND length(description) > {O.DESCRIPTION_MAX_CHARS} THEN 'description_long' END,
    CASE WHEN {is_html} AND h1_count = 0 THEN 'no_h1' END,
    CASE WHEN {is_html} AND h1_count > 1 THEN 'multiple_h1' END,
    CASE WHEN {is_html} AND NOT has_viewport THEN 'no_viewport' END,
    CASE WHEN {is_html} AND lang = '' THEN 'no_lang' END,
    CASE WHEN {is_html} AND canonical = '' THEN 'no_canonical' END,
    CASE WHEN {is_html} AND contains(lower(robots), 'noindex') THEN 'noindex' END,
    CASE WHEN load_time_ms > {O.SLOW_MS} THEN 'slow' END,
    CASE WHEN page_size > {O.LARGE_BYTES} THEN 'large' END)"""


def _tech_sql() -> str:
    dm = O.decomment("html")
    gen = f"lower(coalesce({O.attr(O.first_tag_where(dm, 'meta', 'name', 'generator'), 'content')}, ''))"
    srcs = f"list_transform(list_filter({O.tags(dm, 'script')}, lambda t: {O.has_attr('t', 'src')}), lambda t: lower({O.attr('t', 'src')}))"
    hrefs = f"list_transform(list_filter({O.tags(dm, 'link')}, lambda t: {O.has_attr('t', 'href')}), lambda t: lower({O.attr('t', 'href')}))"
    hay = f"array_to_string(list_concat({srcs}, {hrefs}), ' ')"
    parts = []
    for needles, src in ((O.GENERATOR_MARKERS, gen), (O.URL_MARKERS, hay), (O.SERVER_MARKERS, "lower(h_server)"),
                         (O.POWERED_BY_MARKERS, "lower(h_powered)")):
        for needle, name in needles:
            parts.append(f"CASE WHEN contains({src}, {lit(needle)}) THEN {lit(name)} END")
    found = f"list_filter(list_value({', '.join(parts)}), lambda x: x IS NOT NULL)"
    return f"array_to_string(list_filter({found}, lambda x, i: list_position({found}, x) = i), ',')"


_GATE_SQL = (f"(NOT (redirect_url <> '' AND lower({O.part('redirect_url', 'netloc')}) <> site) "
             "AND contains(lower(content_type), 'text/html') AND NOT (http_status_code = 0 AND error_message <> ''))")
# the fetch log with the bodies of pages that are looked into
SQL_F2G = f"""
f2g AS (SELECT * REPLACE (CASE WHEN {_GATE_SQL} THEN html ELSE '' END AS html), {_GATE_SQL} AS looked FROM f2)"""


@query("html10_issues", with_(SQL_F2, SQL_F2G) + f"""
SELECT url, {_issues_sql()} AS issues FROM (SELECT *, {_seo_sql(O.clean('html'))} FROM f2g)""")
def html10_issues(spark, d):
    """HTML10 over the fixture fetch log (codes, load times, sizes, types)."""
    out = P.with_findings(FX.fetch_log(spark, d))
    return out.select("url", F.array_join("issues", ",").alias("issues"))


@query("html8_tech", with_(SQL_F2, SQL_F2G) + f"SELECT url, CASE WHEN looked THEN {_tech_sql()} ELSE '' END AS tech FROM f2g")
def html8_tech(spark, d):
    """HTML8: technologies from generator meta, script/link URLs and headers."""
    out = P.with_findings(FX.fetch_log(spark, d))
    return out.select("url", F.array_join("tech", ",").alias("tech"))


@query("html9_headers", with_(SQL_F2) + """
SELECT url, concat_ws(';', CASE WHEN h_server <> '' THEN 'server=' || h_server END,
  CASE WHEN h_powered <> '' THEN 'x-powered-by=' || h_powered END, CASE WHEN h_etag <> '' THEN 'etag=' || h_etag END,
  CASE WHEN h_xcache <> '' THEN 'x-cache=' || h_xcache END) AS headers FROM f2""")
def html9_headers(spark, d):
    """HTML9: the eight display headers (keys lower-cased, empty dropped)."""
    out = P.with_findings(FX.fetch_log(spark, d))
    return out.select("url", H.headers_text(F.col("http_details")).alias("headers"))


@query("agg12_issue_frequency", with_(SQL_F2, SQL_F2G) + f"""
SELECT site, issue, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT site, unnest(string_split({_issues_sql()}, ',')) AS issue
  FROM (SELECT *, {_seo_sql(O.clean('html'))} FROM f2g)) WHERE issue <> '' GROUP BY site, issue""")
def agg12_issue_frequency(spark, d):
    """AGG12: pages per (site, issue code)."""
    return ST.issue_frequency(P.with_findings(FX.fetch_log(spark, d)), "issues", "issue")


@query("agg12_tech_frequency", with_(SQL_F2, SQL_F2G) + f"""
SELECT site, technology, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT site, unnest(string_split({_tech_sql()}, ',')) AS technology FROM f2g WHERE looked) WHERE technology <> ''
GROUP BY site, technology""")
def agg12_tech_frequency(spark, d):
    """AGG12: pages per (site, technology)."""
    return ST.issue_frequency(P.with_findings(FX.fetch_log(spark, d)), "tech", "technology")


# ---------------------------------------------------------------------------
# Fixture site: status, counters, score
# ---------------------------------------------------------------------------

_ERRCLASS_SQL = "CASE WHEN error_message = '' THEN '' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(error_message), {lit(n)})" for n in needles) + f" THEN {lit(name)}"
    for needles, name in S.ERROR_CLASSES) + " ELSE 'other' END"


@query("flt1_page_status", with_(SQL_F2) + f"""
SELECT url, status,
  (status NOT IN ('redirect', 'redirect_external') AND (http_status_code >= 400 OR status IN ('error', 'timeout'))) AS is_error,
  (http_status_code >= 400 OR status IN ('error', 'timeout')) AS is_report_error,
  status IN ('ok', 'redirect', 'redirect_external') AS is_successful,
  status = 'redirect_external' AS is_external_redirect,
  (contains(lower(content_type), 'text/html') OR content_type = '') AS is_sitemap_html,
  {_ERRCLASS_SQL} AS error_class
FROM r2""")
def flt1_page_status(spark, d):
    """FLT1 + FLT3 + FLT4 + FLT5 + FLT6 + FLT17 per fetched page."""
    r = fixture_pages(spark, d)
    st, code = F.col("status"), F.col("http_status_code")
    return r.select("url", "status", "is_error", S.is_report_error(st, code).alias("is_report_error"),
                    S.is_successful(st).alias("is_successful"), S.is_external_redirect(st).alias("is_external_redirect"),
                    S.is_sitemap_html(F.col("content_type")).alias("is_sitemap_html"), "error_class")


@query("html5_extraction_gate", with_(SQL_F2) + f"""
SELECT url, NOT (redirect_url <> '' AND lower({O.part('redirect_url', 'netloc')}) <> site)
  AND contains(lower(content_type), 'text/html') AS extractable FROM f2""")
def html5_extraction_gate(spark, d):
    """HTML5: which fetched pages are searched for links."""
    f = FX.fetch_log(spark, d)
    return f.select("url", L.is_link_extractable(F.col("http_status_code"), F.col("content_type"),
                                                   F.col("redirect_url"), F.col("site")).alias("extractable"))


@query("agg1_run_counters", with_(SQL_F2, """
r2b AS (SELECT *, http_status_code = 0 AND error_message <> '' AS failed,
               status IN ('redirect', 'redirect_external') AS redirected, http_status_code // 100 AS cls FROM r2),
r2c AS (SELECT *, NOT failed AND NOT redirected AND status IN ('ok', 'error') AS responded FROM r2b)""") + """
SELECT site, CAST(count(*) AS BIGINT) AS total_discovered,
  CAST(count_if(status IN ('ok', 'redirect', 'redirect_external', 'error', 'timeout')) AS BIGINT) AS total_crawled,
  CAST(count_if(status = 'skipped') AS BIGINT) AS total_skipped,
  CAST(count_if(failed) + count_if(responded AND cls IN (4, 5)) AS BIGINT) AS total_errors,
  CAST(count_if(responded AND cls = 2) AS BIGINT) AS total_2xx,
  CAST(count_if(redirected) + count_if(responded AND cls = 3) AS BIGINT) AS total_3xx,
  CAST(count_if(responded AND cls = 4) AS BIGINT) AS total_4xx,
  CAST(count_if(responded AND cls = 5) AS BIGINT) AS total_5xx,
  CAST(coalesce(max(CASE WHEN status IN ('ok', 'redirect', 'redirect_external', 'error', 'timeout') AND NOT failed
                    THEN depth END), 0) AS INTEGER) AS max_depth_reached
FROM r2c GROUP BY site""")
def agg1_run_counters(spark, d):
    """AGG1: live crawl counters of the fixture crawl."""
    return ST.run_counters(fixture_pages(spark, d))


@query("agg2_report_counters", with_(SQL_F2) + """
SELECT site, CAST(count(*) AS BIGINT) AS total_discovered,
  CAST(count_if(status NOT IN ('pending', 'max_depth', 'skipped')) AS BIGINT) AS total_crawled,
  CAST(count_if(http_status_code <> 0 AND http_status_code // 100 = 2) AS BIGINT) AS total_2xx,
  CAST(count_if(http_status_code <> 0 AND http_status_code // 100 = 3) AS BIGINT) AS total_3xx,
  CAST(count_if(http_status_code <> 0 AND http_status_code // 100 = 4) AS BIGINT) AS total_4xx,
  CAST(count_if(http_status_code <> 0 AND http_status_code // 100 = 5) AS BIGINT) AS total_5xx,
  CAST(count_if(http_status_code <> 0 AND http_status_code // 100 IN (4, 5))
       + count_if(status IN ('error', 'timeout') AND http_status_code < 400) AS BIGINT) AS total_errors
FROM r2 GROUP BY site""")
def agg2_report_counters(spark, d):
    """AGG2: counters rebuilt from the finished rows."""
    return ST.report_counters(fixture_pages(spark, d))


def _grade_sql(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= {b} THEN '{g}'" for b, g in ST.GRADES) + " ELSE 'F' END"


@query("agg3_site_score", with_(SQL_F2, SQL_F3, """
lf AS (SELECT source_url AS url, count(*) AS links_found FROM f3 GROUP BY source_url),
sc AS (SELECT r2.site,
    CAST(count_if(status IN ('ok','redirect','redirect_external','error','timeout')) AS BIGINT) AS total_pages,
    CAST(count_if(status IN ('ok','redirect','redirect_external','error','timeout') AND NOT (status NOT IN ('redirect','redirect_external')
         AND (http_status_code >= 400 OR status IN ('error','timeout')))) AS BIGINT) AS clean_pages,
    CAST(coalesce(sum(CASE WHEN status IN ('ok','redirect','redirect_external','error','timeout')
         THEN coalesce(lf.links_found, 0) END), 0) AS BIGINT) AS total_links
  FROM r2 LEFT JOIN lf USING (url) GROUP BY r2.site),
sc2 AS (SELECT *, CAST(CASE WHEN total_pages > 0 THEN round_even(100.0 * clean_pages / total_pages, 0) ELSE 0 END
        AS INTEGER) AS score FROM sc)""") + f"""
SELECT site, score, total_pages, clean_pages, total_pages - clean_pages AS pages_with_errors, total_links,
  {_grade_sql('score')} AS grade FROM sc2""")
def agg3_site_score(spark, d):
    """AGG3 + AGG4 (+ AGG6 for links_found, J1-style join of counts)."""
    r = fixture_pages(spark, d)
    lf = L.links_per_page(r, FX.edges(spark, d))
    return ST.site_score(r.join(lf, ["site", "url"]))


# ---------------------------------------------------------------------------
# Fixture site: sitemap
# ---------------------------------------------------------------------------

SQL_SET3 = f"""
direct AS (SELECT site, url, last_modified, depth, false AS is_resolved FROM r2
           WHERE http_status_code = 200 AND (contains(lower(content_type), 'text/html') OR content_type = '')),
dnorm AS (SELECT DISTINCT site, {O.normalize('url')} AS norm FROM direct),
redir AS (SELECT site, trim(redirect_url) AS target, depth, url AS src FROM r2
          WHERE status IN ('redirect', 'redirect_external') AND trim(redirect_url) <> ''),
rcand AS (SELECT *, {O.normalize('target')} AS norm FROM redir
          WHERE site = '' OR ({O.host('site')} <> '' AND {O.host('site')} = {O.host(O.part('target', 'netloc'))})),
rfirst AS (SELECT site, norm, arg_min(target, (depth, src)) AS url, arg_min(depth, (depth, src)) AS depth
           FROM rcand WHERE NOT EXISTS (SELECT 1 FROM dnorm WHERE dnorm.site = rcand.site AND dnorm.norm = rcand.norm)
           GROUP BY site, norm),
rows3 AS (SELECT site, url, last_modified, depth, is_resolved FROM direct
          UNION ALL SELECT site, url, '' AS last_modified, depth, true AS is_resolved FROM rfirst),
rows AS (SELECT *, printf('%.1f', round_even(greatest(0.1, 1.0 - 0.2 * depth), 1)) AS priority FROM rows3)"""


def fixture_sitemap_rows(spark, d) -> DataFrame:
    return SM.sitemap_rows(fixture_pages(spark, d))


@query("set3_sitemap_rows", with_(SQL_F2, SQL_SET3) + "SELECT site, url, last_modified, depth, is_resolved, priority FROM rows")
def set3_sitemap_rows(spark, d):
    """SET3 + J4 + J5 + W5 + G5: rows of the generated sitemap."""
    return fixture_sitemap_rows(spark, d)


@query("agg5_sitemap_plan", with_(SQL_F2, SQL_SET3) + """
SELECT site, CAST(count(*) AS BIGINT) AS total_urls, CAST(count_if(is_resolved) AS BIGINT) AS resolved_targets
FROM rows GROUP BY site""")
def agg5_sitemap_plan(spark, d):
    """AGG5: (total URLs, resolved redirect targets)."""
    return SM.sitemap_plan(fixture_sitemap_rows(spark, d))


@query("set1_not_in_sitemap", with_(SQL_F2, SQL_F4) + """
SELECT DISTINCT site, url FROM r2 WHERE http_status_code = 200 EXCEPT SELECT site, url FROM f4""")
def set1_not_in_sitemap(spark, d):
    """SET1: crawled 200 URLs missing from the published sitemap."""
    return SM.not_in_sitemap(fixture_pages(spark, d), FX.sitemap_urls(spark, d))


@query("set2_not_crawled", with_(SQL_F2, SQL_F4) + """
SELECT DISTINCT site, url FROM f4 EXCEPT SELECT site, url FROM r2 WHERE http_status_code = 200""")
def set2_not_crawled(spark, d):
    """SET2: published sitemap URLs not crawled with code 200."""
    return SM.not_crawled(fixture_pages(spark, d), FX.sitemap_urls(spark, d))


@query("snk7_sitemap_diff", with_(SQL_F2, SQL_F4, """
dl AS (SELECT site, 'not_in_sitemap' AS section, url FROM
        (SELECT DISTINCT site, url FROM r2 WHERE http_status_code = 200 EXCEPT SELECT site, url FROM f4)
       UNION ALL
       SELECT site, 'not_crawled', url FROM
        (SELECT DISTINCT site, url FROM f4 EXCEPT SELECT site, url FROM r2 WHERE http_status_code = 200))""") + """
SELECT site, section, url, CAST(count(*) OVER (PARTITION BY site, section) AS BIGINT) AS section_count FROM dl""")
def snk7_sitemap_diff(spark, d):
    """SNK7 + AGG10: the sitemap diff as (site, section, url, section_count)."""
    return SM.sitemap_diff(fixture_pages(spark, d), FX.sitemap_urls(spark, d))


@query("j3_sitemap_flag", with_(SQL_F2, SQL_F4) + """
SELECT url, http_status_code = 200 AND EXISTS (SELECT 1 FROM f4 WHERE f4.site = r2.site)
  AND NOT EXISTS (SELECT 1 FROM f4 WHERE f4.site = r2.site AND f4.url = r2.url) AS missing_from_sitemap FROM r2""")
def j3_sitemap_flag(spark, d):
    """200 pages missing from a non-empty published sitemap."""
    return SM.sitemap_flag(fixture_pages(spark, d), FX.sitemap_urls(spark, d)).select("url", "missing_from_sitemap")


@query("agg10_distinct_counts", with_(SQL_F2, SQL_F4) + """
SELECT s.site, s.sitemap_urls, c.crawled_200_urls FROM
  (SELECT site, CAST(count(DISTINCT url) AS BIGINT) AS sitemap_urls FROM f4 GROUP BY site) s JOIN
  (SELECT site, CAST(count(DISTINCT url) AS BIGINT) AS crawled_200_urls FROM r2 WHERE http_status_code = 200 GROUP BY site) c
  USING (site)""")
def agg10_distinct_counts(spark, d):
    """AGG10: distinct sitemap URLs and distinct crawled 200 URLs per site."""
    sm = FX.sitemap_urls(spark, d).groupBy("site").agg(F.count_distinct("url").cast("bigint").alias("sitemap_urls"))
    cr = fixture_pages(spark, d).where(F.col("http_status_code") == 200).groupBy("site").agg(
        F.count_distinct("url").cast("bigint").alias("crawled_200_urls"))
    return sm.join(cr, "site")


# ---------------------------------------------------------------------------
# robots.txt
# ---------------------------------------------------------------------------

@query("src5_robots_rules", with_(SQL_ROBOTS) + "SELECT site, CAST(line_no AS INTEGER) AS line_no, pattern, allow, regex, length FROM rules")
def src5_robots_rules(spark, d):
    """SRC5: rules of the ``*`` block of every robots file."""
    return R.robots_rules(FX.robots_files(spark, d)).select("site", F.col("line_no").cast("int").alias("line_no"),
                                                             "pattern", "allow", "regex", "length")


@query("src6_robots_sitemaps", with_(SQL_ROBOTS) + """
SELECT site, CAST(line_no AS INTEGER) AS line_no, value AS sitemap_url FROM rl3
WHERE starts_with(lower(line), 'sitemap:') AND value <> ''""")
def src6_robots_sitemaps(spark, d):
    """SRC6: Sitemap lines of every robots file, in file order."""
    return R.robots_sitemaps(FX.robots_files(spark, d)).withColumn("line_no", F.col("line_no").cast("int"))


SQL_J2_URLS = f"""
j2u AS (SELECT site, url FROM r2 UNION ALL SELECT {_HOST} AS site, url FROM pages)"""


@query("j2_robots_allowed", with_(SQL_F2, SQL_ROBOTS, SQL_J2_URLS, allowed_sql("j2u")) + "SELECT site, url, allowed FROM al")
def j2_robots_allowed(spark, d):
    """Robots permission of every fixture URL and every stored page."""
    urls = fixture_pages(spark, d).select("site", "url").unionByName(
        _pages(spark, d).select(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)).alias("site"), "url"))
    rules = R.robots_rules(FX.robots_files(spark, d))
    return R.allowed(urls.distinct(), rules).select("site", "url", "allowed")


def many_rules(spark, d) -> DataFrame:
    """Rules for one site with a robots file of three lines a page: its directory, a wildcard and an anchored pattern."""
    i = F.col("page_id").cast("string")
    lines = F.array(
        F.struct(F.concat(F.lit("/d"), i, F.lit("/")).alias("pattern"), F.lit(False).alias("allow")),
        F.struct(F.concat(F.lit("/d"), i, F.lit("/*/open")).alias("pattern"), F.lit(True).alias("allow")),
        F.struct(F.concat(F.lit("/d"), i, F.lit("/x$")).alias("pattern"), F.lit(True).alias("allow")))
    rules = _pages(spark, d).select(F.lit(FX.SITE).alias("site"), F.explode(lines).alias("r")).select("site", "r.*")
    return rules.select("site", "pattern", "allow", R.pattern_regex(F.col("pattern")).alias("regex"), F.char_length("pattern").cast("int").alias("length"))


@query("j2_many_rules", f"""
SELECT {lit(FX.SITE)} AS site, 'https://{FX.SITE}' || path AS url, page_id % 5 NOT IN (0, 2) AS allowed FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/d' || page_id || '/' WHEN 1 THEN '/d' || page_id || '/a/open?q=1'
    WHEN 2 THEN '/d' || page_id || '/xy' WHEN 3 THEN '/d' || page_id || '/x' ELSE '/d' || page_id END AS path FROM pages)""")
def j2_many_rules(spark, d):
    """J2 for one site with three rules a page: a URL meets the rules that begin like it only."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    tail = F.when(k == 0, "/").when(k == 1, "/a/open?q=1").when(k == 2, "/xy").when(k == 3, "/x").otherwise("")
    urls = _pages(spark, d).select(F.lit(FX.SITE).alias("site"), F.concat(F.lit(f"https://{FX.SITE}/d"), i, tail).alias("url"))
    return R.allowed(urls, many_rules(spark, d)).select("site", "url", "allowed")


# ---------------------------------------------------------------------------
# G1: breadth-first crawl over the stored fetch log and links
# ---------------------------------------------------------------------------

G1_MAX_DEPTH = 10

SQL_G1 = f"""
gu AS (SELECT site, url FROM r2),
{allowed_sql('gu').strip()},
node AS (SELECT r2.*, al.allowed,
           al.allowed AND status IN ('ok', 'redirect', 'error') AND NOT (http_status_code = 0 AND error_message <> '')
           AND NOT (redirect_url <> '' AND lower({O.part('redirect_url', 'netloc')}) <> r2.site)
           AND contains(lower(content_type), 'text/html') AS expand
         FROM r2 JOIN al USING (site, url)),
walk(url, depth) AS (
  SELECT '{FX.BASE}/p/0', 0
  UNION
  SELECT f3.target_url, walk.depth + 1 FROM walk JOIN node ON node.url = walk.url JOIN f3 ON f3.source_url = walk.url
  WHERE node.expand AND walk.depth < {G1_MAX_DEPTH} + 1),
md AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url),
par AS (SELECT f3.target_url AS url, min(f3.source_url) AS parent_url
        FROM md t JOIN f3 ON f3.target_url = t.url JOIN md s ON s.url = f3.source_url AND s.depth = t.depth - 1
        JOIN node ON node.url = s.url WHERE node.expand AND s.depth <= {G1_MAX_DEPTH} GROUP BY f3.target_url),
lf AS (SELECT source_url AS url, count(*) AS n FROM f3 GROUP BY source_url),
g1 AS (
  SELECT node.site, md.url,
    CASE WHEN md.depth > {G1_MAX_DEPTH} THEN 'max_depth' WHEN NOT node.allowed THEN 'skipped' ELSE node.status END AS status,
    CASE WHEN md.depth > {G1_MAX_DEPTH} OR NOT node.allowed THEN 0 ELSE node.http_status_code END AS http_status_code,
    CAST(md.depth AS INTEGER) AS depth, coalesce(par.parent_url, '') AS parent_url,
    CAST(CASE WHEN md.depth <= {G1_MAX_DEPTH} AND node.expand THEN coalesce(lf.n, 0) ELSE 0 END AS BIGINT) AS links_found
  FROM md JOIN node ON node.url = md.url LEFT JOIN par ON par.url = md.url LEFT JOIN lf ON lf.url = md.url)"""


def fixture_sites(spark, d) -> DataFrame:
    return FX.fetch_log(spark, d).where(F.col("page_id") == 0).select("site", "site_scheme", F.col("url").alias("start_url"))


def g1_crawl(spark, d):
    rules = R.robots_rules(FX.robots_files(spark, d))
    return C.bfs_crawl(fixture_sites(spark, d), FX.fetch_log(spark, d), FX.edges(spark, d), rules=rules,
                       max_depth=G1_MAX_DEPTH)


@query("g1_bfs_crawl", "WITH RECURSIVE " + with_(SQL_F2, SQL_F3, SQL_ROBOTS, SQL_G1)[5:] +
       "SELECT site, url, status, http_status_code, depth, parent_url, links_found FROM g1")
def g1_bfs_crawl(spark, d):
    """G1 + W4 + J2 + FLT1 + HTML5: BFS from the start page with robots, max depth 10."""
    out = g1_crawl(spark, d)
    return out.results.select("site", "url", "status", "http_status_code", "depth", "parent_url", "links_found")


@query("g4_depth_distribution", "WITH RECURSIVE " + with_(SQL_F2, SQL_F3, SQL_ROBOTS, SQL_G1)[5:] +
       "SELECT site, depth, CAST(count(*) AS BIGINT) AS pages FROM g1 GROUP BY site, depth")
def g4_depth_distribution(spark, d):
    """Pages per BFS depth."""
    return ST.depth_distribution(g1_crawl(spark, d).results)
