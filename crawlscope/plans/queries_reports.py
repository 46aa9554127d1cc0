"""Registered queries: referrers, dead-link reports, source positions, page tree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import urls as U
from ..operators import links as L
from ..operators import ordering as OR
from ..operators import tree as T
from ..session import ensure_checkpoint_dir
from ..sinks import reports as RP
from ..sources import fixtures as FX
from . import oracle as O
from .catalog import (
    N, SQL_F2, SQL_F3, SQL_PAGES_AS_FETCHES, _pages, fixture_pages, fixture_sites, links_sql, lit, query, real_links,
    with_,
)

# ---------------------------------------------------------------------------
# Referrers of fixture pages (source order = BFS depth, then URL)
# ---------------------------------------------------------------------------

SQL_REFS = f"""
rf1 AS (SELECT f3.site, f3.target_url AS target_norm, f3.source_url, arg_min(f3.link_text, f3.position) AS link_text
        FROM f3 GROUP BY f3.site, f3.target_url, f3.source_url),
rf2 AS (SELECT rf1.*, f2.depth AS source_depth FROM rf1 JOIN f2 ON f2.url = rf1.source_url),
rf3 AS (SELECT *, row_number() OVER (PARTITION BY site, target_norm ORDER BY source_depth, source_url) AS rk FROM rf2),
refs AS (SELECT * FROM rf3 WHERE rk <= {O.MAX_REFERRERS})"""


def fixture_referrers(spark, d) -> DataFrame:
    rank = FX.fetch_log(spark, d).select("site", F.col("url").alias("source_url"), F.col("depth").alias("source_depth"))
    return L.referrers_per_target(FX.edges(spark, d), source_rank=rank)


def fixture_pages_with_referrers(spark, d) -> DataFrame:
    return L.attach_referrers(fixture_pages(spark, d), fixture_referrers(spark, d))


def fixture_dead_links(spark, d) -> DataFrame:
    """Dead pages with their referrers: only links to dead pages are gathered."""
    dead = RP.dead_links(fixture_pages(spark, d))
    rank = FX.fetch_log(spark, d).select("site", F.col("url").alias("source_url"), F.col("depth").alias("source_depth"))
    links = L.links_to(FX.edges(spark, d), dead)
    return L.attach_referrers(dead, L.referrers_per_target(links, source_rank=rank))


def _refs_text() -> F.Column:
    return F.array_join(F.transform("referring_pages", lambda r: F.concat(r["url"], F.lit(" "), r["link_text"])), "\n")


@query("j1_page_referrers", with_(SQL_F2, SQL_F3, SQL_REFS) + """
SELECT r2.url, CAST(count(refs.source_url) AS BIGINT) AS n_referrers,
  coalesce(string_agg(refs.source_url || ' ' || refs.link_text, chr(10) ORDER BY refs.rk), '') AS referrers
FROM r2 LEFT JOIN refs ON refs.site = r2.site AND refs.target_norm = r2.url GROUP BY r2.url""")
def j1_page_referrers(spark, d):
    """J1 + W1 + W2: referrer list (at most 50, by source depth and URL) of
    every fixture page."""
    out = fixture_pages_with_referrers(spark, d)
    return out.select("url", F.size("referring_pages").cast("bigint").alias("n_referrers"),
                      _refs_text().alias("referrers"))


SQL_DEAD = """
dead AS (SELECT * FROM r2 WHERE http_status_code >= 400 OR status IN ('error', 'timeout'))"""


@query("j10_dead_links", with_(SQL_F2, SQL_F3, SQL_REFS, SQL_DEAD) + """
SELECT dead.url, dead.http_status_code, dead.status, dead.error_message,
  CAST(count(refs.source_url) AS BIGINT) AS n_referrers,
  coalesce(string_agg(refs.source_url || ' ' || refs.link_text, chr(10) ORDER BY refs.rk), '') AS referrers
FROM dead LEFT JOIN refs ON refs.site = dead.site AND refs.target_norm = dead.url
GROUP BY dead.url, dead.http_status_code, dead.status, dead.error_message""")
def j10_dead_links(spark, d):
    """FLT4 + J10: dead links with their referrers."""
    dead = fixture_dead_links(spark, d)
    return dead.select("url", "http_status_code", "status", "error_message",
                       F.size("referring_pages").cast("bigint").alias("n_referrers"), _refs_text().alias("referrers"))


def _md(e: str) -> str:
    return f"replace(replace(replace({e}, '|', '\\|'), chr(13), ''), chr(10), '<br>')"


@query("snk5_markdown_table", with_(SQL_F2, SQL_F3, SQL_REFS, SQL_DEAD) + f"""
, agg AS (
  SELECT dead.site, dead.url, dead.http_status_code, dead.status,
    string_agg(CASE WHEN {O.strip('refs.link_text')} <> '' THEN '[' || {_md(O.strip('refs.link_text'))} || '](' || refs.source_url || ')'
               ELSE {_md('refs.source_url')} END, '<br>' ORDER BY refs.rk) AS referring
  FROM dead LEFT JOIN refs ON refs.site = dead.site AND refs.target_norm = dead.url
  GROUP BY dead.site, dead.url, dead.http_status_code, dead.status)
SELECT site, url, '| ' || {_md('url')} || ' | ' || CASE WHEN http_status_code <> 0 THEN CAST(http_status_code AS VARCHAR) ELSE '-' END
  || ' | ' || status || ' | ' || coalesce(referring, '-') || ' |' AS line FROM agg""")
def snk5_markdown_table(spark, d):
    """SNK5: Markdown tracker-table rows of all dead links."""
    return RP.markdown_rows(fixture_dead_links(spark, d))


@query("snk6_wiki_table", with_(SQL_F2, SQL_F3, SQL_REFS, SQL_DEAD) + f"""
, agg AS (
  SELECT dead.site, dead.url, dead.http_status_code, dead.status,
    string_agg(CASE WHEN {O.strip('refs.link_text')} <> '' THEN '"' || {O.strip('refs.link_text')} || '" [' || refs.source_url || ']'
               ELSE '[' || refs.source_url || ']' END, ' \\\\ ' ORDER BY refs.rk) AS referring
  FROM dead LEFT JOIN refs ON refs.site = dead.site AND refs.target_norm = dead.url
  GROUP BY dead.site, dead.url, dead.http_status_code, dead.status)
SELECT site, url, '|[' || url || ']|' || CASE WHEN http_status_code <> 0 THEN CAST(http_status_code AS VARCHAR) ELSE '-' END
  || '|' || status || '|' || coalesce(referring, '-') || '|' AS line FROM agg""")
def snk6_wiki_table(spark, d):
    """SNK6: wiki-markup tracker-table rows of all dead links."""
    return RP.wiki_rows(fixture_dead_links(spark, d))


GENERATED_AT = "2026-06-01T12:00:00"


def fixture_runs(spark, d) -> DataFrame:
    """(site, start_url, duration): the run lasts as long as its fetches one after another."""
    from ..operators import stats as ST
    began = F.to_timestamp(F.lit("2026-06-01 10:00:00"))
    took = fixture_pages(spark, d).groupBy("site").agg(F.sum("load_time_ms").cast("bigint").alias("ms"))
    spans = took.select("site", began.alias("started_at"), F.timestamp_micros(F.unix_micros(began) + F.col("ms") * 1000).alias("ended_at"))
    return ST.run_duration(spans).join(fixture_sites(spark, d), "site").select("site", "start_url", F.col("duration_display").alias("duration"))


SQL_REPORT = f"""
cnt AS (SELECT site, count(*) AS total_discovered, count_if(status NOT IN ('pending', 'max_depth', 'skipped')) AS total_crawled,
  count_if(http_status_code // 100 = 2) AS total_2xx, count_if(http_status_code // 100 = 3) AS total_3xx,
  count_if(http_status_code // 100 = 4) AS total_4xx, count_if(http_status_code // 100 = 5) AS total_5xx,
  count_if(http_status_code // 100 IN (4, 5)) + count_if(status IN ('error', 'timeout') AND http_status_code < 400) AS total_errors,
  sum(load_time_ms) / 1000 AS secs FROM r2 GROUP BY site),
head AS (SELECT *, '{FX.BASE}/p/0' AS start_url, CASE WHEN secs < 60 THEN CAST(CAST(round_even(secs, 0) AS BIGINT) AS VARCHAR) || 's'
  WHEN secs < 3600 THEN CAST(CAST(floor(secs / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(secs % 60) AS BIGINT) AS VARCHAR) || 's'
  ELSE CAST(CAST(floor(secs / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor(secs / 60) AS BIGINT) % 60 AS VARCHAR) || 'm' END AS duration FROM cnt)"""


@query("snk3_error_report", with_(SQL_F2, SQL_F3, SQL_REFS, SQL_DEAD, SQL_REPORT) + f"""
SELECT site, 'header' AS kind, to_json({{'generated_at': '{GENERATED_AT}', 'start_url': start_url, 'summary': {{
  'total_crawled': total_crawled, 'total_discovered': total_discovered, 'total_errors': total_errors, 'total_2xx': total_2xx,
  'total_3xx': total_3xx, 'total_4xx': total_4xx, 'total_5xx': total_5xx, 'duration': duration}}}})::VARCHAR AS json FROM head
UNION ALL
SELECT dead.site, 'dead_link', to_json({{'url': dead.url, 'http_status': dead.http_status_code, 'status': dead.status,
  'error_message': dead.error_message,
  'referring_pages': coalesce(list({{'url': refs.source_url, 'link_text': refs.link_text}} ORDER BY refs.rk)
                              FILTER (WHERE refs.source_url IS NOT NULL), [])}})::VARCHAR
FROM dead LEFT JOIN refs ON refs.site = dead.site AND refs.target_norm = dead.url
GROUP BY dead.site, dead.url, dead.http_status_code, dead.status, dead.error_message""")
def snk3_error_report(spark, d):
    """SNK3 + AGG2 + AGG9: the error report's header object per site and one object per dead link."""
    from ..operators import stats as ST
    head = RP.error_report_header(ST.report_counters(fixture_pages(spark, d)), fixture_runs(spark, d), GENERATED_AT)
    dead = RP.error_report_entries(fixture_dead_links(spark, d))
    return head.select("site", F.lit("header").alias("kind"), "json").unionByName(dead.select("site", F.lit("dead_link").alias("kind"), "json"))


REPORT_SCHEMA = ("generated_at string, start_url string, summary struct<total_crawled:bigint,total_discovered:bigint,total_errors:bigint,"
                 "total_2xx:bigint,total_3xx:bigint,total_4xx:bigint,total_5xx:bigint,duration:string>, "
                 f"dead_links array<struct<url:string,http_status:int,status:string,error_message:string,referring_pages:{RP.REFERRER_TYPE}>>")


@query("snk3_report_file", with_(SQL_F2, SQL_F3, SQL_REFS, SQL_DEAD, SQL_REPORT) + f"""
, n AS (SELECT site, target_norm, count(*) AS n FROM refs GROUP BY ALL)
SELECT head.site, '{GENERATED_AT}' AS generated_at, start_url, duration, CAST(total_crawled AS BIGINT) AS total_crawled, CAST(total_errors AS BIGINT) AS total_errors,
  CAST(row_number() OVER (PARTITION BY head.site ORDER BY dead.url) - 1 AS INTEGER) AS pos, dead.url, dead.http_status_code AS http_status, dead.status,
  CAST(coalesce(n.n, 0) AS INTEGER) AS n_referrers
FROM head JOIN dead ON dead.site = head.site LEFT JOIN n ON n.site = dead.site AND n.target_norm = dead.url""")
def snk3_report_file(spark, d):
    """SNK3: the report of each site written as one JSON file in the shared folder and read back."""
    from ..operators import stats as ST
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    RP.write_error_report(fixture_dead_links(spark, d), ST.report_counters(fixture_pages(spark, d)), fixture_runs(spark, d), GENERATED_AT, path)
    found = RP.read_documents(spark, path, "error_report.json", REPORT_SCHEMA).select("site", "document.*")
    return found.select("site", "generated_at", "start_url", "summary.duration", "summary.total_crawled", "summary.total_errors", F.posexplode("dead_links").alias("pos", "e")).select(
        "*", "e.url", "e.http_status", "e.status", F.size("e.referring_pages").alias("n_referrers")).drop("e")


@query("snk4_forms_report", with_(SQL_F2) + """
SELECT site, url, CAST(row_number() OVER (PARTITION BY site ORDER BY url) AS BIGINT) AS pos FROM r2
WHERE has_form AND http_status_code = 200""")
def snk4_forms_report(spark, d):
    """SNK4 + SRT3: pages with a form and code 200, sorted by URL."""
    rows = RP.forms_rows(fixture_pages(spark, d))
    return OR.sequence_within_groups(rows, ["site"], ["url"], out_col="pos")


@query("snk4_forms_file", with_(SQL_F2) + """
SELECT site, url, CAST(row_number() OVER (PARTITION BY site ORDER BY url) - 1 AS INTEGER) AS pos FROM r2
WHERE has_form AND http_status_code = 200""")
def snk4_forms_file(spark, d):
    """SNK4: the forms list of each site written as one JSON file in the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forms-{uuid.uuid4().hex}"
    RP.write_forms_report(fixture_pages(spark, d), path)
    found = RP.read_documents(spark, path, "forms.json", "urls array<string>")
    return found.select("site", F.posexplode("document.urls").alias("pos", "url"))


@query("flt16_source_lookup", with_(SQL_F2, SQL_F3) + """
SELECT url FROM r2 WHERE http_status_code >= 400 AND EXISTS (SELECT 1 FROM f3 WHERE f3.target_url = r2.url)""")
def flt16_source_lookup(spark, d):
    """FLT16: error pages that have referrers (semi join on the links)."""
    r = fixture_pages(spark, d).where(F.col("http_status_code") >= 400)
    targets = FX.edges(spark, d).select("site", F.col("target_norm").alias("url"))
    return r.join(targets, ["site", "url"], "left_semi").select("url")


# ---------------------------------------------------------------------------
# J11 / SNK12: position of every link in its source HTML
# ---------------------------------------------------------------------------

def _locate_sql() -> str:
    path = O.part("target_url", "path")
    spath = O.part("source_url", "path")
    sdir = f"(CASE WHEN ends_with({spath}, '/') THEN {spath} ELSE {spath} || '/' END)"
    rel = (f"(CASE WHEN {O.part('source_url', 'netloc')} = {O.part('target_url', 'netloc')} AND starts_with({path}, {sdir}) "
           f"AND {path} <> {sdir} THEN substr({path}, length({sdir}) + 1) ELSE '' END)")
    has_path = f"({path} <> '' AND {path} <> '/')"
    last = f"regexp_extract(regexp_replace({path}, '/+$', ''), '([^/]*)$', 1)"
    text = O.strip("coalesce(link_text, '')")
    cands = f"""[target_url,
      CASE WHEN contains(target_url, '#') THEN split_part(target_url, '#', 1) END,
      CASE WHEN contains(target_url, '?') THEN split_part(target_url, '?', 1) END,
      CASE WHEN {has_path} THEN {path} END,
      CASE WHEN {rel} <> '' THEN '"' || {rel} || '"' END,
      CASE WHEN {rel} <> '' THEN '''' || {rel} || '''' END,
      CASE WHEN {rel} <> '' THEN {rel} END,
      CASE WHEN {has_path} AND length({last}) >= 3 THEN '"' || {last} || '"' END,
      CASE WHEN {has_path} AND length({last}) >= 3 THEN '''' || {last} || '''' END,
      CASE WHEN url_decode(target_url) <> target_url THEN url_decode(target_url) END,
      CASE WHEN length({text}) >= 2 THEN '>' || {text} || '<' END]"""
    return f"list_filter({cands}, lambda c: c IS NOT NULL AND c <> '' AND instr(src_html, c) > 0)[1]"


SQL_J11 = f"""
, jl AS (SELECT lk.source_url, lk.position, lk.target_url, lk.link_text, pages.html AS src_html
         FROM lk JOIN pages ON pages.url = lk.source_url),
jh AS (SELECT *, {_locate_sql()} AS hit FROM jl),
ji AS (SELECT *, instr(src_html, hit) AS idx FROM jh),
jp AS (SELECT *, substr(src_html, 1, idx - 1) AS prefix FROM ji),
j11 AS (SELECT source_url, position, target_url, src_html,
          CAST(CASE WHEN hit IS NULL THEN 0 ELSE len(string_split(prefix, chr(10))) END AS INTEGER) AS line,
          CAST(CASE WHEN hit IS NULL THEN 0 ELSE idx - (length(prefix) - length(regexp_extract(prefix, '([^\\n]*)$', 1))) END
               AS INTEGER) AS "column",
          CAST(CASE WHEN hit IS NULL THEN 0 ELSE length(hit) END AS INTEGER) AS match_length
        FROM jp)"""


def located_links(spark, d, context: int = 0, dead: bool = False) -> DataFrame:
    """Places of all links of the stored pages, or of those to pages of their site that aren't stored."""
    links = real_links(spark, d)
    if dead:
        known = _pages(spark, d).select(U.normalize(F.col("url")).alias("target_norm")).distinct()
        links = links.join(known, "target_norm", "left_anti")
    links = links.select("source_url", "position", "target_url", "link_text")
    return L.locate_in_source(links, _pages(spark, d), context=context)


SQL_DEAD = f"""
, stored AS (SELECT DISTINCT {O.normalize('url')} AS target_norm FROM pages),
lkd AS (SELECT * FROM lk ANTI JOIN stored USING (target_norm))"""
SQL_J11_DEAD = SQL_DEAD + SQL_J11.replace("FROM lk JOIN", "FROM lkd lk JOIN")


@query("j11_source_position", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + SQL_J11 +
       ' SELECT source_url, position, target_url, line, "column", match_length FROM j11')
def j11_source_position(spark, d):
    """1-based line, column and match length of every link in its source page."""
    return located_links(spark, d).select("source_url", "position", "target_url", "line", "column", "match_length")


SNIPPET_SQL = """
, js AS (SELECT *, string_split(src_html, chr(10)) AS lines FROM j11)
SELECT source_url, position,
  'Source: ' || source_url || chr(10) || 'Broken link: ' || target_url || chr(10) ||
  CASE WHEN line > 0 AND line <= len(lines) THEN
    'Line ' || CAST(line AS VARCHAR) || ':' || chr(10) || chr(10) ||
    array_to_string(list_transform(range(greatest(line - 3, 1), greatest(least(line + 3, len(lines)), greatest(line - 3, 1)) + 1),
      lambda i: CASE WHEN i = line THEN '>> ' ELSE '   ' END || lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || lines[i]), chr(10))
    || chr(10)
  ELSE '(link not found in the HTML)' || chr(10) END AS snippet
FROM js"""


@query("snk12_source_snippet", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + SQL_J11 + SNIPPET_SQL)
def snk12_source_snippet(spark, d):
    """SNK12: source snippet (hit line +-3, marker, line numbers) per link."""
    return snippets(located_links(spark, d, context=3))


def snippets(located: DataFrame) -> DataFrame:
    text = RP.snippet(F.col("lines"), F.col("first_line"), F.col("line"), F.col("source_url"), F.col("target_url"))
    return located.select("source_url", "position", text.alias("snippet"))


@query("j11_dead_positions", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + SQL_J11_DEAD +
       ' SELECT source_url, position, target_url, line, "column", match_length FROM j11')
def j11_dead_positions(spark, d):
    """J11 for dead links only: the links to pages of the site that aren't stored."""
    return located_links(spark, d, dead=True).select("source_url", "position", "target_url", "line", "column", "match_length")


@query("snk12_dead_snippets", with_(SQL_PAGES_AS_FETCHES, links_sql("pf")) + SQL_J11_DEAD + SNIPPET_SQL)
def snk12_dead_snippets(spark, d):
    """SNK12 for dead links only."""
    return snippets(located_links(spark, d, context=3, dead=True))


# ---------------------------------------------------------------------------
# Page tree (fixture crawl: depth and parent per page)
# ---------------------------------------------------------------------------

SQL_DUP = f"""
dupc AS (SELECT site, url, split_part(redirect_url, '#', 1) AS target FROM r2 WHERE status = 'redirect'),
known AS (SELECT DISTINCT site, {O.normalize('url')} AS canon FROM r2),
dup AS (SELECT DISTINCT dupc.site, dupc.url FROM dupc JOIN known ON known.site = dupc.site
        AND known.canon = {O.normalize('dupc.target')} WHERE dupc.target <> '' AND dupc.target <> dupc.url),
r2d AS (SELECT r2.*, dup.url IS NOT NULL AS dup_redirect FROM r2 LEFT JOIN dup USING (site, url))"""


@query("j6_known_redirects", with_(SQL_F2, SQL_DUP) + "SELECT url, dup_redirect FROM r2d")
def j6_known_redirects(spark, d):
    """Internal redirects to a URL that is already a result row."""
    return T.redirect_to_known(fixture_pages(spark, d)).select("url", "dup_redirect")


@query("j7_parent_child", with_(SQL_F2) + """
SELECT c.url, c.parent_url, p.status AS parent_status, p.depth AS parent_depth
FROM r2 c LEFT JOIN r2 p ON p.site = c.site AND p.url = c.parent_url""")
def j7_parent_child(spark, d):
    """Each page with its parent's status and depth."""
    return T.parent_child(fixture_pages(spark, d)).select("url", "parent_url", "parent_status", "parent_depth")


SQL_TREE = f"""
tree(site, url, parent_url, level, path) AS (
  SELECT site, url, '', 0, [url] FROM r2 WHERE url = '{FX.BASE}/p/0'
  UNION ALL
  SELECT c.site, c.url, c.parent_url, t.level + 1, list_append(t.path, c.url)
  FROM tree t JOIN r2 c ON c.site = t.site AND c.parent_url = t.url)"""


def fixture_tree(spark, d) -> DataFrame:
    return T.page_tree(fixture_pages(spark, d), fixture_sites(spark, d))


@query("g2_page_tree", "WITH RECURSIVE " + with_(SQL_F2, SQL_TREE)[5:] +
       "SELECT url, parent_url, CAST(level AS INTEGER) AS level, array_to_string(path, ' > ') AS path FROM tree")
def g2_page_tree(spark, d):
    """Page tree from the root over parent links (level and path)."""
    t = T.with_paths(fixture_tree(spark, d))
    return t.select("url", "parent_url", F.col("level").cast("int").alias("level"),
                    F.array_join("path", " > ").alias("path"))


def chain_results(spark, d) -> DataFrame:
    """Every page as one chain below page 0, page 0 with an error deep down; every 7th page hangs on a cycle instead."""
    i = F.col("page_id")
    url = lambda k: F.concat(F.lit(f"{FX.BASE}/c/"), k.cast("string"))
    looped = i % 7 == 6
    parent = F.when(i == 0, "").when(looped, F.concat(F.lit(f"{FX.BASE}/loop/"), i.cast("string"))).when(i % 7 == 0, url(i - 2)).otherwise(url(i - 1))
    chain = _pages(spark, d).select(F.lit(FX.SITE).alias("site"), url(i).alias("url"), parent.alias("parent_url"), i.alias("page_id"))
    # a looped page and its parent are each other's parent
    loops = chain.where(i % 7 == 6).select("site", F.col("parent_url").alias("url"), F.col("url").alias("parent_url"), "page_id")
    n = _pages(spark, d).count()
    code = F.when(i == n - 2 - F.when(F.lit((n - 2) % 7 == 6), 1).otherwise(0), 500).otherwise(200)
    return chain.unionByName(loops).select("site", "url", "parent_url", F.when(code == 500, "error").otherwise("ok").alias("status"),
                                           code.alias("http_status_code"), F.lit("").alias("redirect_url"), i.cast("int").alias("depth"))


def chain_tree(spark, d) -> DataFrame:
    sites = spark.createDataFrame([(FX.SITE, f"{FX.BASE}/c/0")], "site string, start_url string")
    return T.page_tree(chain_results(spark, d), sites)


@query("g2_deep_chain", f"""
SELECT '{FX.BASE}/c/' || page_id AS url, CASE WHEN page_id = 0 THEN '' WHEN page_id % 7 = 0 THEN '{FX.BASE}/c/' || (page_id - 2) ELSE '{FX.BASE}/c/' || (page_id - 1) END AS parent_url,
  CAST(page_id - page_id // 7 AS INTEGER) AS level FROM pages WHERE page_id % 7 <> 6""")
def g2_deep_chain(spark, d):
    """G2 over one chain of all pages (as deep as the table is long), without the pages that hang on cycles."""
    return chain_tree(spark, d).select("url", "parent_url", F.col("level").cast("int").alias("level"))


@query("g3_deep_ancestors", f"""
SELECT '{FX.BASE}/c/' || page_id AS url FROM pages
WHERE page_id % 7 <> 6 AND page_id <= {N} - 2 - CASE WHEN ({N} - 2) % 7 = 6 THEN 1 ELSE 0 END""")
def g3_deep_ancestors(spark, d):
    """G3 on the chain: the one page that matches near its end, and all pages above it."""
    return T.visible_with_ancestors(chain_tree(spark, d), chain_results(spark, d), "error").select("url")


@query("w11_sibling_order", "WITH RECURSIVE " + with_(SQL_F2, SQL_TREE)[5:] + """
SELECT url, parent_url, CAST(row_number() OVER (PARTITION BY site, parent_url ORDER BY url) AS BIGINT) AS sibling_pos
FROM tree""")
def w11_sibling_order(spark, d):
    """Alphabetical position among siblings."""
    return T.sibling_order(fixture_tree(spark, d)).select("url", "parent_url", "sibling_pos")


G3_TEXT = "500"


@query("g3_filter_ancestors", "WITH RECURSIVE " + with_(SQL_F2, SQL_DUP, SQL_TREE)[5:] + f"""
, m AS (SELECT t.site, t.path FROM tree t JOIN r2d USING (site, url)
        WHERE NOT r2d.dup_redirect AND (contains(lower(t.url), {lit(G3_TEXT)})
          OR contains(CAST(r2d.http_status_code AS VARCHAR), {lit(G3_TEXT)}) OR contains(lower(r2d.status), {lit(G3_TEXT)})))
SELECT DISTINCT site, url FROM (
  SELECT site, unnest(path) AS url FROM m
  UNION ALL SELECT t.site, t.url FROM tree t WHERE t.level = 0 AND EXISTS (SELECT 1 FROM m WHERE m.site = t.site))""")
def g3_filter_ancestors(spark, d):
    """G3 + FLT8: tree nodes matching "500" plus all their ancestors."""
    return T.visible_with_ancestors(fixture_tree(spark, d), fixture_pages(spark, d), G3_TEXT)


def _label_sql(st: str) -> str:
    return "CASE " + " ".join(f"WHEN {st} = {lit(k)} THEN {lit(v)}" for k, v in S.STATUS_LABELS.items()) + " ELSE '?' END"


@query("flt7_result_search", with_(SQL_F2, SQL_DUP) + f"""
SELECT url, status FROM r2d WHERE NOT dup_redirect AND (contains(lower(url), 'err')
  OR contains(lower({_label_sql('status')}), 'err') OR contains(CAST(http_status_code AS VARCHAR), 'err'))""")
def flt7_result_search(spark, d):
    """FLT7: result-table search for "err" (status label ERR), duplicate redirects hidden."""
    return T.result_search(fixture_pages(spark, d), "err").select("url", "status")


@query("flt7_form_search", with_(SQL_F2, SQL_DUP) + f"""
SELECT url, status FROM r2d WHERE NOT dup_redirect AND is_error AND (contains(lower(url), 'form')
  OR contains(lower({_label_sql('status')}), 'form') OR contains(CAST(http_status_code AS VARCHAR), 'form') OR has_form)""".replace(
    "is_error", "(status NOT IN ('redirect','redirect_external') AND (http_status_code >= 400 OR status IN ('error','timeout')))"))
def flt7_form_search(spark, d):
    """FLT7: errors-only search for "form" (pages with a form match)."""
    return T.result_search(fixture_pages(spark, d), "form", only_errors=True).select("url", "status")


# ---------------------------------------------------------------------------
# HTML4: rendered-DOM link variant
# ---------------------------------------------------------------------------

def rendered_links_sql(src: str) -> str:
    m = O.clean("html")
    netloc = f"lower({O.part('target_url', 'netloc')})"
    res = O.resolve("source_url", "href")
    return f"""
lm AS (SELECT site, site_scheme, url AS source_url, {m} AS m FROM {src}),
lp AS (SELECT *, regexp_split_to_array(m, '(?i)<a\\s') AS pcs,
              regexp_extract_all(m, '(?is)<(?:embed|iframe|object)\\s[^>]*>', 0) AS ems FROM lm),
la AS (SELECT site, site_scheme, source_url, unnest(pcs[2:]) AS piece,
              CAST(generate_subscripts(pcs[2:], 1) - 1 AS INTEGER) AS position FROM lp),
lat AS (SELECT *, '<a ' || regexp_extract(piece, '^([^>]*)>?', 1) AS tag,
               regexp_extract(piece, '(?is)^[^>]*>(.*?)(?:</a\\s*>|$)', 1) AS inner_html FROM la),
lac AS (SELECT site, site_scheme, source_url, position, {O.has_attr('tag', 'href')} AS present,
               {O.strip(O.attr('tag', 'href'))} AS href,
               substr({O.strip(O.decode("regexp_replace(inner_html, '<[^>]*>', '', 'g')"))}, 1, {O.LINK_TEXT_MAX_CHARS}) AS link_text,
               'a' AS kind FROM lat),
le AS (SELECT site, site_scheme, source_url, unnest(ems) AS tag,
              CAST(len(pcs) - 1 + generate_subscripts(ems, 1) - 1 AS INTEGER) AS position FROM lp),
lec AS (SELECT site, site_scheme, source_url, position,
               CASE WHEN lower(regexp_extract(tag, '^<(\\w+)', 1)) = 'object' THEN {O.has_attr('tag', 'data')}
                    ELSE {O.has_attr('tag', 'src')} END AS present,
               {O.strip(f"CASE WHEN lower(regexp_extract(tag, '^<(\\w+)', 1)) = 'object' THEN {O.attr('tag', 'data')} ELSE {O.attr('tag', 'src')} END")} AS href,
               '' AS link_text, lower(regexp_extract(tag, '^<(\\w+)', 1)) AS kind FROM le),
lall AS (SELECT * FROM lac WHERE present UNION ALL SELECT * FROM lec WHERE present),
lres AS (SELECT site, site_scheme, source_url, position,
           {res} || CASE WHEN regexp_extract(href, '(#.*)$', 1) <> '' THEN regexp_extract(href, '(#.*)$', 1) ELSE '' END
             AS target_url, link_text, kind FROM lall),
lk AS (SELECT site, source_url, position, target_url,
              {O.full_normalize('target_url', 'site', 'site_scheme')} AS target_norm, link_text, kind
       FROM lres
       WHERE starts_with(target_url, 'http') AND ({netloc} = site
         OR ({O.is_file('target_url')} AND {O.without_environment(netloc)} = {O.without_environment('site')})))"""


@query("html4_rendered_links", with_(SQL_PAGES_AS_FETCHES, rendered_links_sql("pf")) + "SELECT * FROM lk")
def html4_rendered_links(spark, d):
    """HTML4: links in rendered-DOM mode (http links only, fragment kept,
    text content trimmed as a whole)."""
    from ..operators import pages as P
    return L.extract_links(P.stored_pages_as_fetches(_pages(spark, d)), mode="rendered")
