"""Sitemap rows, sitemap diff and sitemap parsing.

``sitemap_rows`` (SET3) is a union of two filters and one anti join; the
de-duplication of redirect targets (W5) is an aggregate keyed by
(site, normalised target), so no group is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import status as S
from ..functions import urls as U
from .ordering import sequence_within_groups

# --- fixed values -----------------------------------------------------------
MAX_URLS_PER_SITEMAP = 50_000
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_INDEX_DEPTH = 3
# Well-known sitemap locations tried after the robots.txt entries, in order.
WELL_KNOWN_SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/sitemapindex.xml",
                            "/sitemap/index.xml"]
# ---------------------------------------------------------------------------


def priority(depth: Column) -> Column:
    """max(0.1, 1.0 - 0.2 * depth) with one decimal."""
    value = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.2) * depth.cast("double"))
    return F.format_string("%.1f", F.bround(value, 1))


def sitemap_rows(results: DataFrame, site_base: DataFrame | None = None, exclude_known_errors: bool = False) -> DataFrame:
    """SET3 (+ J4, J5, W5, G5): rows of the generated sitemap per site.

    Direct rows: code 200 and HTML (FLT6), not de-duplicated. Resolved rows:
    the redirect target of a redirect row when its normalised form is not a
    direct page (J4), it is on the site's host (J5), and it is the first
    redirect to that target by (depth, url) (W5); it gets code 200, no
    last-modified and the redirect's depth. ``exclude_known_errors`` also drops
    targets that were crawled with an error code (off by default, as in the
    reference).
    """
    direct = results.where((F.col("http_status_code") == 200) & S.is_sitemap_html(F.col("content_type"))).select(
        "site", "url", F.coalesce(F.col("last_modified"), F.lit("")).alias("last_modified"),
        F.col("depth").cast("int").alias("depth"), F.lit(False).alias("is_resolved"),
    )
    direct_norm = direct.select("site", U.normalize(F.col("url")).alias("_norm")).distinct()
    target = F.trim(F.coalesce(F.col("redirect_url"), F.lit("")))
    redirects = results.where(F.col("status").isin(*S.REDIRECT_STATUSES)).select(
        "site", target.alias("target"), F.col("depth").cast("int").alias("depth"), F.col("url").alias("_from"),
    ).where(F.col("target") != "")
    redirects = redirects.withColumn("_norm", U.normalize(F.col("target")))
    on_host = (F.col("site") == "") | U.same_host(F.col("site"), U.url_part(F.col("target"), "netloc"))
    candidates = redirects.where(on_host).join(direct_norm, ["site", "_norm"], "left_anti")
    if exclude_known_errors:
        # option: a redirect to a page that was crawled and failed stays out
        failed = results.where(F.col("http_status_code") >= 400).select("site", U.normalize(F.col("url")).alias("_norm"))
        candidates = candidates.join(failed.distinct(), ["site", "_norm"], "left_anti")
    first = candidates.groupBy("site", "_norm").agg(
        F.min_by(F.struct("target", "depth"), F.struct("depth", "_from")).alias("r")
    )
    resolved = first.select(
        "site", F.col("r.target").alias("url"), F.lit("").alias("last_modified"),
        F.col("r.depth").alias("depth"), F.lit(True).alias("is_resolved"),
    )
    rows = direct.unionByName(resolved)
    return rows.withColumn("priority", priority(F.col("depth")))


def sitemap_plan(rows: DataFrame) -> DataFrame:
    """AGG5: (total URLs, resolved redirect targets) per site."""
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_urls"),
        F.count_if(F.col("is_resolved")).cast("bigint").alias("resolved_targets"),
    )


def with_parts(rows: DataFrame, max_urls: int = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """SRT4 + W6: order (direct first, then by depth and URL) and part number
    ``ceil(seq / max_urls)`` per site; ``parts`` = number of parts of the site."""
    numbered = sequence_within_groups(rows, ["site"], ["is_resolved", "depth", "url"], out_col="seq")
    numbered = numbered.withColumn("part", F.ceil(F.col("seq") / F.lit(max_urls)).cast("int"))
    parts = numbered.groupBy("site").agg(F.max("part").alias("parts"))
    return numbered.join(parts, "site")


def _keyed(df: DataFrame, normalize: bool) -> DataFrame:
    if normalize:
        return df.select("site", U.normalize(F.col("url")).alias("url"))
    return df.select("site", "url")


def not_in_sitemap(results: DataFrame, sitemap: DataFrame, normalize: bool = False) -> DataFrame:
    """SET1: crawled 200 URLs missing from the published sitemap (raw text by
    default; ``normalize=True`` compares normalised URLs)."""
    crawled = _keyed(results.where(F.col("http_status_code") == 200), normalize).distinct()
    return crawled.join(_keyed(sitemap, normalize), ["site", "url"], "left_anti")


def not_crawled(results: DataFrame, sitemap: DataFrame, normalize: bool = False) -> DataFrame:
    """SET2: published sitemap URLs that were not crawled with code 200."""
    crawled = _keyed(results.where(F.col("http_status_code") == 200), normalize)
    return _keyed(sitemap, normalize).distinct().join(crawled, ["site", "url"], "left_anti")


def sitemap_flag(results: DataFrame, sitemap: DataFrame, normalize: bool = False) -> DataFrame:
    """``missing_from_sitemap`` = code 200, the site has a sitemap, and the
    URL is not in it (raw text by default)."""
    listed = _keyed(sitemap, normalize).distinct().withColumnRenamed("url", "_key").withColumn("_listed", F.lit(True))
    sites = sitemap.select("site").distinct().withColumn("_has_sitemap", F.lit(True))
    key = U.normalize(F.col("url")) if normalize else F.col("url")
    out = results.withColumn("_key", key).join(listed, ["site", "_key"], "left").join(sites, "site", "left")
    flag = (F.col("http_status_code") == 200) & F.col("_has_sitemap").isNotNull() & F.col("_listed").isNull()
    return out.withColumn("missing_from_sitemap", F.coalesce(flag, F.lit(False))).drop("_key", "_listed", "_has_sitemap")


def sitemap_diff(results: DataFrame, sitemap: DataFrame) -> DataFrame:
    """SNK7 + AGG10: long table (site, section, url) plus per-section counts."""
    a = not_in_sitemap(results, sitemap).withColumn("section", F.lit("not_in_sitemap"))
    b = not_crawled(results, sitemap).withColumn("section", F.lit("not_crawled"))
    rows = a.unionByName(b)
    counts = rows.groupBy("site", "section").agg(F.count(F.lit(1)).cast("bigint").alias("section_count"))
    return rows.join(counts, ["site", "section"])


# --- sitemap documents ------------------------------------------------------

_SITEMAP_SCHEMA = "sitemap ARRAY<STRUCT<loc: STRING>>, url ARRAY<STRUCT<loc: STRING>>, _bad STRING"


def parse_sitemap_documents(docs: DataFrame) -> DataFrame:
    """SRC2 per document (site, doc_url, xml) -> (site, doc_url, is_index,
    locs ARRAY<STRING>): ``<loc>`` texts trimmed, empty ones skipped. Whatever
    its root is called, a document with a ``sitemap/loc`` is an index that
    lists its children (its ``url`` entries are ignored); another one lists
    its ``url/loc``. A document that is not well-formed XML yields no entries."""
    # parsed once, by Spark's XML reader; what it can't parse becomes null
    parsed = docs.select("site", "doc_url", F.from_xml(
        F.trim("xml"), _SITEMAP_SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_bad"}).alias("_x"))
    good = F.col("_x").isNotNull() & F.col("_x._bad").isNull()

    def locs(item: str) -> Column:
        found = F.transform(F.filter(F.col(f"_x.{item}.loc"), lambda s: s.isNotNull()), H.strip)
        return F.when(good, F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))

    parsed = parsed.select("site", "doc_url", locs("sitemap").alias("_children"), locs("url").alias("_urls"))
    is_index = F.size("_children") > 0
    return parsed.select("site", "doc_url", is_index.alias("is_index"), F.filter(
        F.when(is_index, F.col("_children")).otherwise(F.col("_urls")), lambda s: s != "").alias("locs"))


def load_sitemap_urls(docs: DataFrame, root_urls: DataFrame, max_depth: int = MAX_INDEX_DEPTH) -> DataFrame:
    """SRC3 + SET5: follow sitemap indexes from each site's root document up
    to ``max_depth`` levels below it and return the distinct page URLs
    (site, url). ``root_urls`` is (site, doc_url). Each level is one join of
    the frontier with the parsed documents; no level collects anything."""
    parsed = parse_sitemap_documents(docs)
    frontier = root_urls.select("site", "doc_url").distinct()
    found = None
    seen = frontier
    for level in range(max_depth + 1):
        level_docs = frontier.join(parsed, ["site", "doc_url"])
        pages = level_docs.where(~F.col("is_index")).select("site", F.explode("locs").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        if level == max_depth:
            break
        children = level_docs.where(F.col("is_index")).select("site", F.explode("locs").alias("doc_url")).distinct()
        frontier = children.join(seen, ["site", "doc_url"], "left_anti")
        seen = seen.unionByName(frontier)
    return found.distinct()


def sitemap_file_seeds(parsed_file: DataFrame) -> DataFrame:
    """SRC4: a single sitemap file (site, locs) as a seed list; the site base is
    scheme + host + "/" of the smallest URL."""
    urls = parsed_file.select("site", F.explode("locs").alias("url")).distinct()
    base = urls.groupBy("site").agg(F.min("url").alias("_first")).select(
        "site",
        F.concat(U.url_part(F.col("_first"), "scheme"), F.lit("://"), U.url_part(F.col("_first"), "netloc"),
                 F.lit("/")).alias("base_url"),
    )
    return urls.join(base, "site")


def choose_sitemap(candidates: DataFrame) -> DataFrame:
    """SRC7: first valid candidate per site. ``candidates`` has (site,
    priority, url, head_status, head_content_type, get_status, get_prefix).
    Valid: HEAD 200, and either an xml/text content type or a ranged GET
    200/206 whose first 512 characters contain an XML or sitemap start tag."""
    ct = F.lower(F.coalesce(F.col("head_content_type"), F.lit("")))
    known_type = ct.contains("xml") | ct.contains("text")
    prefix = F.substring(F.coalesce(F.col("get_prefix"), F.lit("")), 1, 512)
    get_ok = F.col("get_status").isin(200, 206) & (
        prefix.contains("<?xml") | prefix.contains("<urlset") | prefix.contains("<sitemapindex"))
    valid = candidates.where((F.col("head_status") == 200) & (known_type | get_ok))
    return valid.groupBy("site").agg(F.min_by("url", "priority").alias("sitemap_url"))


def sitemap_candidates(robots_sitemaps: DataFrame, site_bases: DataFrame) -> DataFrame:
    """SRC7 candidate list: robots.txt entries in file order, then the
    well-known paths (site, priority, url)."""
    from_robots = robots_sitemaps.select("site", F.col("line_no").cast("bigint").alias("priority"),
                                         F.col("sitemap_url").alias("url"))
    known = site_bases.select(
        "site",
        F.posexplode(F.array(*[F.lit(p) for p in WELL_KNOWN_SITEMAP_PATHS])).alias("_k", "_path"),
        "base_url",
    ).select("site", (F.lit(1 << 40) + F.col("_k")).cast("bigint").alias("priority"),
             F.concat(F.regexp_replace("base_url", "/+$", ""), F.col("_path")).alias("url"))
    return from_robots.unionByName(known)


def seed_intake(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """SRC10 + SET4: seed URLs whose exact lower-cased netloc is the site's
    enter the frontier at depth 1 with the start URL as parent; duplicates
    and the start URL itself are dropped (site, url, depth, parent)."""
    s = seeds.join(sites.select("site", "start_url", "site_scheme"), "site")
    s = s.where(F.lower(U.url_part(F.col("url"), "netloc")) == F.col("site"))
    s = s.select("site", U.full_normalize(F.col("url"), F.col("site"), F.col("site_scheme")).alias("url"),
                 F.col("start_url").alias("parent"))
    start_norm = U.full_normalize(F.col("start_url"), F.col("site"), F.col("site_scheme"))
    starts = sites.select("site", start_norm.alias("url"))
    return s.distinct().join(starts, ["site", "url"], "left_anti").withColumn("depth", F.lit(1))
