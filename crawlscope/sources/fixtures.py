"""Stand-in crawl inputs derived from the given test tables.

The test tables hold real-looking pages but no fetch metadata (status codes,
redirects, robots files, sitemaps, file checks). These builders turn each
row of ``pages`` (and ``events``) into one row of the input schema the jobs
expect, by fixed integer rules on ``page_id``. They do none of the jobs'
work: statuses, referrers, depths, sitemap rows and so on are computed by
the operators from these rows. Row counts grow with the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SITE = "www.site.example"
SITE_SCHEME = "https"
BASE = f"{SITE_SCHEME}://{SITE}"
EXTERNAL_LOGIN = "https://login.sso.example/start"
LAST_MODIFIED = "Sat, 16 May 2026 15:46:36 GMT"
HTML_TYPE = "text/html; charset=utf-8"
ROBOTS_TXT = "\n".join([
    "# robots for the fixture site",
    "User-agent: ExampleBot",
    "Disallow: /",
    "",
    "User-agent: *",
    "Disallow: /p/1",
    "Allow: /p/12  # more specific",
    "Disallow: /*9$",
    "Disallow:",
    f"Sitemap: {BASE}/sitemap.xml",
    f"sitemap: {BASE}/sitemap-news.xml",
])
# ---------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_url(i: Column) -> Column:
    return F.concat(F.lit(f"{BASE}/p/"), i.cast("string"))


def status_code_rule(i: Column) -> Column:
    return (
        F.when(i == 0, 200).when(i % 11 == 3, 301).when(i % 13 == 5, 404)
        .when(i % 17 == 9, 500).when(i % 19 == 7, 0).otherwise(200)
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one stored fetch per page row of the fixture site; the body is the
    page's own HTML from ``pages``."""
    i = F.col("page_id")
    code = status_code_rule(i)
    redirect = (
        F.when(code != 301, F.lit(""))
        .when(i % 3 == 0, _page_url(i + 1))
        .when(i % 3 == 1, F.concat(F.lit(f"{BASE}/alias/"), (i % 5).cast("string")))
        .otherwise(F.lit(EXTERNAL_LOGIN))
    )
    headers = F.map_from_arrays(
        F.array(F.lit("Server"), F.lit("x-powered-by"), F.lit("ETag"), F.lit("X-Cache"), F.lit("content-length")),
        F.array(
            F.when(i % 3 == 0, F.lit("nginx/1.24.0")).when(i % 3 == 1, F.lit("Apache/2.4")).otherwise(F.lit("")),
            F.when(i % 4 == 0, F.lit("PHP/8.2.1")).otherwise(F.lit("")),
            F.when(i % 2 == 0, F.concat(F.lit('"e'), i.cast("string"), F.lit('"'))).otherwise(F.lit("")),
            F.when(i % 5 == 0, F.lit("HIT")).otherwise(F.lit("")),
            ((i * 7919) % 2500000).cast("string"),
        ),
    )
    return _read(spark, sf_dir, "pages").select(
        F.lit(SITE).alias("site"),
        F.lit(SITE_SCHEME).alias("site_scheme"),
        i.alias("page_id"),
        _page_url(i).alias("url"),
        code.cast("int").alias("http_status_code"),
        redirect.alias("redirect_url"),
        F.when(i % 23 == 1, F.lit("application/pdf")).otherwise(F.lit(HTML_TYPE)).alias("content_type"),
        F.when(code == 0, F.lit("timed out")).otherwise(F.lit("")).alias("error_message"),
        ((i * 37) % 4000).cast("double").alias("load_time_ms"),
        ((i * 7919) % 2500000).cast("bigint").alias("page_size"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.lit(LAST_MODIFIED)).alias("last_modified"),
        (F.length(F.bin(i + 1)) - 1).cast("int").alias("depth"),
        F.when(i == 0, F.lit("")).otherwise(_page_url(F.floor((i - 1) / 2).cast("bigint"))).alias("parent_url"),
        (i % 29 == 4).alias("has_form"),
        headers.alias("response_headers"),
        F.col("html"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stored links of the fixture site, already resolved (four per page)."""
    pages = _read(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    i = F.col("page_id")
    rules = [
        (1, i * 2 + 1, i * 2 + 1 < n),
        (2, i * 2 + 2, i * 2 + 2 < n),
        (3, (i * 7 + 3) % n, F.lit(True)),
        (4, F.lit(0), i > 0),
    ]
    parts = [
        pages.where(cond).select(
            F.lit(SITE).alias("site"),
            _page_url(i).alias("source_url"),
            F.lit(pos).alias("position"),
            _page_url(target.cast("bigint")).alias("target_url"),
            F.lit(f"link {pos}").alias("link_text"),
            F.lit("a").alias("kind"),
        )
        for pos, target, cond in rules
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("target_norm", F.col("target_url"))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the published sitemap of the fixture site (site, url)."""
    pages = _read(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    listed = pages.where(i % 4 != 1).select(F.lit(SITE).alias("site"), _page_url(i).alias("url"))
    only = pages.where(i < 5).select(
        F.lit(SITE).alias("site"), F.concat(F.lit(f"{BASE}/only-sitemap/"), i.cast("string")).alias("url"))
    return listed.unionByName(only)


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 as XML files: sitemap files of at most 1000 URLs (page_id mod 7, then
    by thousands) and an index naming them (site, doc_url, xml). Even files use the sitemap namespace, odd ones
    none; ``<loc>`` texts are padded and one empty ``<loc/>`` ends each file."""
    i = F.col("page_id")
    pages = _read(spark, sf_dir, "pages").select("page_id")
    listed = pages.where(i % 4 != 1).select(i, _page_url(i).alias("url"))
    only = pages.where(i < 5).select(i, F.concat(F.lit(f"{BASE}/only-sitemap/"), i.cast("string")).alias("url"))
    urls = listed.unionByName(only).withColumn("file_no", (i % 7 + F.floor(i / 7000) * 7).cast("int"))
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    entry = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))
    files = urls.groupBy("file_no").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("body")).select(
        F.lit(SITE).alias("site"),
        F.concat(F.lit(f"{BASE}/sitemap-"), F.col("file_no").cast("string"), F.lit(".xml")).alias("doc_url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset '),
            F.when(F.col("file_no") % 2 == 0, F.lit(ns)).otherwise(F.lit("")),
            F.lit(">\n"), F.col("body"), F.lit("\n<url><loc></loc></url>\n</urlset>"),
        ).alias("xml"),
    )
    child = F.concat(F.lit("<sitemap><loc>"), F.col("doc_url"), F.lit("</loc></sitemap>"))
    index = files.groupBy("site").agg(F.array_join(F.sort_array(F.collect_list(child)), "\n").alias("body")).select(
        "site", F.lit(f"{BASE}/sitemap.xml").alias("doc_url"),
        F.concat(F.lit(f"<sitemapindex {ns}>\n"), F.col("body"),
                 F.lit(f"\n<url><loc>{BASE}/ignored-in-index</loc></url>\n</sitemapindex>")).alias("xml"),
    )
    return files.unionByName(index)


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 plus one robots.txt per host of ``pages`` (site, text).

    The fixture site gets the fixed file above. Every other host gets a named
    agent block that blocks everything, then a ``*`` block that disallows the
    path of each of its pages with page_id divisible by 3, allows those
    divisible by 9 again with a longer pattern, and blocks ``*.html$``.
    """
    pages = _read(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    i = F.col("page_id")
    line = (
        F.when(i % 9 == 0, F.concat(F.lit("Allow: "), path, F.lit("*")))
        .when(i % 3 == 0, F.concat(F.lit("Disallow: "), path))
    )
    per_host = pages.select(host.alias("site"), i, line.alias("line")).groupBy("site").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(i, F.col("line")))), lambda s: s["line"]),
                     "\n").alias("rules")
    ).select(
        "site",
        F.concat(
            F.lit("User-agent: OtherBot\nDisallow: /\n\nUser-agent: *  # everyone else\n"),
            F.col("rules"), F.lit("\nDisallow: /*.html$\nSitemap: https://"), F.col("site"), F.lit("/sitemap.xml"),
        ).alias("text"),
    )
    fixture = pages.where(i == 0).select(F.lit(SITE).alias("site"), F.lit(ROBOTS_TXT).alias("text"))
    return fixture.unionByName(per_host)


def _doc_number(page_id):
    """The document a page links: one for five pages, some documents linked from several."""
    return page_id % 20 + 20 * F.floor(page_id / 100)


def file_link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page markup of every page (site, site_scheme, url, html). Pages with
    page_id divisible by 5 link a document (on www., bare, or test.), every
    tenth also embeds it with a query string, and some also frame a copy on a
    sister sub-domain; every page links a page on the bare host."""
    i = F.col("page_id")
    number = _doc_number(i).cast("string")
    doc = F.concat(F.lit("/files/doc"), number, F.lit(".pdf"))
    host = F.when(i % 3 == 0, F.lit("www.site.example")).when(i % 3 == 1, F.lit("site.example")).otherwise(
        F.lit("test.site.example"))
    main = F.when(i % 5 == 0, F.concat(F.lit('<p><a href="https://'), host, doc, F.lit('">Document '),
                                       number, F.lit("</a></p>"))).otherwise(F.lit("<p>no files</p>"))
    sister = F.when(i % 25 == 10, F.concat(F.lit('<iframe src="https://solar.site.example'), doc,
                                            F.lit('"></iframe>'))).otherwise(F.lit(""))
    embed = F.when(i % 10 == 0, F.concat(F.lit('<embed src="'), doc, F.lit('?v=2">'))).otherwise(F.lit(""))
    return _read(spark, sf_dir, "pages").select(
        F.lit(SITE).alias("site"), F.lit(SITE_SCHEME).alias("site_scheme"), i.alias("page_id"),
        _page_url(i).alias("url"),
        F.concat(F.lit("<html><body>"), main, sister, embed, F.lit('<a href="https://site.example/p/1">page</a>'),
                 F.lit("</body></html>")).alias("html"),
    )


def file_check_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logged HEAD and GET answers per document URL (url, method, status_code,
    content_type, content_length, content_range)."""
    docs = file_link_pages(spark, sf_dir).where(F.col("html").contains("/files/doc")).select(
        _doc_number(F.col("page_id")).alias("doc")).distinct()
    d = F.col("doc")
    url = F.concat(F.lit(f"{BASE}/files/doc"), d.cast("string"), F.lit(".pdf"))
    length = (d + 1) * 1000
    head = docs.select(
        url.alias("url"), F.lit("HEAD").alias("method"),
        F.when(d % 20 == 5, 405).when(d % 20 == 10, 404).otherwise(200).cast("int").alias("status_code"),
        F.lit("application/pdf").alias("content_type"),
        F.when(d % 20 == 5, F.lit("")).otherwise(length.cast("string")).alias("content_length"),
        F.lit("").alias("content_range"),
    )
    get = docs.where(d % 20 == 5).select(
        url.alias("url"), F.lit("GET").alias("method"), F.lit(206).alias("status_code"),
        F.lit("application/pdf").alias("content_type"), F.lit("1").alias("content_length"),
        F.concat(F.lit("bytes 0-0/"), length.cast("string")).alias("content_range"),
    )
    return head.unionByName(get)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: fetch requests per host from ``events`` (host, url, ts, status_code, redirect_url)."""
    e = _read(spark, sf_dir, "events")
    host = F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"), F.lit(".example"))
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 301).otherwise(200)
    return e.select(
        F.col("event_id"), host.alias("host"),
        F.concat(F.lit("https://"), host, F.lit("/e/"), F.col("event_id").cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"), code.cast("int").alias("status_code"),
        F.when(code == 301, F.concat(F.lit("https://"), host, F.lit("/"))).otherwise(F.lit("")).alias("redirect_url"),
        F.col("value").alias("elapsed_ms"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one crawl run per (host, day) of the request log; a run is
    cancelled when its day of month is a multiple of 7."""
    log = request_log(spark, sf_dir)
    day = F.to_date("ts")
    return log.groupBy("host", day.alias("day")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")
    ).select(
        F.concat_ws("/", "host", F.col("day").cast("string")).alias("run_id"),
        "host", F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("start_url"),
        "started_at", "ended_at", (F.dayofmonth("day") % 7 != 0).alias("completed"),
    )
