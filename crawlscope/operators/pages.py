"""Page results: one row per fetched URL with status and page findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import status as S
from .links import is_link_extractable


def _empty_headers():
    return F.create_map().cast("map<string,string>")


def stored_pages_as_fetches(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """SRC1 over a stored page table (url, html): each row is a successful
    HTML fetch of its own site (netloc of the URL) at depth 0; the page size is
    the UTF-8 byte length of the body."""
    from ..functions import urls as U

    u = F.col("url")
    return pages.select(
        F.lower(U.url_part(u, "netloc")).alias("site"),
        F.lower(U.url_part(u, "scheme")).alias("site_scheme"),
        "*",
        F.lit(200).alias("http_status_code"),
        F.lit("").alias("redirect_url"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit("").alias("error_message"),
        F.lit(0.0).alias("load_time_ms"),
        F.octet_length(F.col(html_col)).cast("bigint").alias("page_size"),
        F.lit("").alias("last_modified"),
        F.lit(0).alias("depth"),
        F.lit("").alias("parent_url"),
        _empty_headers().alias("response_headers"),
    )


def with_status(fetches: DataFrame) -> DataFrame:
    """FLT1 + FLT3 + FLT17 on a fetch log (site, url, http_status_code,
    redirect_url, error_message, ...)."""
    code = F.col("http_status_code")
    status = S.page_status(code, F.col("redirect_url"), F.col("error_message"), F.col("site"))
    return fetches.withColumn("status", status).withColumn(
        "is_error", S.is_error(F.col("status"), code)
    ).withColumn("error_class", S.error_class(F.col("error_message")))


def with_findings(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """HTML6 + HTML7 + HTML8 + HTML9 + HTML10 in one projection over the page
    rows (the HTML column is read once and can be dropped afterwards). Only
    pages that pass HTML5 and were fetched are looked into; the others keep the
    defaults (no form, empty SEO record, no technologies)."""
    gate = F.coalesce(
        is_link_extractable(F.col("http_status_code"), F.col("content_type"), F.col("redirect_url"), F.col("site"))
        & ~S.fetch_failed(F.col("http_status_code"), F.col("error_message")), F.lit(False))
    body = F.when(gate, F.col(html_col)).otherwise("")
    decommented = H.decomment(body)
    markup = H.clean(body)
    headers = F.transform_keys(F.coalesce(F.col("response_headers"), _empty_headers()), lambda k, v: F.lower(k))
    out = pages.withColumn("_markup", markup).withColumn("_decommented", decommented).withColumn("_h", headers)
    # each markup is scanned for tags once; the findings read the tag tables
    out = out.withColumn("_tags", H.tag_table(F.col("_markup"), H.PAGE_TAGS)).withColumn("_tech_tags", H.tag_table(F.col("_decommented"), H.TECH_TAGS))
    out = out.withColumn("has_form", H.form_of(F.col("_tags")))
    out = out.withColumn("seo", H.seo_of(F.col("_tags"), H.title_of(F.col("_markup"))))
    out = out.withColumn("tech", F.when(gate, H.tech_of(F.col("_tech_tags"), F.col("_h"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("http_details", H.interesting_headers(F.col("_h")))
    out = out.withColumn(
        "issues",
        H.issues(F.col("http_status_code"), F.col("content_type"), F.col("seo"), F.col("load_time_ms"),
                 F.col("page_size")),
    )
    return out.drop("_markup", "_decommented", "_h", "_tags", "_tech_tags")
