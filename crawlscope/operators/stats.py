"""Aggregates over page results: run counters, site score, frequencies.

All of them are ``groupBy`` aggregations with ``count_if``/``sum``/``max``,
so Spark runs a partial aggregate in every map task and shuffles only one
row per group and task; a site holding a third of all rows costs no more
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S

# --- fixed values -----------------------------------------------------------
GRADES = [(90, "A"), (75, "B"), (60, "C"), (45, "D"), (30, "E")]
# ---------------------------------------------------------------------------


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def run_counters(results: DataFrame, keys=("site",)) -> DataFrame:
    """AGG1: live crawl counters per run (as counted while crawling)."""
    code = F.col("http_status_code")
    status = F.col("status")
    failed = S.fetch_failed(code, F.col("error_message"))
    redirected = status.isin(*S.REDIRECT_STATUSES)
    responded = ~failed & ~redirected & status.isin("ok", "error")
    cls = F.floor(code / 100)
    scanned = status.isin(*S.SCANNED_STATUSES)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_discovered"),
        _count_if(scanned).alias("total_crawled"),
        _count_if(status == "skipped").alias("total_skipped"),
        (_count_if(failed) + _count_if(responded & cls.isin(4, 5))).alias("total_errors"),
        _count_if(responded & (cls == 2)).alias("total_2xx"),
        (_count_if(redirected) + _count_if(responded & (cls == 3))).alias("total_3xx"),
        _count_if(responded & (cls == 4)).alias("total_4xx"),
        _count_if(responded & (cls == 5)).alias("total_5xx"),
        F.coalesce(F.max(F.when(scanned & ~failed, F.col("depth"))), F.lit(0)).cast("int").alias("max_depth_reached"),
    )


def report_counters(results: DataFrame, keys=("site",)) -> DataFrame:
    """AGG2: counters rebuilt from finished rows (classes by code only)."""
    code = F.col("http_status_code")
    status = F.col("status")
    cls = F.when(code != 0, F.floor(code / 100))
    c4 = _count_if(cls == 4)
    c5 = _count_if(cls == 5)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_discovered"),
        _count_if(~status.isin("pending", "max_depth", "skipped")).alias("total_crawled"),
        _count_if(cls == 2).alias("total_2xx"),
        _count_if(cls == 3).alias("total_3xx"),
        c4.alias("total_4xx"),
        c5.alias("total_5xx"),
        (c4 + c5 + _count_if(status.isin("error", "timeout") & (code < 400))).alias("total_errors"),
    )


def grade(score: Column) -> Column:
    """AGG4: letter grade of a 0-100 score."""
    out = None
    for bound, letter in GRADES:
        out = F.when(score >= bound, F.lit(letter)) if out is None else out.when(score >= bound, F.lit(letter))
    return out.otherwise(F.lit("F"))


def site_score(results: DataFrame, keys=("site",)) -> DataFrame:
    """AGG3 + AGG4: share of scanned pages without errors, round half to even."""
    status = F.col("status")
    scanned = status.isin(*S.SCANNED_STATUSES)
    clean = scanned & ~S.is_error(status, F.col("http_status_code"))
    agg = results.groupBy(*keys).agg(
        _count_if(scanned).alias("total_pages"),
        _count_if(clean).alias("clean_pages"),
        F.coalesce(F.sum(F.when(scanned, F.col("links_found"))), F.lit(0)).cast("bigint").alias("total_links"),
    )
    score = F.when(F.col("total_pages") > 0,
                   F.bround(F.lit(100.0) * F.col("clean_pages") / F.col("total_pages"), 0)).otherwise(F.lit(0))
    return agg.select(
        *keys,
        score.cast("int").alias("score"),
        "total_pages", "clean_pages",
        (F.col("total_pages") - F.col("clean_pages")).alias("pages_with_errors"),
        "total_links",
    ).withColumn("grade", grade(F.col("score")))


def all_redirected(counters: DataFrame) -> DataFrame:
    """FLT14: runs that got only redirects (2xx = 0 and 3xx > 0)."""
    return counters.where((F.col("total_2xx") == 0) & (F.col("total_3xx") > 0))


def redirect_cause(results: DataFrame, keys=("site",)) -> DataFrame:
    """AGG13: number of redirects of sites whose sitemap is empty because no
    page answered 200."""
    agg = results.groupBy(*keys).agg(
        _count_if(F.col("status").isin(*S.REDIRECT_STATUSES)).alias("redirected"),
        _count_if(F.col("http_status_code") == 200).alias("ok_200"),
    )
    return agg.where((F.col("redirected") > 0) & (F.col("ok_200") == 0)).select(*keys, "redirected")


def issue_frequency(pages: DataFrame, column: str = "issues", name: str = "issue") -> DataFrame:
    """AGG12: pages per (site, issue code) or (site, technology)."""
    return (
        pages.select("site", F.explode(F.col(column)).alias(name))
        .groupBy("site", name)
        .agg(F.count(F.lit(1)).cast("bigint").alias("pages"))
    )


def depth_distribution(results: DataFrame) -> DataFrame:
    """Pages per (site, depth)."""
    return results.groupBy("site", "depth").agg(F.count(F.lit(1)).cast("bigint").alias("pages"))


def run_duration(runs: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """AGG9: seconds between start and end, rate and display text."""
    secs = (F.unix_micros(F.col("ended_at")) - F.unix_micros(F.col("started_at"))) / F.lit(1e6)
    out = runs.withColumn("duration_seconds", secs.cast("double"))
    d = F.col("duration_seconds")
    mins = F.floor(d / 60)
    text = (
        F.when(d < 60, F.format_string("%ds", F.bround(d, 0).cast("long")))
        .when(mins < 60, F.format_string("%dm %ds", mins.cast("long"), F.floor(d % 60).cast("long")))
        .otherwise(F.format_string("%dh %dm", F.floor(mins / 60).cast("long"), (mins % 60).cast("long")))
    )
    out = out.withColumn("duration_display", text)
    if crawled is not None:
        out = out.join(crawled, "run_id", "left").withColumn(
            "urls_per_second",
            F.when(d > 0, F.coalesce(F.col("total_crawled"), F.lit(0)) / d).otherwise(F.lit(0.0)),
        )
    return out
