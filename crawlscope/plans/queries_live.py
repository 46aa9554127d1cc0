"""Registered queries: streaming live views and the exact-HTML mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact_html as X
from ..operators import links as L
from ..operators import pages as P
from ..session import ensure_checkpoint_dir, ship_package
from ..streaming import live as LV
from .catalog import ORACLE, SQL_F2, _pages, _tech_sql, query
from .queries_runs import SQL_F8, STR6_LIMIT
from .catalog import with_


@query("str6_rate_audit_stream")
def str6_rate_audit_stream(spark, d):
    """STR6 as a stream: one-minute tumbling windows per host over the events
    file stream (update mode: windows behind the watermark leave the state)."""
    reqs = LV.request_stream(LV.event_stream(spark, d)).withWatermark("ts", "10 minutes")
    return LV.run_to_table(LV.rate_audit(reqs, STR6_LIMIT), "update", ["host", "window_start"])


ORACLE["str6_rate_audit_stream"] = ORACLE["str6_rate_audit"]


@query("str7_block_alarm_stream", with_(SQL_F8) + """
, c AS (SELECT host, date_trunc('hour', ts) AS hour,
          CAST(count_if(redirect_url = '' AND status_code // 100 = 2) AS BIGINT) AS total_2xx,
          CAST(count_if(redirect_url <> '') + count_if(redirect_url = '' AND status_code // 100 = 3) AS BIGINT) AS total_3xx
        FROM f8 GROUP BY host, date_trunc('hour', ts))
SELECT host, hour, total_3xx FROM c WHERE total_2xx = 0 AND total_3xx > 0""")
def str7_block_alarm_stream(spark, d):
    """STR7: hourly windows per host with only redirects, from the stream."""
    reqs = LV.request_stream(LV.event_stream(spark, d)).withWatermark("ts", "2 hours")
    return LV.block_alarm(LV.run_to_table(LV.window_counters(reqs, "1 hour"), "update", ["host", "hour"]))


@query("str2_live_counters", with_(SQL_F8) + """
SELECT host, CAST(count(*) AS BIGINT) AS total_crawled,
  CAST(count_if(redirect_url = '' AND status_code // 100 = 2) AS BIGINT) AS total_2xx,
  CAST(count_if(redirect_url <> '') + count_if(redirect_url = '' AND status_code // 100 = 3) AS BIGINT) AS total_3xx,
  CAST(count_if(redirect_url = '' AND status_code // 100 = 4) AS BIGINT) AS total_4xx,
  CAST(count_if(redirect_url = '' AND status_code // 100 = 5) AS BIGINT) AS total_5xx
FROM f8 GROUP BY host""")
def str2_live_counters(spark, d):
    """STR2: live AGG1 counters per host maintained by a streaming aggregation."""
    reqs = LV.request_stream(LV.event_stream(spark, d))
    return LV.run_to_table(LV.live_counters(reqs), "update", ["host"])


@query("str3_stream_dedup", with_(SQL_F8) + """
SELECT DISTINCT host, 'https://' || host || '/m/' || strftime(ts, '%Y%m%d%H%M') AS url FROM f8""")
def str3_stream_dedup(spark, d):
    """STR3: discoveries of (host, minute page), each passed on once."""
    reqs = LV.request_stream(LV.event_stream(spark, d))
    disc = reqs.select("host", F.concat(F.lit("https://"), F.col("host"), F.lit("/m/"),
                                        F.date_format("ts", "yyyyMMddHHmm")).alias("url"), "ts", "event_id")
    return LV.run_to_table(LV.dedup_discoveries(disc).select("host", "url"), "append")


@query("str1_live_page_state", with_(SQL_F8) + """
SELECT host, url, status_code, redirect_url FROM f8""")
def str1_live_page_state(spark, d):
    """STR1 + W12 + UDF1: every micro-batch of results goes through the
    result callback (``foreachBatch``), which appends it to a log; the live
    table is the latest row per (host, URL)."""
    reqs = LV.request_stream(LV.event_stream(spark, d))
    path = f"{ensure_checkpoint_dir(spark)}/result-log-{__import__('uuid').uuid4().hex[:12]}"
    log = LV.append_result_log(reqs, path)
    return LV.latest_rows(log).select("host", "url", "status_code", "redirect_url")


@query("str4_referrer_buffer", with_(SQL_F8) + """
, links AS (SELECT 'https://' || host || '/' AS target, url AS source_url, 'home' AS link_text, ts FROM f8
            UNION ALL SELECT 'https://' || host || '/e/' || CAST(event_id + 1 AS VARCHAR), url, 'next', ts FROM f8),
firsts AS (SELECT target, source_url, arg_min(link_text, ts) AS link_text, min(ts) AS ts FROM links
           WHERE target IN (SELECT url FROM f8) GROUP BY target, source_url)
SELECT target, source_url, link_text, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, source_url) AS n FROM firsts) WHERE n <= 50""")
def str4_referrer_buffer(spark, d):
    """STR4: referrers held in keyed state (salted by source) until their
    target is fetched; at most the first 50 distinct sources per target."""
    ship_package(spark)
    events = LV.link_and_page_events(LV.request_stream(LV.event_stream(spark, d)))
    return LV.cap_referrers(LV.run_to_table(LV.referrer_buffer(events), "append"))


@query("udf2_exact_links")
def udf2_exact_links(spark, d):
    """UDF2: HTML1-HTML3 in exact-HTML mode (stdlib parser in mapInPandas)."""
    ship_package(spark)
    return X.extract_links_exact(P.stored_pages_as_fetches(_pages(spark, d)))


@query("udf3_links_udtf")
def udf3_links_udtf(spark, d):
    """UDF3: tags through the SQL table function ``link_candidates`` with LATERAL, links by columns."""
    ship_package(spark)
    X.register_udtf(spark)
    P.stored_pages_as_fetches(_pages(spark, d)).createOrReplaceTempView("crawlscope_pages")
    found = spark.sql("""
        SELECT p.site, p.site_scheme, p.url AS source_url, p.url AS base, l.*
        FROM crawlscope_pages p, LATERAL link_candidates(p.html) l""")
    return L.links_of_candidates(found)


ORACLE["udf2_exact_links"] = ORACLE["html1_links"]
ORACLE["udf3_links_udtf"] = ORACLE["html1_links"]


@query("udf2_exact_seo")
def udf2_exact_seo(spark, d):
    """UDF2: HTML7 in exact-HTML mode (stdlib parser in mapInPandas)."""
    ship_package(spark)
    return X.seo_exact(_pages(spark, d))


ORACLE["udf2_exact_seo"] = ORACLE["html7_seo"]


@query("udf2_exact_tech")
def udf2_exact_tech(spark, d):
    """UDF2: HTML8 in exact-HTML mode over the fixture fetch log."""
    ship_package(spark)
    from ..sources import fixtures as FX
    return X.tech_exact(FX.fetch_log(spark, d))


ORACLE["udf2_exact_tech"] = with_(SQL_F2) + f"SELECT url, {_tech_sql()} AS tech FROM f2"
