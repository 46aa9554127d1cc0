"""Registered queries: request log, runs, history, schedules, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import runs as RU
from ..operators import stats as ST
from ..sources import fixtures as FX
from .catalog import query, with_

SQL_F8 = """
f8a AS (SELECT event_id, 'h' || CAST(user_id % 10 AS VARCHAR) || '.example' AS host, ts, event_type, value FROM events),
f8 AS (SELECT event_id, host, 'https://' || host || '/e/' || CAST(event_id AS VARCHAR) AS url, ts,
         CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'click' THEN 301 ELSE 200 END AS INTEGER) AS status_code,
         CASE WHEN event_type = 'click' THEN 'https://' || host || '/' ELSE '' END AS redirect_url, value AS elapsed_ms
       FROM f8a),
f9 AS (SELECT host || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, host, 'https://' || host || '/' AS start_url,
         min(ts) AS started_at, max(ts) AS ended_at, dayofmonth(CAST(ts AS DATE)) % 7 <> 0 AS completed
       FROM f8 GROUP BY host, CAST(ts AS DATE)),
f8r AS (SELECT f8.*, f9.run_id, f8.host AS site, status_code AS http_status_code, '' AS error_message, 0 AS depth,
          CASE WHEN redirect_url <> '' THEN 'redirect' WHEN status_code >= 400 THEN 'error' ELSE 'ok' END AS status
        FROM f8 JOIN f9 ON f9.host = f8.host AND f9.run_id = f8.host || '/' || CAST(CAST(f8.ts AS DATE) AS VARCHAR))"""

_COUNTERS = """
    CAST(count(*) AS BIGINT) AS total_crawled,
    CAST(count_if(redirect_url = '' AND http_status_code // 100 = 2) AS BIGINT) AS total_2xx,
    CAST(count_if(redirect_url <> '') + count_if(redirect_url = '' AND http_status_code // 100 = 3) AS BIGINT) AS total_3xx,
    CAST(count_if(redirect_url = '' AND http_status_code // 100 = 4) AS BIGINT) AS total_4xx,
    CAST(count_if(redirect_url = '' AND http_status_code // 100 = 5) AS BIGINT) AS total_5xx"""


def request_results(spark, d) -> DataFrame:
    """F8 requests as page results of their run (FLT1 status)."""
    log = FX.request_log(spark, d)
    runs = FX.runs(spark, d)
    rows = log.withColumn("run_id", F.concat_ws("/", "host", F.to_date("ts").cast("string"))).select(
        "run_id", F.col("host").alias("site"), "url", "ts", F.col("status_code").alias("http_status_code"),
        "redirect_url", F.lit("").alias("error_message"), F.lit(0).alias("depth"), "elapsed_ms")
    rows = P.with_status(rows)
    return rows.join(runs.select("run_id"), "run_id", "left_semi")


def run_counters(spark, d) -> DataFrame:
    c = ST.run_counters(request_results(spark, d), keys=("run_id",))
    return c.select("run_id", "total_crawled", "total_2xx", "total_3xx", "total_4xx", "total_5xx")


@query("agg9_run_duration", with_(SQL_F8) + """
, d AS (SELECT f9.run_id, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS secs,
           (SELECT count(*) FROM f8r WHERE f8r.run_id = f9.run_id) AS crawled FROM f9)
SELECT run_id, CAST(round(secs, 3) AS DECIMAL(18,3)) AS duration_seconds,
  CASE WHEN secs < 60 THEN CAST(CAST(round_even(secs, 0) AS BIGINT) AS VARCHAR) || 's'
       WHEN floor(secs / 60) < 60 THEN CAST(CAST(floor(secs / 60) AS BIGINT) AS VARCHAR) || 'm '
            || CAST(CAST(floor(secs % 60) AS BIGINT) AS VARCHAR) || 's'
       ELSE CAST(CAST(floor(floor(secs / 60) / 60) AS BIGINT) AS VARCHAR) || 'h '
            || CAST(CAST(floor(secs / 60) % 60 AS BIGINT) AS VARCHAR) || 'm' END AS duration_display,
  CAST(round(CASE WHEN secs > 0 THEN crawled / secs ELSE 0 END, 6) AS DECIMAL(18,6)) AS urls_per_second
FROM d""")
def agg9_run_duration(spark, d):
    """AGG9: duration, display text and crawl rate per run."""
    crawled = run_counters(spark, d).select("run_id", "total_crawled")
    out = ST.run_duration(FX.runs(spark, d), crawled)
    return out.select("run_id", F.round("duration_seconds", 3).cast("decimal(18,3)").alias("duration_seconds"),
                      "duration_display", F.round("urls_per_second", 6).cast("decimal(18,6)").alias("urls_per_second"))


@query("snk10_run_stats", with_(SQL_F8) + f"""
, c AS (SELECT run_id, {_COUNTERS} FROM f8r GROUP BY run_id)
SELECT f9.run_id, f9.completed,
  CAST(CASE WHEN completed THEN coalesce(c.total_crawled, 0) ELSE 0 END AS BIGINT) AS total_crawled,
  CAST(CASE WHEN completed THEN coalesce(c.total_2xx, 0) ELSE 0 END AS BIGINT) AS total_2xx,
  CAST(CASE WHEN completed THEN coalesce(c.total_3xx, 0) ELSE 0 END AS BIGINT) AS total_3xx,
  CAST(CASE WHEN completed THEN coalesce(c.total_4xx, 0) ELSE 0 END AS BIGINT) AS total_4xx,
  CAST(CASE WHEN completed THEN coalesce(c.total_5xx, 0) ELSE 0 END AS BIGINT) AS total_5xx
FROM f9 LEFT JOIN c USING (run_id)""")
def snk10_run_stats(spark, d):
    """SNK10 + J12 + AGG1: run rows with their counters; cancelled runs keep zeros."""
    out = RU.backfill_stats(FX.runs(spark, d), run_counters(spark, d))
    return out.select("run_id", "completed", "total_crawled", "total_2xx", "total_3xx", "total_4xx", "total_5xx")


@query("str8_completed_gate", with_(SQL_F8) + """
, sc AS (SELECT f8r.run_id, CAST(count(*) AS BIGINT) AS total_pages,
           CAST(count_if(NOT (http_status_code >= 400 OR status IN ('error', 'timeout')) OR status = 'redirect') AS BIGINT)
             AS clean_pages
         FROM f8r JOIN f9 USING (run_id) WHERE f9.completed GROUP BY f8r.run_id)
SELECT run_id, CAST(round_even(100.0 * clean_pages / total_pages, 0) AS INTEGER) AS score, total_pages, clean_pages FROM sc""")
def str8_completed_gate(spark, d):
    """STR8 + AGG3: site score only for completed runs."""
    rows = RU.completed_only(request_results(spark, d), FX.runs(spark, d)).withColumn("links_found", F.lit(0))
    return ST.site_score(rows, keys=("run_id",)).select("run_id", "score", "total_pages", "clean_pages")


SQL_HISTORY = """
hist AS (SELECT start_url AS url, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS ts_text,
           CASE WHEN dayofmonth(started_at) % 2 = 0 THEN '' ELSE 'crawler' END AS user_name FROM f9)"""


def history_entries(spark, d) -> DataFrame:
    """Run history JSON text per run; odd days carry a user, even days omit
    it and several other keys (parsed back with defaults)."""
    runs = FX.runs(spark, d)
    even = F.dayofmonth("started_at") % 2 == 0
    ts_text = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss")
    full = F.to_json(F.struct(F.col("start_url").alias("url"), ts_text.alias("timestamp"),
                              F.lit("crawler").alias("user"), F.lit(3).alias("max_depth"),
                              F.lit(True).alias("respect_robots")))
    sparse = F.to_json(F.struct(F.col("start_url").alias("url"), ts_text.alias("timestamp")))
    return runs.select(F.when(even, sparse).otherwise(full).alias("json"))


@query("src8_history", with_(SQL_F8, SQL_HISTORY) + """
SELECT url, ts_text AS timestamp, user_name AS "user", CAST(CASE WHEN user_name = '' THEN 10 ELSE 3 END AS BIGINT) AS max_depth,
  CAST(8 AS BIGINT) AS concurrency, CAST(30 AS BIGINT) AS timeout, false AS render, true AS respect_robots,
  '' AS user_agent, CAST(0 AS BIGINT) AS total_crawled FROM hist""")
def src8_history(spark, d):
    """SRC8: history entries parsed from JSON; missing keys get defaults."""
    h = RU.parse_history_json(history_entries(spark, d))
    return h.select("url", "timestamp", "user", "max_depth", "concurrency", "timeout", "render", "respect_robots",
                    "user_agent", "total_crawled")


@query("snk9_newest_history", with_(SQL_F8, SQL_HISTORY) + """
SELECT url, ts_text AS timestamp, CASE WHEN user_name = '' THEN 'unknown' ELSE user_name END AS "user"
FROM hist ORDER BY ts_text DESC, url LIMIT 50""")
def snk9_newest_history(spark, d):
    """SNK9 + W9: stamp missing users, keep the newest 50 entries (top-k)."""
    h = RU.parse_history_json(history_entries(spark, d))
    return RU.newest_entries(h).select("url", "timestamp", "user")


W8_RATE = 60


@query("w8_politeness", with_(SQL_F8) + f"""
, s AS (SELECT host, url, ts, row_number() OVER (PARTITION BY host ORDER BY ts, url) AS i, epoch_us(ts) / 1e6 AS t FROM f8),
k AS (SELECT *, (i - 1) * {60.0 / W8_RATE} + max(t - (i - 1) * {60.0 / W8_RATE}) OVER (PARTITION BY host ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS planned FROM s)
SELECT host, url, CAST(i AS BIGINT) AS request_no, CAST(round(planned, 3) AS DECIMAL(18,3)) AS planned_at,
  CAST(round(planned - t, 3) AS DECIMAL(18,3)) AS delay_s FROM k""")
def w8_politeness(spark, d):
    """Planned send time and delay per request at 60 requests/minute."""
    out = RU.politeness_schedule(FX.request_log(spark, d), W8_RATE)
    return out.select("host", "url", "request_no", F.round("planned_at", 3).cast("decimal(18,3)").alias("planned_at"),
                      F.round("delay_s", 3).cast("decimal(18,3)").alias("delay_s"))


def attempt_log(spark, d) -> DataFrame:
    """Attempts per URL: requests of one host within one minute are retries
    of the same URL; a 500 answer stands for a raised fetch."""
    log = FX.request_log(spark, d)
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/m/"), F.date_format("ts", "yyyyMMddHHmm"))
    w = Window.partitionBy("_u").orderBy("ts", "event_id")
    return log.withColumn("_u", url).select(
        F.col("_u").alias("url"), F.row_number().over(w).alias("attempt"),
        F.when(F.col("status_code") == 500, 0).otherwise(F.col("status_code")).alias("status_code"),
        F.when(F.col("status_code") == 500, F.lit("timed out")).otherwise(F.lit("")).alias("error_message"),
        "elapsed_ms")


@query("w10_final_attempt", with_(SQL_F8) + """
, a AS (SELECT 'https://' || host || '/m/' || strftime(ts, '%Y%m%d%H%M') AS url, ts, event_id,
          CASE WHEN status_code = 500 THEN 0 ELSE status_code END AS status_code,
          CASE WHEN status_code = 500 THEN 'timed out' ELSE '' END AS error_message, elapsed_ms FROM f8)
SELECT url, CAST(count(*) AS BIGINT) AS attempts, arg_max(status_code, (ts, event_id)) AS status_code,
  arg_max(error_message, (ts, event_id)) AS error_message,
  CAST(round(sum(elapsed_ms) + count(*) * (count(*) - 1) * 1000.0, 6) AS DECIMAL(18,6)) AS load_time_ms
FROM a GROUP BY url""")
def w10_final_attempt(spark, d):
    """Final attempt per URL and load time over all attempts and waits."""
    out = RU.final_attempts(attempt_log(spark, d))
    return out.select("url", "attempts", "status_code", "error_message",
                      F.round("load_time_ms", 6).cast("decimal(18,6)").alias("load_time_ms"))


@query("flt14_all_redirected", with_(SQL_F8) + f"""
, c AS (SELECT host, date_trunc('hour', ts) AS hour, {_COUNTERS} FROM f8r GROUP BY host, date_trunc('hour', ts))
SELECT host, hour, total_3xx FROM c WHERE total_2xx = 0 AND total_3xx > 0""")
def flt14_all_redirected(spark, d):
    """FLT14 + AGG1: (host, hour) runs that got only redirects."""
    rows = request_results(spark, d).withColumn("hour", F.date_trunc("hour", "ts")).withColumn("host", F.col("site"))
    c = ST.run_counters(rows, keys=("host", "hour"))
    return ST.all_redirected(c).select("host", "hour", "total_3xx")


@query("agg13_redirect_cause", with_(SQL_F8) + """
, c AS (SELECT host, date_trunc('hour', ts) AS hour, CAST(count_if(status = 'redirect') AS BIGINT) AS redirected,
          count_if(http_status_code = 200) AS ok_200 FROM f8r GROUP BY host, date_trunc('hour', ts))
SELECT host, hour, redirected FROM c WHERE redirected > 0 AND ok_200 = 0""")
def agg13_redirect_cause(spark, d):
    """AGG13: redirect count of (host, hour) runs without any 200 page."""
    rows = request_results(spark, d).withColumn("hour", F.date_trunc("hour", "ts")).withColumn("host", F.col("site"))
    return ST.redirect_cause(rows, keys=("host", "hour"))


STR6_LIMIT = 60


@query("str6_rate_audit", with_(SQL_F8) + f"""
SELECT host, date_trunc('minute', ts) AS window_start, CAST(count(*) AS BIGINT) AS requests,
  count(*) > {STR6_LIMIT} AS over_limit FROM f8 GROUP BY host, date_trunc('minute', ts)""")
def str6_rate_audit(spark, d):
    """STR6 (batch twin): requests per host per one-minute tumbling window
    against the 60/minute limit."""
    from ..streaming import live
    return live.rate_audit(FX.request_log(spark, d), STR6_LIMIT)
