"""Run history, run gates, request schedules and time-based page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from .ordering import sequence_within_groups

# --- fixed values -----------------------------------------------------------
MAX_HISTORY_ENTRIES = 50
DEFAULT_RATE_PER_MINUTE = 60
CACHE_TTL_DAYS = 14
HISTORY_DEFAULTS = {
    "url": "", "timestamp": "", "user": "", "max_depth": 10, "concurrency": 8, "timeout": 30, "render": False,
    "respect_robots": True, "user_agent": "", "total_crawled": 0, "total_2xx": 0, "total_3xx": 0, "total_4xx": 0,
    "total_5xx": 0,
}
# ---------------------------------------------------------------------------

HISTORY_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("user", T.StringType()), T.StructField("max_depth", T.LongType()),
    T.StructField("concurrency", T.LongType()), T.StructField("timeout", T.LongType()),
    T.StructField("render", T.BooleanType()), T.StructField("respect_robots", T.BooleanType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("cookies", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("total_crawled", T.LongType()), T.StructField("total_2xx", T.LongType()),
    T.StructField("total_3xx", T.LongType()), T.StructField("total_4xx", T.LongType()),
    T.StructField("total_5xx", T.LongType()),
])


def with_history_defaults(df: DataFrame) -> DataFrame:
    """Every missing key gets its default (unknown keys are ignored by the schema)."""
    cols = []
    for f in HISTORY_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name == "cookies":
            cols.append(F.coalesce(c, F.array().cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.coalesce(c, F.lit(HISTORY_DEFAULTS[f.name]).cast(f.dataType)).alias(f.name))
    extra = [c for c in df.columns if c not in HISTORY_SCHEMA.fieldNames()]
    return df.select(*extra, *cols)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: a JSON array of run entries; broken or non-array files give no
    rows (PERMISSIVE parse, corrupt records dropped)."""
    df = (spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path))
    return with_history_defaults(df)


def parse_history_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """SRC8 over JSON text held in a column: one entry per row."""
    parsed = df.select("*", F.from_json(F.col(json_col), HISTORY_SCHEMA).alias("_e")).where(F.col("_e").isNotNull())
    return with_history_defaults(parsed.select(*[c for c in df.columns if c != json_col], "_e.*"))


def newest_entries(history: DataFrame, max_entries: int = MAX_HISTORY_ENTRIES, user: str = "unknown",
                   now: Column | None = None) -> DataFrame:
    """SNK9 + W9: stamp missing timestamp/user, keep the newest ``max_entries``
    (a top-k: each partition keeps its best k, then one merge)."""
    now = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    stamped = history.withColumn("timestamp", F.when(F.col("timestamp") == "", now).otherwise(F.col("timestamp")))
    stamped = stamped.withColumn("user", F.when(F.col("user") == "", F.lit(user)).otherwise(F.col("user")))
    return stamped.orderBy(F.col("timestamp").desc(), F.col("url")).limit(max_entries)


def backfill_stats(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """SNK10 + J12: completed runs receive their five counters; cancelled
    runs keep zeros."""
    cols = ["total_crawled", "total_2xx", "total_3xx", "total_4xx", "total_5xx"]
    s = stats.select("run_id", *[F.col(c).alias(f"_s_{c}") for c in cols])
    out = runs.join(s, "run_id", "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("completed"), F.coalesce(F.col(f"_s_{c}"), F.lit(0))).otherwise(
            F.lit(0)).cast("bigint")).drop(f"_s_{c}")
    return out


def completed_only(df: DataFrame, runs: DataFrame) -> DataFrame:
    """STR8: rows of completed runs only (a cancelled run keeps its rows but
    yields no score, counters or summary)."""
    return df.join(runs.where("completed").select("run_id"), "run_id", "left_semi")


def politeness_schedule(requests: DataFrame, rate_per_minute: float = DEFAULT_RATE_PER_MINUTE,
                        key: str = "host", chunk_rows: int = 100_000) -> DataFrame:
    """Planned send time per request: slot = max(t, previous slot + 60/rate),
    no burst after a pause; rate <= 0 means no waiting.

    Closed form: slot_i = i*d + max_{j<=i}(t_j - j*d). The running max is
    computed in bounded chunks: rows are numbered per host without a
    one-task sort, each chunk of ``chunk_rows`` rows takes a local running
    max, and a per-host prefix over the chunk maxima (one row per chunk)
    completes it."""
    t = (F.unix_micros(F.col("ts")) / F.lit(1e6)).cast("double")
    if rate_per_minute <= 0:
        return requests.withColumn("planned_at", t).withColumn("delay_s", F.lit(0.0))
    d = 60.0 / rate_per_minute
    seq = sequence_within_groups(requests, [key], ["ts", "url"], out_col="_i")
    i0 = F.col("_i") - 1
    seq = seq.withColumn("_t", t).withColumn("_k", F.col("_t") - i0 * F.lit(d)).withColumn(
        "_chunk", F.floor(i0 / F.lit(chunk_rows)))
    w_local = Window.partitionBy(key, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    seq = seq.withColumn("_local", F.max("_k").over(w_local))
    chunks = seq.groupBy(key, "_chunk").agg(F.max("_k").alias("_cmax"))
    w_prev = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_prefix", F.max("_cmax").over(w_prev)).drop("_cmax")
    out = seq.join(chunks, [key, "_chunk"], "left")
    best = F.greatest(F.col("_local"), F.coalesce(F.col("_prefix"), F.col("_local")))
    slot = i0 * F.lit(d) + best
    return out.withColumn("request_no", F.col("_i")).withColumn("planned_at", slot).withColumn(
        "delay_s", slot - F.col("_t")).drop("_i", "_t", "_k", "_chunk", "_local", "_prefix")


def final_attempts(attempts: DataFrame) -> DataFrame:
    """Last attempt per URL; load time spans all attempts plus the
    waits between them (2 s, 4 s, ... after attempt 1, 2, ...)."""
    agg = attempts.groupBy("url").agg(
        F.max_by(F.struct("status_code", "error_message"), F.col("attempt")).alias("last"),
        F.count(F.lit(1)).alias("attempts"),
        F.sum("elapsed_ms").alias("_elapsed"),
    )
    n = F.col("attempts")
    waits_ms = n * (n - 1) * F.lit(1000.0)
    return agg.select("url", F.col("attempts").cast("bigint").alias("attempts"),
                      F.col("last.status_code").alias("status_code"), F.col("last.error_message").alias("error_message"),
                      (F.col("_elapsed") + waits_ms).alias("load_time_ms"))


def last_modified_ts(raw: Column) -> Column:
    """DT1: RFC 1123 text to a timestamp (NULL when empty or unparseable)."""
    core = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^[A-Za-z]{3},\s*", "")
    core = F.regexp_replace(core, r"\s+(GMT|UTC)$", "")
    return F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss"))


def last_modified_display(raw: Column) -> Column:
    """DT1 display: ISO date, '' when empty, first 10 chars when unparseable."""
    ts = last_modified_ts(raw)
    r = F.coalesce(raw, F.lit(""))
    return F.when(r == "", F.lit("")).when(ts.isNull(), F.substring(r, 1, 10)).otherwise(
        F.date_format(ts, "yyyy-MM-dd"))


def content_age(results: DataFrame, as_of: str) -> DataFrame:
    """DT1: pages per site and age bucket of the Last-Modified date."""
    ts = last_modified_ts(F.col("last_modified"))
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date(ts))
    bucket = (F.when(ts.isNull(), F.lit("unknown")).when(days < 30, F.lit("<30d"))
              .when(days < 365, F.lit("<365d")).otherwise(F.lit(">=365d")))
    return results.groupBy("site", bucket.alias("age_bucket")).agg(F.count(F.lit(1)).cast("bigint").alias("pages"))


def gateway_intercepts(probes: DataFrame) -> DataFrame:
    """FLT13: start pages that were redirected to another registrable domain
    (probes: site, start_url, final_url, redirected; NULL final = no verdict)."""
    start = U.registrable_domain(U.url_part(F.col("start_url"), "netloc"))
    final = U.registrable_domain(U.url_part(F.col("final_url"), "netloc"))
    return probes.where(F.col("redirected") & F.col("final_url").isNotNull() & (start != final)).select(
        "site", "start_url", "final_url", start.alias("start_domain"), final.alias("final_domain"))


def validator(etag: Column, last_modified: Column, size: Column) -> Column:
    """FLT15 validator: ``etag:…`` else ``lm:…`` else ``len:…`` else ''."""
    e = F.coalesce(etag, F.lit(""))
    lm = F.coalesce(last_modified, F.lit(""))
    return (F.when(e != "", F.concat(F.lit("etag:"), e)).when(lm != "", F.concat(F.lit("lm:"), lm))
            .when(F.coalesce(size, F.lit(0)) > 0, F.concat(F.lit("len:"), size.cast("string"))).otherwise(F.lit("")))


def freshness(pages: DataFrame, cached: DataFrame, as_of: str, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    """FLT15: ``fresh`` per page given a cache table (url, cached_validator,
    cached_at): with both validators fresh iff equal, otherwise fresh iff the
    entry is at most ``ttl_days`` old; no cache entry = not fresh."""
    out = pages.join(cached, "url", "left")
    both = (F.col("validator") != "") & (F.coalesce(F.col("cached_validator"), F.lit("")) != "")
    age_ok = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("cached_at")) <= ttl_days * 86400
    fresh = F.when(F.col("cached_at").isNull(), F.lit(False)).when(
        both, F.col("validator") == F.col("cached_validator")).otherwise(age_ok)
    return out.withColumn("fresh", fresh)
