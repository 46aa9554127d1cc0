"""Structured Streaming counterparts of the live crawl views.

The reference updates rows and counters as each fetch finishes. Here a
fetch log arrives as a stream of files and each live view is a streaming
query: windowed counts with a watermark (STR6, STR7), keyed counters in
update/complete mode (STR2), de-duplication within a watermark (STR3), an
append-only result log whose latest row per URL is the live table (STR1),
and a keyed state processor that holds referrers until their target is
fetched (STR4). Checkpoints live under the session's checkpoint folder.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import status as S
from ..operators.links import MAX_REFERRERS
from ..session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The ``events`` table read as a file stream."""
    return (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))


def request_stream(events: DataFrame) -> DataFrame:
    """F8 request log over an event stream (host, url, ts, status_code, redirect_url)."""
    host = F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"), F.lit(".example"))
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 301).otherwise(200)
    return events.select(
        "event_id", host.alias("host"),
        F.concat(F.lit("https://"), host, F.lit("/e/"), F.col("event_id").cast("string")).alias("url"), "ts",
        code.cast("int").alias("status_code"),
        F.when(code == 301, F.concat(F.lit("https://"), host, F.lit("/"))).otherwise(F.lit("")).alias("redirect_url"),
        F.col("value").alias("elapsed_ms"))


def run_to_table(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over everything available into files of the
    shared folder, one folder a micro-batch (written anew if a batch is
    repeated), and return its table. In ``update`` mode that is the last row
    for each of ``keys``: the state store holds only open windows or keys, and
    nothing goes through the driver."""
    spark = df.sparkSession
    path = _scratch(spark, "stream-table")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch_id=-1")
    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", _scratch(spark, "stream"))
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    if mode == "append":
        return rows.drop("batch_id")
    return latest_rows(rows, keys, ["batch_id"]).select(*[c for c in rows.columns if c != "batch_id"])


# --- STR6 / STR7: windows ---------------------------------------------------

def rate_audit(requests: DataFrame, limit: int = 60, window: str = "1 minute", slide: str | None = None) -> DataFrame:
    """STR6: requests per host and window against the per-minute limit
    (tumbling by default; ``slide`` gives the sliding variant)."""
    w = F.window("ts", window) if slide is None else F.window("ts", window, slide)
    agg = requests.groupBy("host", w.alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
    return agg.select("host", F.col("w.start").alias("window_start"), "requests",
                      (F.col("requests") > limit).alias("over_limit"))


def window_counters(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """STR7 input: 2xx and 3xx answers per host and window."""
    redirected = F.col("redirect_url") != ""
    cls = F.floor(F.col("status_code") / 100)
    return requests.groupBy("host", F.window("ts", window).alias("w")).agg(
        F.count_if(~redirected & (cls == 2)).cast("bigint").alias("total_2xx"),
        (F.count_if(redirected) + F.count_if(~redirected & (cls == 3))).cast("bigint").alias("total_3xx"),
    ).select("host", F.col("w.start").alias("hour"), "total_2xx", "total_3xx")


def block_alarm(counters: DataFrame) -> DataFrame:
    """STR7: windows that got only redirects (FLT14 per window)."""
    return counters.where((F.col("total_2xx") == 0) & (F.col("total_3xx") > 0)).select("host", "hour", "total_3xx")


# --- STR2: live counters ----------------------------------------------------

def live_counters(requests: DataFrame) -> DataFrame:
    """STR2: AGG1 counters per host, maintained in update/complete mode."""
    redirected = F.col("redirect_url") != ""
    cls = F.floor(F.col("status_code") / 100)
    return requests.groupBy("host").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_crawled"),
        F.count_if(~redirected & (cls == 2)).cast("bigint").alias("total_2xx"),
        (F.count_if(redirected) + F.count_if(~redirected & (cls == 3))).cast("bigint").alias("total_3xx"),
        F.count_if(~redirected & (cls == 4)).cast("bigint").alias("total_4xx"),
        F.count_if(~redirected & (cls == 5)).cast("bigint").alias("total_5xx"),
    )


# --- STR3: discovery de-dup -------------------------------------------------

def dedup_discoveries(discoveries: DataFrame) -> DataFrame:
    """STR3: the first discovery of each (host, url). Seen URLs are never
    forgotten: the state store holds one key for each, spread over all tasks."""
    return discoveries.dropDuplicates(["host", "url"])


# --- UDF1: result callback --------------------------------------------------

def for_each_result_batch(results: DataFrame, user_fn, checkpoint: str | None = None, available_now: bool = True):
    """UDF1: call ``user_fn(batch_df, batch_id)`` for every micro-batch of
    results (the reference's per-result callback, batched). Returns the query."""
    spark = results.sparkSession
    writer = results.writeStream.foreachBatch(user_fn).option(
        "checkpointLocation", checkpoint or _scratch(spark, "callback"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# --- STR1: live page state --------------------------------------------------

def append_result_log(results: DataFrame, path: str) -> DataFrame:
    """STR1 sink: every micro-batch is appended to a result log with its batch
    id; the live table is ``latest_rows`` over that log (W12)."""
    spark = results.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    for_each_result_batch(results, write, _scratch(spark, "result-log")).awaitTermination()
    return spark.read.parquet(path)


def latest_rows(log: DataFrame, keys=("host", "url"), order=("batch_id", "ts")) -> DataFrame:
    """Latest row per key of a result log (an aggregate, no sort of a
    whole key group)."""
    cols = [c for c in log.columns if c not in keys]
    agg = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return agg.select(*keys, "_r.*")


# --- STR4: referrer buffer --------------------------------------------------

REFERRER_OUT = "target STRING, source_url STRING, link_text STRING, micros BIGINT"
# the targets of a bucket; of each whether it was fetched and how many sources it holds; these sources, one target after the other
REFERRER_STATE = "targets ARRAY<STRING>, fetched ARRAY<BOOLEAN>, held ARRAY<INT>, sources ARRAY<STRING>, texts ARRAY<STRING>, micros ARRAY<BIGINT>"
# stands for a missing time, sorts after all others
NO_TIME = (1 << 63) - 1


def _first_links(links: pd.DataFrame) -> pd.DataFrame:
    """The first links of different sources, at most as many as are kept for a target."""
    links = links.sort_values(["micros", "source_url"], kind="stable").drop_duplicates(["target", "source_url"])
    return links.groupby("target", dropna=False, sort=False).head(MAX_REFERRERS)


def _referrer_state(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known: dict[str | None, tuple[bool, list[tuple]]] = {}
    if state.exists:
        targets, fetched, held, sources, texts, micros = state.get
        rows = iter(zip(sources, texts, micros))
        known = {t: (f, list(itertools.islice(rows, n))) for t, f, n in zip(targets, fetched, held)}
    pages, links = set(), []
    for pdf in pdfs:
        is_page = pdf["kind"] == "page"
        pages.update(pdf["target"][is_page])
        links.append(_first_links(pdf[~is_page]))
    fresh: dict[str | None, list[tuple]] = {t: [] for t in pages}
    found = _first_links(pd.concat(links))
    for t, *link in zip(found["target"], found["source_url"], found["link_text"], found["micros"].tolist()):
        fresh.setdefault(t, []).append(tuple(link))
    out = []
    for t, new in fresh.items():
        was_fetched, old = known.get(t, (False, []))
        seen = {s for s, _, _ in old}
        new = [link for link in new if link[0] not in seen][: MAX_REFERRERS - len(old)]
        known[t] = (was_fetched or t in pages, old + new)
        if known[t][0]:
            out.extend((t, *link) for link in (new if was_fetched else old + new))
    links_of = [link for _, each in known.values() for link in each]
    state.update(([*known], [f for f, _ in known.values()], [len(each) for _, each in known.values()], *([link[k] for link in links_of] for k in range(3))))
    if out:
        yield pd.DataFrame(out, columns=["target", "source_url", "link_text", "micros"])


# Parts of each target: a hot target (every page links the home page) is
# spread over so many tasks. Page events are copied to every salt.
REFERRER_SALTS = 2
# State keys per salt. A key holds the targets that hash to it, because each key
# costs some milliseconds of Python a micro-batch, as a call for one target would.
REFERRER_BUCKETS = 2048


def referrer_buffer(events: DataFrame, salts: int = REFERRER_SALTS, buckets: int = REFERRER_BUCKETS) -> DataFrame:
    """STR4: ``events`` has (target, kind 'link'|'page', source_url,
    link_text, ts). Links seen before their target is fetched are held in
    keyed state and released when the page arrives, however late; later links
    pass straight through. State holds at most 50 sources for each target and
    salt, and grows with the number of targets.

    The state key is (bucket, salt) with bucket = hash(target) mod ``buckets``
    and salt = hash(source) mod ``salts``: with ``salts > 1`` a hot target is
    spread over that many tasks, each keeping its first 50 distinct sources,
    and page events go to every salt of their target. The union of the per-salt
    lists contains the target's first 50 sources; ``cap_referrers`` keeps
    exactly those. A micro-batch writes the buckets anew that it touches: more
    targets want more buckets."""
    keyed = _salted(events, salts).select(
        F.pmod(F.xxhash64("target"), F.lit(buckets)).alias("bucket"), "salt", "target", "kind", "source_url", "link_text",
        F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("micros"))
    released = keyed.groupBy("bucket", "salt").applyInPandasWithState(
        _referrer_state, REFERRER_OUT, REFERRER_STATE, "append", GroupStateTimeout.NoTimeout)
    return released.select("target", "source_url", "link_text", F.timestamp_micros(F.nullif("micros", F.lit(NO_TIME))).alias("ts"))


def _salted(events: DataFrame, salts: int) -> DataFrame:
    pages = events.where(F.col("kind") == "page").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    links = events.where(F.col("kind") != "page").withColumn("salt", F.pmod(F.xxhash64("source_url"), F.lit(salts)))
    return pages.unionByName(links)


def cap_referrers(released: DataFrame, limit: int = MAX_REFERRERS) -> DataFrame:
    """Final per-target cap over the released rows of all salts: the first
    ``limit`` sources by (ts, source). Planned as a window group limit, so each
    map task passes at most ``limit`` rows per target to the shuffle."""
    w = Window.partitionBy("target").orderBy("ts", "source_url")
    return released.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= limit).drop("_rk")


def link_and_page_events(requests: DataFrame) -> DataFrame:
    """STR4 input from the request log: every request is a page fetch of its
    URL; it links the host's home page (a hot target) and the URL of the next
    event id (link text = event type)."""
    page = requests.select(F.col("url").alias("target"), F.lit("page").alias("kind"),
                           F.lit("").alias("source_url"), F.lit("").alias("link_text"), "ts")
    home = requests.select(F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("target"), F.lit("link").alias("kind"),
                           F.col("url").alias("source_url"), F.lit("home").alias("link_text"), "ts")
    nxt = requests.select(
        F.concat(F.lit("https://"), F.col("host"), F.lit("/e/"), (F.col("event_id") + 1).cast("string")).alias("target"),
        F.lit("link").alias("kind"), F.col("url").alias("source_url"), F.lit("next").alias("link_text"), "ts")
    return page.unionByName(home).unionByName(nxt)


def status_of_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("status", S.page_status(F.col("status_code"), F.col("redirect_url"), F.lit(""),
                                                       F.col("host")))


__all__ = [
    "Window", "append_result_log", "block_alarm", "dedup_discoveries", "event_stream", "latest_rows",
    "cap_referrers", "link_and_page_events", "live_counters", "rate_audit", "referrer_buffer", "request_stream", "run_to_table",
    "status_of_requests", "window_counters",
]
