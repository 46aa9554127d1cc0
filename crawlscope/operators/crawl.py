"""G1: click depth and reachability over stored links (breadth-first).

Level-synchronous BFS for all sites at once. Before the loop the two large
inputs are hash-partitioned once on their join keys and checkpointed with
adaptive execution off for that write, which keeps their partitioning (a test
looks at the plan), so every level shuffles only its frontier:

* ``fetches`` by (site, url) - the stored fetch result of each page,
* ``links`` by (site, source_url) - the links found on each page.

Per level: robots test (J2) -> join with fetches -> status (FLT1) -> gate
(HTML5) -> join with links -> first discovery per target (W4, an aggregate)
-> anti join with the seen set -> next frontier. Each level's expanded links
(read three times: counts, file links, next frontier; written once so the
link table is scanned once per level) and next frontier are written with a
reliable ``checkpoint()`` to the session's checkpoint folder, so the plan
never grows and a lost executor only recomputes within one level. The loop ends on an empty frontier or after
``max_depth`` levels; the only driver-side work is one count per level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import urls as U
from ..session import checkpoint_by_key, ensure_checkpoint_dir
from .links import is_link_extractable
from .robots import allowed, prepare_rules

# --- fixed values -----------------------------------------------------------
DEFAULT_MAX_DEPTH = 10
ROBOTS_MESSAGE = "robots.txt disallowed"
# The seen set is a union of checkpointed levels, compacted into one
# checkpoint after this many parts so the anti join's plan stays small.
SEEN_COMPACT_EVERY = 8
# ---------------------------------------------------------------------------

RESULT_COLUMNS = [
    "site", "url", "status", "http_status_code", "content_type", "depth", "parent_url", "load_time_ms",
    "page_size", "last_modified", "error_message", "redirect_url", "links_found",
]


@dataclass
class CrawlOutput:
    results: DataFrame      # one row per discovered page URL (page_result)
    file_links: DataFrame   # (site, url, first_source) for file targets
    links: DataFrame        # links of expanded pages with the source depth


def bfs_crawl(sites: DataFrame, fetches: DataFrame, links: DataFrame, rules: DataFrame | None = None,
              seeds: DataFrame | None = None, max_depth: int = DEFAULT_MAX_DEPTH) -> CrawlOutput:
    """Breadth-first crawl over a stored fetch log.

    sites:   (site, site_scheme, start_url)
    fetches: (site, url, http_status_code, redirect_url, content_type,
              error_message, load_time_ms, page_size, last_modified)
    links:   (site, source_url, position, target_url, link_text)
    rules:   robots rule table (SRC5) or None to ignore robots
    seeds:   (site, url) seed URLs entering at depth 1, or None
    """
    spark = sites.sparkSession
    ensure_checkpoint_dir(spark)
    scheme = sites.select("site", "site_scheme")
    fetch_cols = ["http_status_code", "redirect_url", "content_type", "error_message", "load_time_ms",
                  "page_size", "last_modified"]
    f = fetches.drop("site_scheme").join(scheme, "site").select(
        "site", U.full_normalize(F.col("url"), F.col("site"), F.col("site_scheme")).alias("url"), *fetch_cols)
    # one result for each URL of the crawl, however often the log has it
    f = f.groupBy("site", "url").agg(F.min(F.struct(*fetch_cols)).alias("_f")).select("site", "url", "_f.*")
    f = checkpoint_by_key(f, ["site", "url"])
    lk = links.drop("site_scheme", "target_norm").join(scheme, "site").select(
        "site", U.full_normalize(F.col("source_url"), F.col("site"), F.col("site_scheme")).alias("source_url"),
        "position", "target_url", "link_text",
        U.full_normalize(F.col("target_url"), F.col("site"), F.col("site_scheme")).alias("target_norm"),
    ).withColumn("target_is_file", U.is_file(F.col("target_norm")))
    lk = checkpoint_by_key(lk, ["site", "source_url"])

    frontier = sites.select(
        "site", U.full_normalize(F.col("start_url"), F.col("site"), F.col("site_scheme")).alias("url"),
        F.lit(0).alias("depth"), F.lit("").alias("parent_url"))
    if seeds is not None:
        from .sitemap import seed_intake
        taken = seed_intake(seeds, sites).select("site", "url", "depth", F.col("parent").alias("parent_url"))
        level1_seeds = taken.where(~U.is_file(F.col("url")))
    prepared_rules = prepare_rules(rules) if rules is not None else None
    frontier = frontier.checkpoint(eager=True)
    seen_parts = [checkpoint_by_key(frontier.select("site", "url"), ["site", "url"])]
    level_results: list[DataFrame] = []
    level_files: list[DataFrame] = []
    level_links: list[DataFrame] = []
    if seeds is not None:  # seeds that are files are recorded, not crawled
        level_files.append(taken.where(U.is_file(F.col("url"))).select(
            "site", "url", F.col("parent_url").alias("first_source"), F.lit(0).alias("source_depth"), F.lit(-1).alias("position")))

    def seen_set() -> DataFrame:
        out = seen_parts[0]
        for part in seen_parts[1:]:
            out = out.unionByName(part)
        return out

    for depth in range(max_depth + 1):
        if depth == 1 and seeds is not None:
            extra = level1_seeds.join(seen_set(), ["site", "url"], "left_anti")
            frontier = frontier.unionByName(extra).groupBy("site", "url", "depth").agg(
                F.min("parent_url").alias("parent_url")).checkpoint(eager=True)
            seen_parts.append(extra.select("site", "url").checkpoint(eager=True))
        if frontier.isEmpty():
            break
        if prepared_rules is not None:
            checked = allowed(frontier, prepared_rules, prepared=True)
        else:
            checked = frontier.withColumn("allowed", F.lit(True))
        fetched = checked.join(f, ["site", "url"], "left")
        # a disallowed page is never fetched: it keeps no fetch fields
        fetched = fetched.select("site", "url", "depth", "parent_url", "allowed", *[
            F.when(F.col("allowed"), F.col(c)).alias(c) for c in fetch_cols])
        status = (
            F.when(~F.col("allowed"), F.lit("skipped"))
            .when(F.col("http_status_code").isNull(), F.lit("pending"))
            .otherwise(S.page_status(F.col("http_status_code"), F.col("redirect_url"), F.col("error_message"),
                                     F.col("site")))
        )
        rows = fetched.select(
            "site", "url", status.alias("status"),
            F.coalesce("http_status_code", F.lit(0)).alias("http_status_code"),
            F.coalesce("content_type", F.lit("")).alias("content_type"),
            F.col("depth").cast("int").alias("depth"), "parent_url",
            F.coalesce("load_time_ms", F.lit(0.0)).alias("load_time_ms"),
            F.coalesce("page_size", F.lit(0)).cast("bigint").alias("page_size"),
            F.coalesce("last_modified", F.lit("")).alias("last_modified"),
            F.when(~F.col("allowed"), F.lit(ROBOTS_MESSAGE)).otherwise(
                F.coalesce("error_message", F.lit(""))).alias("error_message"),
            F.coalesce("redirect_url", F.lit("")).alias("redirect_url"),
        )
        gate = (
            F.col("status").isin("ok", "redirect", "error")
            & ~S.fetch_failed(F.col("http_status_code"), F.col("error_message"))
            & is_link_extractable(F.col("http_status_code"), F.col("content_type"), F.col("redirect_url"),
                                  F.col("site"))
        )
        # rows depend only on checkpointed inputs (frontier, fetch log) and the
        # broadcast rules, so they are recomputed cheaply instead of written
        rows = rows.withColumn("_expand", gate)
        expanded = rows.where("_expand").select("site", F.col("url").alias("source_url"),
                                                F.col("depth").alias("source_depth"))
        out = expanded.join(lk, ["site", "source_url"]).checkpoint(eager=True)
        counts = out.groupBy("site", F.col("source_url").alias("url")).agg(
            F.count(F.lit(1)).cast("bigint").alias("links_found"))
        level_results.append(rows.join(counts, ["site", "url"], "left").withColumn(
            "links_found", F.coalesce("links_found", F.lit(0)).cast("bigint")).drop("_expand"))
        level_links.append(out)
        level_files.append(out.where("target_is_file").select(
            "site", F.col("target_norm").alias("url"), F.col("source_url").alias("first_source"),
            "source_depth", "position"))
        first = out.where(~F.col("target_is_file")).groupBy("site", F.col("target_norm").alias("url")).agg(
            F.min_by("source_url", F.struct("source_url", "position")).alias("parent_url"))
        new = first.join(seen_set(), ["site", "url"], "left_anti").withColumn("depth", F.lit(depth + 1))
        if depth + 1 > max_depth:
            level_results.append(new.select(
                "site", "url", F.lit("max_depth").alias("status"), F.lit(0).alias("http_status_code"),
                F.lit("").alias("content_type"), F.col("depth").cast("int").alias("depth"), "parent_url",
                F.lit(0.0).alias("load_time_ms"), F.lit(0).cast("bigint").alias("page_size"),
                F.lit("").alias("last_modified"), F.lit("").alias("error_message"), F.lit("").alias("redirect_url"),
                F.lit(0).cast("bigint").alias("links_found"),
            ).checkpoint(eager=True))
            break
        frontier = new.select("site", "url", "depth", "parent_url").checkpoint(eager=True)
        seen_parts.append(checkpoint_by_key(frontier.select("site", "url"), ["site", "url"]))
        if len(seen_parts) >= SEEN_COMPACT_EVERY:
            seen_parts[:] = [checkpoint_by_key(seen_set(), ["site", "url"])]

    results = level_results[0]
    for r in level_results[1:]:
        results = results.unionByName(r)
    all_files = level_files[0] if level_files else None
    for fl in level_files[1:]:
        all_files = all_files.unionByName(fl)
    file_links = all_files.groupBy("site", "url").agg(
        F.min_by("first_source", F.struct("source_depth", "first_source", "position")).alias("first_source"))
    all_links = level_links[0]
    for lnk in level_links[1:]:
        all_links = all_links.unionByName(lnk)
    return CrawlOutput(results=results.select(*RESULT_COLUMNS), file_links=file_links, links=all_links)
