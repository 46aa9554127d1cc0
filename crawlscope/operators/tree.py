"""Page tree from parent links, filtered views and duplicate redirects."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..functions import urls as U
from ..session import ensure_checkpoint_dir, written_round
from .ordering import sequence_within_groups


def redirect_to_known(results: DataFrame) -> DataFrame:
    """``dup_redirect`` = internal redirect whose target (fragment dropped)
    differs from its own URL and whose canonical form is a known URL of the
    site (the row itself included)."""
    target = F.split_part(F.coalesce(F.col("redirect_url"), F.lit("")), F.lit("#"), F.lit(1))
    cand = results.where((F.col("status") == "redirect")).select(
        "site", "url", U.normalize(target).alias("_canon"), target.alias("_target"))
    cand = cand.where((F.col("_target") != "") & (F.col("_target") != F.col("url")))
    known = results.select("site", U.normalize(F.col("url")).alias("_canon")).distinct()
    dup = cand.join(known, ["site", "_canon"], "left_semi").select("site", "url", F.lit(True).alias("_dup"))
    out = results.join(dup, ["site", "url"], "left")
    return out.withColumn("dup_redirect", F.coalesce(F.col("_dup"), F.lit(False))).drop("_dup")


def parent_child(results: DataFrame) -> DataFrame:
    """Each row with its parent's status and depth (self join on parent)."""
    p = results.select("site", F.col("url").alias("parent_url"), F.col("status").alias("parent_status"),
                       F.col("depth").alias("parent_depth"))
    return results.join(p, ["site", "parent_url"], "left")


def choose_roots(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Root per site: the exact start URL, else a URL with the same canonical
    form, else the smallest URL without parent, else the smallest URL."""
    r = results.select("site", "url", "parent_url").join(sites.select("site", "start_url"), "site")
    rank = (
        F.when(F.col("url") == F.col("start_url"), 0)
        .when(U.normalize(F.col("url")) == U.normalize(F.col("start_url")), 1)
        .when(F.coalesce(F.col("parent_url"), F.lit("")) == "", 2)
        .otherwise(3)
    )
    return r.groupBy("site").agg(F.min_by("url", F.struct(rank, F.col("url"))).alias("root_url"))


def _rounds(state: DataFrame, step, still_open: Column) -> Iterator[tuple[DataFrame, int]]:
    """state, step(state), step(step(state)), ... as written tables, each with its number of open rows."""
    while True:
        state = written_round(state)
        yield state, state.where(still_open).count()
        state = step(state)


def page_tree(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Nodes that reach the root over parent links: (site, url, parent_url, level).

    Pointer doubling: every node points to its parent, and in each round to
    where that points, so a tree of depth d takes log2(d) rounds, however long
    its chains are. A node that has reached the root leaves the rounds (else
    the root would be the key of all rows); a node above no root (an orphan or
    a cycle) is dropped. Of a repeated URL the row of the least (depth, parent)
    counts."""
    ensure_checkpoint_dir(results.sparkSession)
    own = results.groupBy("site", "url").agg(F.min_by(F.coalesce("parent_url", F.lit("")), F.struct("depth", F.coalesce("parent_url", F.lit("")))).alias("parent_url"))
    rooted = own.join(choose_roots(results, sites), "site")
    is_root = F.col("url") == F.col("root_url")
    start = rooted.select(
        "site", "url", F.when(is_root, "").otherwise(F.col("parent_url")).alias("parent_url"),
        F.when(is_root, F.col("url")).otherwise(F.col("parent_url")).alias("ptr"), F.when(is_root, 0).otherwise(1).alias("level"),
        (is_root | (F.col("parent_url") == F.col("root_url"))).alias("at_root")).where("ptr <> ''")

    def step(state: DataFrame) -> DataFrame:
        there = state.select("site", F.col("url").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("level").alias("_level"), F.col("at_root").alias("_at_root"))
        moved = state.where(~F.col("at_root")).join(there, ["site", "ptr"]).select(
            "site", "url", "parent_url", F.col("_ptr").alias("ptr"), (F.col("level") + F.col("_level")).alias("level"), F.col("_at_root").alias("at_root"))
        return state.where("at_root").unionByName(moved)

    before = -1
    for state, arrived in _rounds(start, step, F.col("at_root")):
        # depths have no gaps: a round in which nothing arrived is the last one
        if arrived == before:
            return state.where("at_root").select("site", "url", "parent_url", "level")
        before = arrived


def _pointers(tree: DataFrame) -> DataFrame:
    return tree.select("site", "url", F.col("parent_url").alias("ptr")).where("ptr <> ''")


def with_ancestors(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (site, url) and all nodes above them in the tree, each once.

    Pointers of 1, 2, 4, ... steps: with each the set grows by where its
    members point. A distance is a sum of different powers of two, so every
    ancestor is met within log2(depth) rounds."""
    ensure_checkpoint_dir(tree.sparkSession)

    def step(pointers: DataFrame) -> DataFrame:
        there = pointers.select("site", F.col("url").alias("ptr"), F.col("ptr").alias("_ptr"))
        return pointers.join(there, ["site", "ptr"]).select("site", "url", F.col("_ptr").alias("ptr"))

    reached = nodes.select("site", "url").distinct()
    for pointers, left in _rounds(_pointers(tree), step, F.lit(True)):
        if not left:
            return reached
        above = reached.join(pointers, ["site", "url"]).select("site", F.col("ptr").alias("url"))
        reached = written_round(reached.unionByName(above).distinct())


def with_paths(tree: DataFrame) -> DataFrame:
    """The tree with ``path``, the URLs from the root to each node, doubled in
    length each round. The paths of a chain are as large as its square: ask for
    them only where they are needed."""
    ensure_checkpoint_dir(tree.sparkSession)

    def step(state: DataFrame) -> DataFrame:
        there = state.select("site", F.col("url").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("path").alias("_path"))
        moved = state.where("ptr <> ''").join(there, ["site", "ptr"]).select("site", "url", "parent_url", "level", F.col("_ptr").alias("ptr"), F.concat("_path", "path").alias("path"))
        return state.where("ptr = ''").unionByName(moved)

    start = tree.select("site", "url", "parent_url", "level", F.col("parent_url").alias("ptr"), F.array("url").alias("path"))
    for state, left in _rounds(start, step, F.col("ptr") != ""):
        if not left:
            return state.drop("ptr")


def sibling_order(tree: DataFrame) -> DataFrame:
    """Position of each node among its siblings (alphabetical)."""
    return sequence_within_groups(tree, ["site", "parent_url"], ["url"], out_col="sibling_pos")


def tree_match(results: DataFrame, text: str) -> Column:
    """FLT8: text in URL, code or status value (case-insensitive)."""
    s = text.lower()
    return (F.lower("url").contains(s) | F.col("http_status_code").cast("string").contains(s)
            | F.lower("status").contains(s))


def visible_with_ancestors(tree: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Nodes matching FLT8 (duplicate redirects excluded) plus all their
    ancestors; the root is shown whenever anything matches."""
    flagged = redirect_to_known(results).select("site", "url", "status", "http_status_code", "dup_redirect")
    t = tree.join(flagged, ["site", "url"])
    matches = t.where(~F.col("dup_redirect") & tree_match(results, text))
    # a match has the root above it, so the root comes with it
    return with_ancestors(tree, matches)


def result_search(results: DataFrame, text: str = "", only_errors: bool = False) -> DataFrame:
    """FLT7: rows shown in the result table: optional errors-only, duplicate
    redirects hidden, text in URL, status label or code; ``form`` also
    matches pages with a form."""
    out = redirect_to_known(results).where(~F.col("dup_redirect"))
    if only_errors:
        out = out.where(S.is_error(F.col("status"), F.col("http_status_code")))
    if text:
        s = text.lower()
        cond = (F.lower("url").contains(s) | F.lower(S.status_label(F.col("status"))).contains(s)
                | F.col("http_status_code").cast("string").contains(s))
        if s == "form":
            cond = cond | F.coalesce(F.col("has_form"), F.lit(False))
        out = out.where(cond)
    return out.drop("dup_redirect")
