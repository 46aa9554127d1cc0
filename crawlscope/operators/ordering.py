"""Ordering helpers: row numbers inside huge groups, result sorting.

``sequence_within_groups`` numbers rows 1..n per group in a total order
without putting a whole group into one task: rows are range-partitioned on
(group, order) so a hot group spans many partitions, each partition is
sorted locally, and a small per-(group, partition) count table gives every
partition its offset. The count table has at most one row per group and
partition; it is joined back by broadcast only when its size is checked
to be small, otherwise by a shuffled join. The numbered rows are written
once (reliable checkpoint) because they are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import broadcast_if_small

# --- fixed values -----------------------------------------------------------
# Sort keys of the result table, in menu order.
RESULT_SORT_KEYS = ["status", "http_status_code", "depth", "links_found", "has_form", "load_time_ms",
                    "page_size", "last_modified", "url"]
# ---------------------------------------------------------------------------


def sequence_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[Column | str],
                           out_col: str = "seq", num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based row number per group in ``order_cols`` order."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = (
        df.repartitionByRange(n, *[F.col(g) for g in group_cols], *orders)
        .sortWithinPartitions(*[F.col(g) for g in group_cols], *orders)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    # read twice (counts and rows): written once, so both see the same
    # partition ids even when the upstream order is not deterministic
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy(*group_cols, "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first")
    )
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = ranged.join(broadcast_if_small(offsets.select(*group_cols, "_pid", "_offset", "_first")),
                         [*group_cols, "_pid"])
    return joined.withColumn(out_col, (F.col("_offset") + F.col("_mono") - F.col("_first") + 1).cast("bigint")).drop(
        "_pid", "_mono", "_offset", "_first")


def sort_results(df: DataFrame, key: str = "url", descending: bool = False) -> DataFrame:
    """SRT1: sort by one of the result keys; empty values last ascending and
    first descending (the whole key is reversed); url breaks ties."""
    if key not in RESULT_SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}")
    c = F.col(key)
    if key in ("status", "last_modified", "url"):
        empty = (F.coalesce(c, F.lit("")) == "")
    else:
        empty = F.lit(False)
    if descending:
        return df.orderBy(empty.desc(), c.desc(), F.col("url").desc())
    return df.orderBy(empty.asc(), c.asc(), F.col("url").asc())
