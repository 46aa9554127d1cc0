"""Join helpers with a checked broadcast side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows and bytes (as
# JSON text), checked over no more than one row above the bound.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 32 << 20


def has_at_most(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    width = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when it provably has at most ``max_rows`` rows and
    ``max_bytes`` bytes; otherwise ``df`` unchanged, so the planner picks a
    shuffled join (AQE may still demote it to a broadcast at run time, and
    splits skewed keys)."""
    if has_at_most(df, max_rows, max_bytes):
        return F.broadcast(df)
    return df
