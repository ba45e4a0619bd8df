"""Tables that outlive executors, and joins whose broadcast side is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.session import dropped, saved, scratch

__all__ = ["BROADCAST_ROWS", "checked_broadcast", "dropped", "saved", "scratch"]

#: A side of at most this many narrow rows (about 64 MB) may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has few enough rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
