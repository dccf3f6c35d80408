"""Joins of a large table with one that is usually, but not surely, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom import session


def fits(rows: int, row_bytes: int = 200) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * row_bytes <= session.BROADCAST_BYTES


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    small_rows: int,
    how: str = "inner",
    row_bytes: int = 200,
) -> DataFrame:
    """Join (inner, or left in any form) where many rows of `large` may have the same key.

    `small` is broadcast if its counted rows of about `row_bytes` bytes stay
    below the bound. Otherwise both sides are shuffled once and neither is
    repeated: a partition that a hot key fills is split when the sizes are known
    (`spark.sql.adaptive.skewJoin`).
    """
    if fits(small_rows, row_bytes):
        return large.join(F.broadcast(small), keys, how)
    return large.join(small.hint("merge"), keys, how)
