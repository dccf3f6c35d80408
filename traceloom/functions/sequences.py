"""Column expressions over activity sequences and activity sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successions(activities: Column) -> Column:
    """Adjacent pairs of a sequence, as an array of (src, dst)."""
    pairs = F.greatest(F.size(activities) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(activities, F.lit(1), pairs).alias("src"),
        F.slice(activities, F.lit(2), pairs).alias("dst"),
    )


def set_label(members: Column) -> Column:
    """Names joined by `+`. Separators inside names are escaped, so labels tell sets apart."""
    return F.concat_ws("+", F.transform(members, lambda x: F.regexp_replace(x, r"([\\+>])", r"\\$1")))


def place_label(a_set: Column, b_set: Column) -> Column:
    return F.concat(set_label(a_set), F.lit(">"), set_label(b_set))


def chunks(activities: Column, size: int) -> Column:
    """Cut a sequence into consecutive pieces of at most `size` elements."""
    last = F.greatest(F.ceil(F.size(activities) / size), F.lit(1)).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.slice(activities, i * size + 1, F.lit(size)),
    )
