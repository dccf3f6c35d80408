"""Event tables as logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.schema import ALL


def event_log(
    table: DataFrame,
    case: Column | str,
    order: Sequence[str],
    activity: Column | str,
    model: Column | str | None = None,
) -> DataFrame:
    """Events as `model_id, case_id, ord, activity`.

    `order` must be a total order inside a case. `model` assigns each case to
    one of several models discovered in the same run (default: one model).

    An event without an activity stays in its case, under the empty name; a case
    without a model belongs to the model of the empty name. Events without a
    case have no place in any order and are left out: see `events_without_case`.
    """

    def text(c: Column | str) -> Column:
        return (F.col(c) if isinstance(c, str) else c).cast("string")

    return table.where(text(case).isNotNull()).select(
        (F.lit(ALL) if model is None else F.coalesce(text(model), F.lit(""))).alias("model_id"),
        text(case).alias("case_id"),
        F.struct(*order).alias("ord"),
        F.coalesce(text(activity), F.lit("")).alias("activity"),
    )


def events_without_case(table: DataFrame, case: Column | str) -> int:
    """Number of events that `event_log` leaves out."""
    return table.where((F.col(case) if isinstance(case, str) else case).isNull()).count()
