"""Order inside cases.

The usual case is small and is ordered by a window over the case. A case with
more events than `max_case_events` is not: its events are range-partitioned by
the order key, ranked inside the range partitions, and shifted by the counts of
the partitions before, so that no task ever holds the whole case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.joins import lookup_join
from traceloom.schema import CASE
from traceloom.session import materialize, shuffle_width

#: A case with more events than this is processed in pieces of this size.
MAX_CASE_EVENTS = 100_000


@dataclass
class SplitEvents:
    """Events of cases that fit a task, and of cases that do not (or None)."""

    regular: DataFrame
    oversized: DataFrame | None
    oversized_rows: int = 0


def case_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy(*CASE).agg(F.count("*").alias("n_events"))


def split_by_size(events: DataFrame, max_case_events: int | None = MAX_CASE_EVENTS) -> SplitEvents:
    """Separate the events of oversized cases. `None` trusts that there are none."""
    if max_case_events is None:
        return SplitEvents(events, None)
    large = case_sizes(events).where(F.col("n_events") > max_case_events)
    found = large.agg(F.count("*").alias("cases"), F.sum("n_events").alias("rows")).first()
    if found["cases"] == 0:
        return SplitEvents(events, None)
    large = materialize(large.select(*CASE), "oversized-cases")
    return SplitEvents(
        lookup_join(events, large, CASE, found["cases"], "left_anti"),
        lookup_join(events, large, CASE, found["cases"], "left_semi"),
        found["rows"],
    )


def rank_by_range(df: DataFrame, group: list[str], order: list[str], rows: int, per_task: int) -> DataFrame:
    """Add `pos` = 1..n inside `group` along `order`, however large a group is.

    `df` must have a total order by `group + order`.
    """
    spark = df.sparkSession
    parts = max(shuffle_width(spark), -(-rows // per_task))
    # Range bounds are sampled, so the partition number is written down before
    # it is used as a key.
    ranged = materialize(
        df.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "part")
        .agg(F.count("*").alias("n"))
        .select(*group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    )
    inside = Window.partitionBy(*group, "part").orderBy(*order)
    return (
        ranged.withColumn("rank", F.row_number().over(inside))
        .join(offsets, [*group, "part"])
        .withColumn("pos", F.col("skip") + F.col("rank"))
        .drop("part", "skip", "rank")
    )


def _small_positions(events: DataFrame) -> DataFrame:
    # The case goes first: it tells rows apart early when they are sorted.
    along = Window.partitionBy(*reversed(CASE)).orderBy("ord")
    return events.select(*CASE, F.row_number().over(along).cast("bigint").alias("pos"), "activity")


def _large_positions(split: SplitEvents, max_case_events: int) -> DataFrame:
    ranked = rank_by_range(split.oversized, CASE, ["ord"], split.oversized_rows, max_case_events)
    return ranked.select(*CASE, "pos", "activity")


def positions(events: DataFrame, max_case_events: int | None = MAX_CASE_EVENTS) -> DataFrame:
    """`model_id, case_id, pos, activity` with pos = 1.. inside each case."""
    split = split_by_size(events, max_case_events)
    small = _small_positions(split.regular)
    if split.oversized is None:
        return small
    return small.unionByName(_large_positions(split, max_case_events))


def traces(events: DataFrame) -> DataFrame:
    """One row per case with its activities in order. For cases that fit a row.

    The window sorts with spilling and compares the order key natively; the
    array is then sorted by the plain position.
    """
    steps = F.sort_array(F.collect_list(F.struct("pos", "activity")))
    return (
        _small_positions(events)
        .groupBy(*reversed(CASE))
        .agg(steps.alias("steps"))
        .select(*CASE, F.col("steps.activity").alias("activities"))
    )


def pieces(split: SplitEvents, max_case_events: int) -> DataFrame:
    """Oversized cases as consecutive pieces: `model_id, case_id, piece, activities`."""
    piece = F.floor((F.col("pos") - 1) / max_case_events)
    steps = F.sort_array(F.collect_list(F.struct("pos", "activity")))
    return (
        _large_positions(split, max_case_events)
        .groupBy(*CASE, piece.alias("piece"))
        .agg(steps.alias("steps"))
        .select(*CASE, "piece", F.col("steps.activity").alias("activities"))
    )


def succession_pairs(events: DataFrame, max_case_events: int | None = MAX_CASE_EVENTS) -> DataFrame:
    """Each event with the one that follows it: `model_id, case_id, pos, src, dst`."""
    split = split_by_size(events, max_case_events)
    along = Window.partitionBy(*reversed(CASE)).orderBy("ord")
    pairs = split.regular.select(
        *CASE,
        F.row_number().over(along).cast("bigint").alias("pos"),
        F.col("activity").alias("src"),
        F.lead("activity").over(along).alias("dst"),
    )
    if split.oversized is not None:
        # The first event of a piece is also handed to the piece before it, as
        # the successor of that piece's last event.
        block = F.floor((F.col("pos") - 1) / max_case_events)
        starts_block = (F.col("pos") - 1) % max_case_events == 0
        blocks = F.when(starts_block, F.array(block - 1, block)).otherwise(F.array(block))
        inside = Window.partitionBy(*CASE, "block").orderBy("pos")
        pairs = pairs.unionByName(
            _large_positions(split, max_case_events)
            .withColumn("block", F.explode(blocks))
            .select(
                *CASE,
                "pos",
                F.col("activity").alias("src"),
                F.lead("activity").over(inside).alias("dst"),
            )
        )
    return pairs.where(F.col("dst").isNotNull())
