"""The log in the form all discovery steps read.

Every check depends on a trace's activity sequence only, so equal sequences are
kept once with their multiplicity. Oversized cases are kept as pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.sequences import chunks, successions
from traceloom.operators import ordering
from traceloom.operators.ordering import MAX_CASE_EVENTS, split_by_size
from traceloom.schema import CASE
from traceloom.session import materialize


@dataclass
class Log:
    """A compact event log.

    variants: `model_id, activities, mult` - whole sequences (and `case_id` if
              they are not compressed)
    pieces:   `model_id, case_id, piece, activities` - cases too large for a
              row, cut in order; None if the log has no such case
    compressed: whether every sequence stands in `variants` once
    """

    variants: DataFrame
    pieces: DataFrame | None = None
    compressed: bool = True


def trace_variants(traces: DataFrame) -> DataFrame:
    """Distinct sequences with the number of traces that have them."""
    return traces.groupBy("model_id", "activities").agg(F.count("*").alias("mult"))


def _variants(traces: DataFrame, compress: bool) -> DataFrame:
    if compress:
        return trace_variants(traces)
    return traces.withColumn("mult", F.lit(1).cast("bigint"))


def log_from_events(
    events: DataFrame,
    max_case_events: int | None = MAX_CASE_EVENTS,
    compress: bool = True,
) -> Log:
    """Compact an event table (see `sources.tables.event_log`)."""
    split = split_by_size(events, max_case_events)
    variants = materialize(_variants(ordering.traces(split.regular), compress), "variants")
    if split.oversized is None:
        return Log(variants, None, compress)
    return Log(variants, materialize(ordering.pieces(split, max_case_events), "pieces"), compress)


def _named(traces: DataFrame) -> DataFrame:
    return traces.withColumns(
        {
            "model_id": F.coalesce("model_id", F.lit("")),
            "activities": F.transform("activities", lambda x: F.coalesce(x, F.lit(""))),
        }
    )


def log_from_traces(
    traces: DataFrame,
    max_case_events: int = MAX_CASE_EVENTS,
    compress: bool = True,
) -> Log:
    """Compact `model_id, case_id, activities` rows, such as a text log.

    Missing names and models count as empty ones, as in `event_log`.
    """
    traces = _named(traces)
    large = F.size("activities") > max_case_events
    variants = materialize(_variants(traces.where(~large), compress), "variants")
    oversized = traces.where(large)
    if oversized.isEmpty():
        return Log(variants, None, compress)
    cut = oversized.select(
        *CASE,
        F.posexplode(chunks(F.col("activities"), max_case_events)).alias("piece", "activities"),
    )
    return Log(variants, materialize(cut.withColumn("piece", F.col("piece").cast("bigint")), "pieces"), compress)


def models(log: Log) -> DataFrame:
    """Each `model_id` of the log once."""
    found = log.variants.select("model_id")
    if log.pieces is not None:
        found = found.unionByName(log.pieces.select("model_id"))
    return found.distinct()


def activity_totals(log: Log) -> DataFrame:
    """Occurrences of each activity in the whole log: `model_id, activity, n`."""
    parts = log.variants.select("model_id", "mult", F.explode("activities").alias("activity"))
    if log.pieces is not None:
        parts = parts.unionByName(
            log.pieces.select(
                "model_id",
                F.lit(1).cast("bigint").alias("mult"),
                F.explode("activities").alias("activity"),
            )
        )
    return parts.groupBy("model_id", "activity").agg(F.sum("mult").alias("n"))


def directly_follows(log: Log) -> DataFrame:
    """The directly-follows graph: `model_id, src, dst, n`."""
    pairs = log.variants.select(
        "model_id", "mult", F.explode(successions(F.col("activities"))).alias("pair")
    )
    if log.pieces is not None:
        # Successions inside a piece need no shuffle. From one piece to the next
        # only its last and first activity are brought together.
        one = F.lit(1).cast("bigint").alias("mult")
        inside = log.pieces.select("model_id", one, F.explode(successions(F.col("activities"))).alias("pair"))
        along = Window.partitionBy(*CASE).orderBy("piece")
        ends = log.pieces.select(
            *CASE, "piece", F.get("activities", F.lit(0)).alias("first"), F.element_at("activities", -1).alias("src")
        )
        across = (
            ends.withColumn("dst", F.lead("first").over(along))
            .where("dst IS NOT NULL")
            .select("model_id", one, F.struct("src", "dst").alias("pair"))
        )
        pairs = pairs.unionByName(inside).unionByName(across)
    return pairs.groupBy("model_id", F.col("pair.src"), F.col("pair.dst")).agg(F.sum("mult").alias("n"))


def dfg_of_traces(traces: DataFrame) -> DataFrame:
    """The directly-follows graph of whole traces, such as a text log, in one pass.

    A trace holds its own order, so only arcs with partial counts are shuffled.
    Missing names and models count as empty ones.
    """
    pairs = _named(traces).select("model_id", F.explode(successions(F.col("activities"))).alias("pair"))
    return pairs.groupBy("model_id", F.col("pair.src"), F.col("pair.dst")).agg(F.count("*").alias("n"))
