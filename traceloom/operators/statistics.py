"""Counts straight from event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordering import MAX_CASE_EVENTS, succession_pairs
from traceloom.schema import ARC, CASE


def dfg_of_events(events: DataFrame, max_case_events: int | None = MAX_CASE_EVENTS) -> DataFrame:
    """The directly-follows graph: `model_id, src, dst, n`."""
    return succession_pairs(events, max_case_events).groupBy(*ARC).agg(F.count("*").alias("n"))


def activity_counts(events: DataFrame) -> DataFrame:
    """Occurrences of each activity: `model_id, activity, n`."""
    return events.groupBy("model_id", "activity").agg(F.count("*").alias("n"))


def trace_bags(events: DataFrame) -> DataFrame:
    """How often each activity occurs in each case: `model_id, case_id, activity, cnt`."""
    return events.groupBy(*CASE, "activity").agg(F.count("*").alias("cnt"))


def log_summary(events: DataFrame) -> DataFrame:
    """Number of traces and events per model."""
    return (
        events.groupBy(*CASE)
        .agg(F.count("*").alias("n"))
        .groupBy("model_id")
        .agg(F.count("*").alias("n_traces"), F.sum("n").alias("n_events"))
    )
