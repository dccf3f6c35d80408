"""Process discovery on Spark: event logs to hybrid process models."""

from traceloom.operators.compaction import Log, log_from_events, log_from_traces
from traceloom.plans.discovery import Discovery, discover, discover_grid
from traceloom.plans.hybrid import hybrid_model, model_from_places
from traceloom.sources.tables import event_log

__all__ = [
    "Discovery",
    "Log",
    "discover",
    "discover_grid",
    "event_log",
    "hybrid_model",
    "log_from_events",
    "log_from_traces",
    "model_from_places",
]
