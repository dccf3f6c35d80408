"""The hybrid model: precise gateway structure plus counted fuzzy arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.candidates import MAX_SET_SIZE
from traceloom.operators.compaction import Log
from traceloom.operators.gateways import gateway_edges
from traceloom.operators.labels import fuzzy_arcs, precise_labels
from traceloom.operators.reduction import reduced_gateways
from traceloom.plans.discovery import discover
from traceloom.schema import ACT, EDGE
from traceloom.session import materialize


def model_from_places(places: DataFrame, dfg: DataFrame, strict: bool = False) -> DataFrame:
    """`model_id, src, src_kind, dst, dst_kind, layer, n` for kept places."""
    reduced = reduced_gateways(gateway_edges(places), strict)
    precise = precise_labels(reduced, dfg).withColumn("layer", F.lit("precise"))
    fuzzy = fuzzy_arcs(dfg, places).select(
        "model_id",
        "src",
        F.lit(ACT).alias("src_kind"),
        "dst",
        F.lit(ACT).alias("dst_kind"),
        F.lit("fuzzy").alias("layer"),
        "n",
    )
    return precise.unionByName(fuzzy).select(*EDGE, "layer", "n")


def hybrid_model(
    log: Log,
    gamma: float,
    beta: float | None = None,
    alpha: float | None = None,
    max_set_size: int = MAX_SET_SIZE,
    strict: bool = False,
    dfg: DataFrame | None = None,
) -> DataFrame:
    """Discover places in the log and build the model (thresholds as in `discover`)."""
    run = discover(log, gamma, beta, alpha, max_set_size, dfg)
    return model_from_places(materialize(run.kept, "kept"), run.dfg, strict)
