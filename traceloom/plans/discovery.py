"""Place discovery: candidates, then up to three filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators import checks
from traceloom.operators.candidates import MAX_SET_SIZE, balanced_candidates, candidates
from traceloom.operators.compaction import Log, activity_totals, directly_follows, models
from traceloom.operators.gateways import gateway_edges, gateway_nodes
from traceloom.schema import PLACE
from traceloom.session import materialize


@dataclass
class Discovery:
    """The stages of one discovery run; every stage is a table of places.

    `candidates` are all proposed places, whether or not the run had to build
    them. `models` holds each `model_id` of the log, also of those without a place.
    """

    dfg: DataFrame
    candidates: DataFrame
    after_log: DataFrame
    after_trace: DataFrame
    kept: DataFrame
    models: DataFrame


def discover(
    log: Log,
    gamma: float,
    beta: float | None = None,
    alpha: float | None = None,
    max_set_size: int = MAX_SET_SIZE,
    dfg: DataFrame | None = None,
) -> Discovery:
    """Keep the candidate places that pass the given thresholds.

    alpha: largest relative gap between both sides over the whole log
    beta:  smallest share of touching traces balanced at their end
    gamma: smallest share of touching traces balanced in every prefix
    A threshold of None skips its filter. `dfg` may be given if it is known,
    e.g. from a file; otherwise it is counted from the log.
    """
    dfg = materialize(directly_follows(log) if dfg is None else dfg, "dfg")
    proposed = candidates(dfg, max_set_size)
    if alpha is None:
        after_log = proposed = materialize(proposed, "candidates")
    else:
        # All candidates are only named, for who asks for them; those that can't balance are never built.
        totals = materialize(activity_totals(log), "totals")
        passed = checks.log_level_check(balanced_candidates(dfg, totals, alpha, max_set_size), totals, alpha)
        after_log = materialize(passed.select(*PLACE), "after-log")
    # Order is looked at only for places that the trace-level counts let pass.
    counts = materialize(checks.support(log, after_log, max(gamma, beta or 0.0)), "support")
    after_trace = after_log
    if beta is not None:
        after_trace = checks.trace_level_check(counts, beta)
        counts = counts.where((F.col("trace_hit") > 0) & (F.col("trace_hit") / F.col("touched") >= beta))
    kept = checks.prefix_level_check(counts, gamma)
    return Discovery(dfg, proposed, after_log, after_trace, kept, models(log))


#: Thresholds of one run: alpha, beta (either may be None) and gamma.
Thresholds = tuple[float | None, float | None, float]


def discover_grid(
    log: Log, grid: Sequence[Thresholds], max_set_size: int = MAX_SET_SIZE, dfg: DataFrame | None = None
) -> DataFrame:
    """The places that `discover` keeps, for every (alpha, beta, gamma) of a grid, from one pass over the log.

    `alpha, beta, gamma` (NULL: no such filter), place, `hit, miss, ratio`. The log
    is counted once for the loosest thresholds; which cells of the grid a place
    passes is then read off its counts.
    """
    if not grid:
        raise ValueError("a grid has at least one cell")
    dfg = materialize(directly_follows(log) if dfg is None else dfg, "dfg")
    totals = materialize(activity_totals(log), "totals")
    alphas = [alpha for alpha, _, _ in grid]
    if None in alphas:
        proposed = materialize(candidates(dfg, max_set_size), "candidates")
    else:
        loosest = max(alphas)
        passed = checks.log_level_check(balanced_candidates(dfg, totals, loosest, max_set_size), totals, loosest)
        proposed = materialize(passed.select(*PLACE), "candidates")
    gaps = checks.log_level_balance(proposed, totals).select(*PLACE, "gap")
    counts = checks.support(log, proposed, min(max(gamma, beta or 0.0) for _, beta, gamma in grid))
    measured = checks.prefix_level_check(counts.where("prefix_hit > 0")).withColumnRenamed("hit", "prefix_hit")
    measured = measured.join(checks.trace_level_check(counts).select(*PLACE, F.col("ratio").alias("trace_ratio")), PLACE)

    def cell(alpha: float | None, beta: float | None, gamma: float) -> Column:
        values = [("alpha", alpha), ("beta", beta), ("gamma", gamma)]
        return F.struct(*[F.lit(value).cast("double").alias(name) for name, value in values])

    def passes(at: Column) -> Column:
        return (
            (at["alpha"].isNull() | (F.col("gap") <= at["alpha"]))
            & (at["beta"].isNull() | (F.col("trace_ratio") >= at["beta"]))
            & (F.col("ratio") >= at["gamma"])
        )

    cells = F.array(*[cell(*c) for c in grid])
    return (
        measured.join(gaps, PLACE)
        .select(F.explode(F.filter(cells, passes)).alias("at"), *PLACE, "prefix_hit", "miss", "ratio")
        .select("at.*", *PLACE, F.col("prefix_hit").alias("hit"), "miss", "ratio")
    )


#: Stages of a run, and the gateways its places expand to before any reduction.
PLACE_STAGES = ["1 candidates", "2 log level", "3 trace level", "4 prefix level"]
GATEWAY_STAGES = {"AndS": "5 AND-splits", "AndJ": "6 AND-joins", "XOR": "7 XORs"}


def funnel(run: Discovery) -> DataFrame:
    """Places after each stage, and gateways of the kept ones: `model_id, stage, n`.

    Every model of the log has a row for each stage, with 0 where nothing is left.
    """
    family = F.split_part("node", F.lit(":"), F.lit(1))
    stage_of = F.create_map(*[F.lit(x) for pair in GATEWAY_STAGES.items() for x in pair])
    found = gateway_nodes(gateway_edges(run.kept)).select("model_id", stage_of[family].alias("stage"))
    tables = [run.candidates, run.after_log, run.after_trace, run.kept]
    for stage, places in zip(PLACE_STAGES, tables, strict=True):
        found = found.unionByName(places.select("model_id", F.lit(stage).alias("stage")))
    counts = found.groupBy("model_id", "stage").agg(F.count("*").alias("n"))
    stages = F.array(*[F.lit(s) for s in [*PLACE_STAGES, *GATEWAY_STAGES.values()]])
    return (
        run.models.select("model_id", F.explode(stages).alias("stage"))
        .join(counts, ["model_id", "stage"], "left")
        .select("model_id", "stage", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def place_listing(places: DataFrame) -> DataFrame:
    """Places as text, each member followed by a dot: `a.|b.c.`."""

    def dotted(members: str):
        return F.array_join(F.transform(members, lambda x: F.concat(x, F.lit("."))), "")

    return places.select("model_id", F.concat(dotted("a_set"), F.lit("|"), dotted("b_set")).alias("place"))
