"""One registered query per operator, over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.logs import LOGS
from catalog.params import COPIES, DELTA, GRID, PARAMS
from traceloom import Discovery, Log, discover, log_from_events, log_from_traces, model_from_places
from traceloom.functions.sequences import set_label
from traceloom.operators import candidates as places
from traceloom.operators import checks, compaction, gateways, labels, ordering, reduction, statistics
from traceloom.plans import discovery
from traceloom.schema import ACT, ALL, AND, XOR
from traceloom.session import materialize, new_path
from traceloom.sources import text

Query = Callable[[SparkSession, str], DataFrame]


def _log(spark: SparkSession, sf_dir: str, name: str) -> Log:
    return log_from_events(LOGS[name](spark, sf_dir))


def _dfg(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return materialize(statistics.dfg_of_events(LOGS[name](spark, sf_dir)), "dfg")


def _log_candidates(spark: SparkSession, sf_dir: str, name: str) -> tuple[Log, DataFrame]:
    log = _log(spark, sf_dir, name)
    dfg = materialize(compaction.directly_follows(log), "dfg")
    return log, materialize(places.candidates(dfg), "candidates")


def _support(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return checks.support(*_log_candidates(spark, sf_dir, name))


def _discovery(spark: SparkSession, sf_dir: str, name: str, variant: str) -> Discovery:
    return discover(_log(spark, sf_dir, name), **PARAMS[name][variant])


def _kept(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    run = _discovery(spark, sf_dir, name, "0f")
    return materialize(run.kept, "kept"), run.dfg


def _gateways(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return materialize(gateways.gateway_edges(_kept(spark, sf_dir, name)[0]), "edges")


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as `a+b` text."""
    for column in columns:
        df = df.withColumn(column, set_label(F.col(column)))
    return df


def _sets(df: DataFrame) -> DataFrame:
    return _joined(df, "a_set", "b_set")


def _traces(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ordering.traces(LOGS[name](spark, sf_dir))


# --- logs: sources, order, counts ---------------------------------------------


def trace_text_roundtrip(spark, sf_dir):
    path = new_path(spark, "log-text")
    text.write_traces(_traces(spark, sf_dir, "events_day"), path)
    return text.read_traces(spark, path).select(
        "case_id", F.size("activities").alias("n"), F.concat_ws(",", "activities").alias("activities")
    )


def event_positions(spark, sf_dir):
    return ordering.positions(LOGS["events_day"](spark, sf_dir))


def trace_arrays(spark, sf_dir):
    return _joined(_traces(spark, sf_dir, "events_day"), "activities")


def trace_variants(spark, sf_dir):
    variants = compaction.trace_variants(_traces(spark, sf_dir, "lineitem"))
    return _joined(variants, "activities")


def replicate_log(spark, sf_dir):
    return _joined(text.replicate_log(_traces(spark, sf_dir, "conversations"), COPIES), "activities")


def log_summary(spark, sf_dir):
    return statistics.log_summary(LOGS["orders"](spark, sf_dir))


def activity_counts(spark, sf_dir):
    return statistics.activity_counts(LOGS["events_day"](spark, sf_dir))


def trace_bags(spark, sf_dir):
    return statistics.trace_bags(LOGS["events_day"](spark, sf_dir))


def succession_pairs(spark, sf_dir):
    return ordering.succession_pairs(LOGS["events_day"](spark, sf_dir))


# --- directly-follows graph ------------------------------------------------------


def dfg(spark, sf_dir):
    return statistics.dfg_of_events(LOGS["events_day"](spark, sf_dir))


def dfg_lineitem(spark, sf_dir):
    return compaction.directly_follows(_log(spark, sf_dir, "lineitem"))


def segmented_dfg(spark, sf_dir):
    return statistics.dfg_of_events(LOGS["orders"](spark, sf_dir))


def dfg_adjacency_lines(spark, sf_dir):
    return text.adjacency_lines(statistics.dfg_of_events(LOGS["orders"](spark, sf_dir)))


def dfg_text_roundtrip(spark, sf_dir):
    path = new_path(spark, "dfg-text")
    text.write_dfg(statistics.dfg_of_events(LOGS["lineitem"](spark, sf_dir)), path)
    return text.read_dfg(spark, path)


def segmented_dfg_text_roundtrip(spark, sf_dir):
    """Graphs of several models as text, a folder each, and the models read back from the folders."""
    path = new_path(spark, "dfg-text")
    text.write_dfg(statistics.dfg_of_events(LOGS["orders"](spark, sf_dir)), path)
    return text.read_dfg(spark, path)


def dfg_from_text(spark, sf_dir):
    path = new_path(spark, "log-text")
    text.write_traces(_traces(spark, sf_dir, "events_day"), path)
    return compaction.dfg_of_traces(text.read_traces(spark, path))


def adjacency_list(spark, sf_dir):
    return _joined(places.adjacency_list(_dfg(spark, sf_dir, "events_day")), "dsts")


# --- candidates -----------------------------------------------------------------


def successor_subsets(spark, sf_dir):
    return _joined(places.successor_subsets(_dfg(spark, sf_dir, "events_day")), "b_set")


def inverted_list(spark, sf_dir):
    return _joined(places.inverted_list(_dfg(spark, sf_dir, "orders")), "b_set", "srcs")


def candidates_split(spark, sf_dir):
    return _sets(places.split_candidates(_dfg(spark, sf_dir, "events_day")))


def candidates_join(spark, sf_dir):
    return _sets(places.join_candidates(_dfg(spark, sf_dir, "events_day")))


def candidates_all(spark, sf_dir):
    return _sets(places.candidates(_dfg(spark, sf_dir, "lineitem")))


# --- checks and discovery ----------------------------------------------------------


def log_level_check(spark, sf_dir):
    totals = materialize(statistics.activity_counts(LOGS["lineitem"](spark, sf_dir)), "totals")
    proposed = materialize(places.candidates(_dfg(spark, sf_dir, "lineitem")), "candidates")
    alpha = PARAMS["lineitem"]["2f"]["alpha"]
    return _sets(checks.log_level_check(proposed, totals, alpha))


def candidates_balanced(spark, sf_dir):
    """Candidates of the bounded enumeration that reach the log level."""
    totals = materialize(statistics.activity_counts(LOGS["lineitem"](spark, sf_dir)), "totals")
    alpha = PARAMS["lineitem"]["2f"]["alpha"]
    proposed = places.balanced_candidates(_dfg(spark, sf_dir, "lineitem"), totals, alpha)
    return _sets(checks.log_level_check(proposed, totals, alpha))


def trace_level_check(spark, sf_dir):
    """Hits at the ends of traces, from bags alone."""
    return _sets(checks.trace_level_check(checks.trace_support(*_log_candidates(spark, sf_dir, "lineitem"))))


def prefix_level_check(spark, sf_dir):
    return _sets(checks.prefix_level_check(_support(spark, sf_dir, "lineitem")))


def trace_level_check_events(spark, sf_dir):
    counts = _support(spark, sf_dir, "events_day")
    return _sets(checks.trace_level_check(counts, PARAMS["events_day"]["1f"]["beta"]))


def prefix_level_check_events(spark, sf_dir):
    counts = _support(spark, sf_dir, "events_day")
    return _sets(checks.prefix_level_check(counts, PARAMS["events_day"]["0f"]["gamma"]))


def trace_similarity_check(spark, sf_dir):
    return _sets(checks.trace_similarity_check(*_log_candidates(spark, sf_dir, "events_day"), DELTA))


def discover_0f(spark, sf_dir):
    return _sets(_discovery(spark, sf_dir, "lineitem", "0f").kept)


def discover_1f(spark, sf_dir):
    return _sets(_discovery(spark, sf_dir, "lineitem", "1f").kept)


def discover_2f(spark, sf_dir):
    return _sets(_discovery(spark, sf_dir, "lineitem", "2f").kept)


def discover_segments(spark, sf_dir):
    return _sets(_discovery(spark, sf_dir, "orders", "2f").kept)


def discovery_grid(spark, sf_dir):
    """Kept places for each cell of a grid of thresholds, from one pass over the log."""
    return _sets(discovery.discover_grid(_log(spark, sf_dir, "events_day"), GRID))


def discovery_funnel(spark, sf_dir):
    return discovery.funnel(_discovery(spark, sf_dir, "events_day", "2f"))


def discovery_funnel_segments(spark, sf_dir):
    return discovery.funnel(_discovery(spark, sf_dir, "orders", "2f"))


def place_listing(spark, sf_dir):
    return discovery.place_listing(_kept(spark, sf_dir, "events_day")[0])


# --- gateways and models -----------------------------------------------------------


def fuzzy_arcs(spark, sf_dir):
    kept, graph = _kept(spark, sf_dir, "events_day")
    return labels.fuzzy_arcs(graph, kept)


def gateway_edges(spark, sf_dir):
    return _gateways(spark, sf_dir, "orders")


def gateway_numbering(spark, sf_dir):
    return gateways.gateway_numbering(_gateways(spark, sf_dir, "orders"))


def node_kinds(spark, sf_dir):
    return gateways.node_kinds(_gateways(spark, sf_dir, "lineitem"))


def gateway_degrees(spark, sf_dir):
    degrees = gateways.gateway_degrees(_gateways(spark, sf_dir, "lineitem"))
    return degrees.select("model_id", "node", "kind", "n_in", "n_out")


def series_redexes(spark, sf_dir):
    redexes = reduction.series_redexes(_gateways(spark, sf_dir, "orders"))
    return redexes.select(
        "model_id", "node", "kind", F.col("pred.name").alias("pred"), F.col("succ.name").alias("succ")
    )


def block_redexes(spark, sf_dir):
    return reduction.block_redexes(_gateways(spark, sf_dir, "orders"))


def series_reduction(spark, sf_dir):
    return reduction.series_reduction(_gateways(spark, sf_dir, "orders"))


def reduce_round(spark, sf_dir):
    return reduction.reduce_round(_gateways(spark, sf_dir, "orders"))[0]


def block_round(spark, sf_dir):
    return reduction.block_round(_gateways(spark, sf_dir, "orders"))[0]


def _flag_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag -> AND -> AND -> line status, an edge for each pair of a line item."""
    flags = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("AndS:"), "l_returnflag").alias("s"),
        F.concat(F.lit("AndJ:"), "l_linestatus").alias("j"),
        "l_returnflag",
        "l_linestatus",
    )

    def edge(src, src_kind, dst, dst_kind):
        return F.struct(
            F.lit(ALL).alias("model_id"),
            F.col(src).alias("src"),
            F.lit(src_kind).alias("src_kind"),
            F.col(dst).alias("dst"),
            F.lit(dst_kind).alias("dst_kind"),
        )

    edges = F.array(
        edge("l_returnflag", ACT, "s", AND), edge("s", AND, "j", AND), edge("j", AND, "l_linestatus", ACT)
    )
    return materialize(flags.distinct().select(F.inline(edges)).distinct(), "flag-graph")


def block_merge(spark, sf_dir):
    return reduction.block_round(_flag_graph(spark, sf_dir))[0]


def block_fixpoint(spark, sf_dir):
    return reduction.reduced_gateways(_flag_graph(spark, sf_dir))


def _layered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag -> AND -> XOR -> AND -> line status, and line number -> AND into the last AND.

    The first two layers can be swapped; only then the gateways before the last
    layer are of one kind, and merge with it.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"))
    named = items.distinct().withColumns(
        {
            "split": F.concat(F.lit("AndS:"), "l_returnflag"),
            "choice": F.concat(F.lit("XOR:"), "l_linestatus"),
            "fork": F.concat(F.lit("AndS:"), "line"),
            "join": F.concat(F.lit("AndJ:"), "l_linestatus"),
        }
    )
    steps = [
        ("l_returnflag", ACT, "split", AND),
        ("split", AND, "choice", XOR),
        ("choice", XOR, "join", AND),
        ("line", ACT, "fork", AND),
        ("fork", AND, "join", AND),
        ("join", AND, "l_linestatus", ACT),
    ]
    edges = [
        F.struct(
            F.lit(ALL).alias("model_id"),
            F.col(src).alias("src"),
            F.lit(src_kind).alias("src_kind"),
            F.col(dst).alias("dst"),
            F.lit(dst_kind).alias("dst_kind"),
        )
        for src, src_kind, dst, dst_kind in steps
    ]
    return materialize(named.select(F.inline(F.array(*edges))).distinct(), "layered-graph")


def block_rounds(spark, sf_dir):
    """A swap that makes a merge possible: the end is reached after several block rounds."""
    return reduction.reduced_gateways(_layered_graph(spark, sf_dir))


def reduced_gateways(spark, sf_dir):
    return reduction.reduced_gateways(_gateways(spark, sf_dir, "lineitem"))


def gateway_reach(spark, sf_dir):
    edges = _gateways(spark, sf_dir, "orders")
    forward = labels.gateway_reach(edges, forward=True).withColumn("direction", F.lit("forward"))
    backward = labels.gateway_reach(edges, forward=False).withColumn("direction", F.lit("backward"))
    return forward.unionByName(backward)


def precise_labels(spark, sf_dir):
    kept, graph = _kept(spark, sf_dir, "lineitem")
    edges = materialize(gateways.gateway_edges(kept), "edges")
    return labels.precise_labels(edges, graph)


def hybrid_model(spark, sf_dir):
    kept, graph = _kept(spark, sf_dir, "lineitem")
    return model_from_places(kept, graph)


def hybrid_model_segments(spark, sf_dir):
    kept, graph = _kept(spark, sf_dir, "orders")
    return model_from_places(kept, graph)


def model_text_lines(spark, sf_dir):
    kept, graph = _kept(spark, sf_dir, "events_day")
    model = materialize(model_from_places(kept, graph), "model")
    return text.model_lines(model)


def replicated_discovery(spark, sf_dir):
    """Discovery on the log repeated several times: same places, multiplied counts."""
    traces = materialize(_traces(spark, sf_dir, "conversations"), "traces")
    log = log_from_traces(text.replicate_log(traces, COPIES))
    return _sets(discover(log, **PARAMS["conversations"]["2f"]).kept)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        trace_text_roundtrip,
        event_positions,
        trace_arrays,
        trace_variants,
        replicate_log,
        log_summary,
        activity_counts,
        trace_bags,
        succession_pairs,
        dfg,
        dfg_lineitem,
        segmented_dfg,
        dfg_adjacency_lines,
        dfg_text_roundtrip,
        segmented_dfg_text_roundtrip,
        dfg_from_text,
        adjacency_list,
        successor_subsets,
        inverted_list,
        candidates_split,
        candidates_join,
        candidates_all,
        log_level_check,
        candidates_balanced,
        trace_level_check,
        prefix_level_check,
        trace_level_check_events,
        prefix_level_check_events,
        trace_similarity_check,
        discover_0f,
        discover_1f,
        discover_2f,
        discover_segments,
        discovery_grid,
        discovery_funnel,
        discovery_funnel_segments,
        place_listing,
        fuzzy_arcs,
        gateway_edges,
        gateway_numbering,
        node_kinds,
        gateway_degrees,
        series_redexes,
        block_redexes,
        series_reduction,
        reduce_round,
        block_round,
        block_merge,
        block_fixpoint,
        block_rounds,
        reduced_gateways,
        gateway_reach,
        precise_labels,
        hybrid_model,
        hybrid_model_segments,
        model_text_lines,
        replicated_discovery,
    ]
}
