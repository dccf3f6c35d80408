"""Fuzzy arcs and the counts on precise arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.gateways import node_kinds
from traceloom.schema import ACT, ARC, EDGE
from traceloom.session import materialize


def fuzzy_arcs(dfg: DataFrame, places: DataFrame) -> DataFrame:
    """Arcs of the directly-follows graph that no place explains: `model_id, src, dst, n`."""
    explained = places.select("model_id", F.explode("a_set").alias("src"), "b_set").select(
        "model_id", "src", F.explode("b_set").alias("dst")
    )
    return dfg.join(explained, ARC, "left_anti").select(*ARC, "n")


def gateway_reach(edges: DataFrame, forward: bool) -> DataFrame:
    """Activities each gateway leads to (or comes from) through gateways only.

    `model_id, node, kind, activity`. Known reach is joined with itself, so each
    round passes twice as many gateways: a chain of n takes about log2(n) rounds.
    """
    ends = ("model_id", "node", "kind", "next", "next_kind")
    if forward:
        step = edges.toDF(*ends)
    else:
        step = edges.toDF("model_id", "next", "next_kind", "node", "kind").select(*ends)
    seen = materialize(step.where(F.col("kind") != ACT).distinct(), "reach")
    while True:
        onward = seen.toDF("model_id", "via", "via_kind", "next", "next_kind")
        further = (
            seen.where(F.col("next_kind") != ACT)
            .withColumnsRenamed({"next": "via", "next_kind": "via_kind"})
            .join(onward, ["model_id", "via", "via_kind"])
            .select(*ends)
            .distinct()
            .join(seen, list(ends), "left_anti")
        )
        further = materialize(further, "reach")
        if further.isEmpty():
            break
        seen = materialize(seen.unionByName(further), "reach")
    return seen.where(F.col("next_kind") == ACT).select(
        "model_id", "node", "kind", F.col("next").alias("activity")
    )


def _with_activities(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """Reach of gateways, plus every activity reaching itself."""
    activities = node_kinds(edges).where(F.col("kind") == ACT)
    return reach.unionByName(activities.withColumn("activity", F.col("node")))


def shared_sets(members: DataFrame) -> DataFrame:
    """`model_id, node, kind, set`: a node that stands for all nodes with the same activities.

    Sets are named by their size and two hashes that do not depend on order, and
    each is proven by counting the activities it has in common with the node that
    stands for it; a node that fails the proof stands for itself.
    """
    node = ["model_id", "node", "kind"]
    name = ["model_id", "n", "h1", "h2"]
    named = materialize(
        members.groupBy(*node).agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("activity")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit("second"), "activity")).alias("h2"),
        ),
        "set-names",
    )
    first = named.groupBy(*name).agg(F.min(F.struct("node", "kind")).alias("set"))
    chosen = materialize(named.join(first, name).select(*node, "n", "set"), "sets")
    theirs = members.select("model_id", F.struct("node", "kind").alias("set"), "activity")
    proven = (
        members.join(chosen, node)
        .join(theirs, ["model_id", "set", "activity"])
        .groupBy(*node)
        .agg(F.count("*").alias("common"))
    )
    same = F.coalesce(F.col("common") == F.col("n"), F.lit(False))
    return chosen.join(proven, node, "left").select(
        *node, F.when(same, F.col("set")).otherwise(F.struct("node", "kind")).alias("set")
    )


def precise_labels(edges: DataFrame, dfg: DataFrame) -> DataFrame:
    """Edges with `n`, the count of all arcs from the activities before to those after.

    Many nodes have the same activities before or after them, so the graph is
    joined and summed once for each distinct set, not once for each node. What
    leaves a set is summed before it meets the edges, so starts are never paired
    with ends.
    """
    starts = materialize(_with_activities(gateway_reach(edges, forward=False), edges), "starts")
    ends = materialize(_with_activities(gateway_reach(edges, forward=True), edges), "ends")
    before = shared_sets(starts).toDF("model_id", "src", "src_kind", "before")
    after = shared_sets(ends).toDF("model_id", "dst", "dst_kind", "after")
    named = materialize(
        edges.join(before, ["model_id", "src", "src_kind"], "left").join(after, ["model_id", "dst", "dst_kind"], "left"),
        "named-edges",
    )
    pairs = named.select("model_id", "before", "after").distinct()

    def of_sets(members: DataFrame, name: str, activity: str) -> DataFrame:
        listed = members.select("model_id", F.struct("node", "kind").alias(name), F.col("activity").alias(activity))
        return listed.join(named.select("model_id", name).distinct(), ["model_id", name], "left_semi")

    leaving = (
        of_sets(starts, "before", "src")
        .join(dfg, ["model_id", "src"])
        .groupBy("model_id", "before", "dst")
        .agg(F.sum("n").alias("n"))
    )
    counted = (
        pairs.join(leaving, ["model_id", "before"])
        .join(of_sets(ends, "after", "dst"), ["model_id", "after", "dst"])
        .groupBy("model_id", "before", "after")
        .agg(F.sum("n").alias("n"))
    )
    return named.join(counted, ["model_id", "before", "after"], "left").select(*EDGE, F.coalesce("n", F.lit(0)).alias("n"))
