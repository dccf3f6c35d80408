"""Kept places as AND / XOR gateways.

Each place a1,a2 > b1,b2 becomes  a -> AndS:a -> XOR:place -> AndJ:b -> b.
A node is identified by its name and its kind together, so that an activity
may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.sequences import place_label
from traceloom.operators.ordering import MAX_CASE_EVENTS, rank_by_range
from traceloom.schema import ACT, AND, XOR


def gateway_edges(places: DataFrame) -> DataFrame:
    """Expand places: `model_id, src, src_kind, dst, dst_kind`, each edge once."""
    place = place_label(F.col("a_set"), F.col("b_set")).alias("place")
    a = places.select("model_id", place, F.explode("a_set").alias("x"))
    b = places.select("model_id", place, F.explode("b_set").alias("x"))
    split, join = F.concat(F.lit("AndS:"), "x"), F.concat(F.lit("AndJ:"), "x")
    xor = F.concat(F.lit("XOR:"), "place")

    def edge(src, src_kind, dst, dst_kind):
        return F.struct(
            src.alias("src"),
            F.lit(src_kind).alias("src_kind"),
            dst.alias("dst"),
            F.lit(dst_kind).alias("dst_kind"),
        )

    def rows(side, *edges):
        return side.select("model_id", F.explode(F.array(*edges)).alias("e")).select("model_id", "e.*")

    x = F.col("x")
    return (
        rows(a, edge(x, ACT, split, AND), edge(split, AND, xor, XOR))
        .unionByName(rows(b, edge(xor, XOR, join, AND), edge(join, AND, x, ACT)))
        .distinct()
    )


def node_kinds(edges: DataFrame) -> DataFrame:
    """Every node of the graph once, with its kind."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("src_kind").alias("kind")),
        F.struct(F.col("dst").alias("node"), F.col("dst_kind").alias("kind")),
    )
    return edges.select("model_id", F.explode(ends).alias("n")).select("model_id", "n.*").distinct()


def gateway_nodes(edges: DataFrame) -> DataFrame:
    """Gateways of the graph, each once."""
    return node_kinds(edges).where(F.col("kind") != ACT)


def gateway_numbering(edges: DataFrame) -> DataFrame:
    """Display numbers 0.. per model and gateway family: `model_id, family, node, number`.

    Numbers follow the node names.
    """
    family = F.split_part("node", F.lit(":"), F.lit(1))
    nodes = gateway_nodes(edges).select("model_id", family.alias("family"), "node")
    numbered = rank_by_range(nodes, ["model_id", "family"], ["node"], nodes.count(), MAX_CASE_EVENTS)
    return numbered.select("model_id", "family", "node", (F.col("pos") - 1).alias("number"))


def gateway_degrees(edges: DataFrame) -> DataFrame:
    """`model_id, node, kind, n_in, n_out` of every node.

    `pred` and `succ` name one neighbour each; for a degree of 1, the neighbour.
    """
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    as_dst = F.struct(
        F.col("dst").alias("node"),
        F.col("dst_kind").alias("kind"),
        one.alias("i"),
        zero.alias("o"),
        F.struct(F.col("src").alias("name"), F.col("src_kind").alias("kind")).alias("pred"),
        F.lit(None).cast("struct<name:string,kind:string>").alias("succ"),
    )
    as_src = F.struct(
        F.col("src").alias("node"),
        F.col("src_kind").alias("kind"),
        zero.alias("i"),
        one.alias("o"),
        F.lit(None).cast("struct<name:string,kind:string>").alias("pred"),
        F.struct(F.col("dst").alias("name"), F.col("dst_kind").alias("kind")).alias("succ"),
    )
    return (
        edges.select("model_id", F.explode(F.array(as_dst, as_src)).alias("s"))
        .select("model_id", "s.*")
        .groupBy("model_id", "node", "kind")
        .agg(
            F.sum("i").alias("n_in"),
            F.sum("o").alias("n_out"),
            F.min("pred").alias("pred"),
            F.min("succ").alias("succ"),
        )
    )
