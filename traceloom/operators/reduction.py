"""Simplification of the gateway graph to a fixpoint.

Series rule: a gateway with one predecessor and one successor is bypassed.
Block rules: gateways H (two or more, of one kind) that all lead exactly to the
gateways F, while F is entered exactly from H, form a complete block. With k in
F of H's kind, the block becomes one gateway (merge). With k of the other kind
and a single successor, H becomes one gateway of k's kind followed by one of
H's kind (swap).

Each round applies, of the redexes that share nodes, the one of lowest rank.
Series redexes come first; block redexes are searched when none is left.
All models of a run are reduced together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.gateways import gateway_degrees
from traceloom.schema import ACT, AND, EDGE, XOR
from traceloom.session import materialize

NODE = ["model_id", "node", "kind"]


def series_redexes(edges: DataFrame) -> DataFrame:
    """Gateways with one way in and one way out: `model_id, node, kind, pred, succ`."""
    return (
        gateway_degrees(edges)
        .where((F.col("kind") != ACT) & (F.col("n_in") == 1) & (F.col("n_out") == 1))
        .select(*NODE, "pred", "succ")
    )


def _independent_series(redexes: DataFrame) -> DataFrame:
    """Of neighbouring series gateways, those with the lowest rank.

    The fixpoint does not depend on the choice. Ranking by a hash lets every
    round remove a good part of a chain, whatever its nodes are called.
    """
    hashed = F.md5(F.concat("kind", F.lit(":"), "node").cast("binary"))
    rank = F.struct(hashed.alias("h"), F.col("node").alias("n"), F.col("kind").alias("k"))
    ranked = redexes.withColumn("rank", rank)
    claims = F.array(F.struct(F.col("node").alias("name"), "kind"), F.col("pred"), F.col("succ"))
    lowest = (
        ranked.select("model_id", F.explode(claims).alias("c"), "rank")
        .groupBy("model_id", F.col("c.name").alias("node"), F.col("c.kind").alias("kind"))
        .agg(F.min("rank").alias("lowest"))
    )
    # Sharing a plain predecessor or successor is no conflict; being one is.
    return (
        ranked.join(lowest, NODE)
        .where(F.col("rank") == F.col("lowest"))
        .select(*NODE, "pred", "succ")
    )


def _bypass(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Lead the one edge into each removed gateway on to its one successor."""
    gone = removed.select("model_id", F.col("node").alias("src"), F.col("kind").alias("src_kind"))
    onward = removed.select("model_id", F.col("node").alias("dst"), F.col("kind").alias("dst_kind"), "succ")
    return (
        edges.join(gone, ["model_id", "src", "src_kind"], "left_anti")
        .join(onward, ["model_id", "dst", "dst_kind"], "left")
        .select(
            "model_id",
            "src",
            "src_kind",
            F.coalesce("succ.name", "dst").alias("dst"),
            F.coalesce("succ.kind", "dst_kind").alias("dst_kind"),
        )
        .distinct()
    )


def series_round(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Remove an independent set of series gateways; tell whether there were any."""
    removed = materialize(_independent_series(series_redexes(edges)), "series")
    if removed.isEmpty():
        return edges, False
    return materialize(_bypass(edges, removed), "edges"), True


def series_reduction(edges: DataFrame) -> DataFrame:
    """Apply the series rule until no series gateway is left."""
    fired = True
    while fired:
        edges, fired = series_round(edges)
    return edges


def _pred_groups(edges: DataFrame) -> DataFrame:
    """Gateways by the set of their predecessors, for sets of two or more gateways of one kind.

    The set is named by its size and two hashes that do not depend on order, so
    a node's neighbours are never gathered; `block_redexes` verifies the groups.
    """
    return (
        edges.where(F.col("dst_kind") != ACT)
        .groupBy("model_id", F.col("dst").alias("node"), F.col("dst_kind").alias("kind"))
        .agg(
            F.count("*").alias("n_h"),
            F.bit_xor(F.xxhash64("src", "src_kind")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit("preds"), "src_kind", "src")).alias("h2"),
            F.min("src_kind").alias("h_kind"),
            F.max("src_kind").alias("max_kind"),
        )
        .where((F.col("n_h") > 1) & (F.col("h_kind") == F.col("max_kind")) & (F.col("h_kind") != ACT))
        .drop("max_kind")
    )


BLOCK = ["model_id", "n_h", "h1", "h2"]


def _blocks(edges: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Complete blocks with the gateway k that fires them, and their F members."""
    groups = _pred_groups(edges)
    degrees = gateway_degrees(edges).select(*NODE, "n_in", "n_out")
    members = groups.join(degrees.drop("n_in"), NODE)
    same_kind = F.col("kind") == F.col("h_kind")
    eligible = same_kind | (F.col("n_out") == 1)
    chosen = members.groupBy(*BLOCK, "h_kind").agg(
        F.count("*").alias("n_f"),
        F.min(F.when(eligible, F.struct(F.col("node").alias("k"), F.col("kind").alias("k_kind")))).alias("k"),
        F.min("n_out").alias("min_out"),
        F.max("n_out").alias("max_out"),
        (F.min("kind") == F.max("kind")).alias("one_kind"),
    )
    # Counting proves the block: its edges come from exactly n_h nodes, each of
    # which has n_f successors, all of them in the block.
    into = edges.select(
        "model_id",
        F.col("src").alias("h"),
        F.col("src_kind").alias("h_kind"),
        F.col("dst").alias("node"),
        F.col("dst_kind").alias("kind"),
    ).join(groups.select(*NODE, "n_h", "h1", "h2"), NODE)
    sources = (
        into.groupBy(*BLOCK, "h", "h_kind")
        .agg(F.count("*").alias("n_into"))
        .join(
            degrees.select("model_id", F.col("node").alias("h"), F.col("kind").alias("h_kind"), "n_in", "n_out"),
            ["model_id", "h", "h_kind"],
        )
        .groupBy(*BLOCK)
        .agg(
            F.count("*").alias("sources"),
            F.min("n_into").alias("min_into"),
            F.max("n_out").alias("max_h_out"),
            F.max("n_in").alias("max_h_in"),
        )
    )
    found = chosen.join(sources, BLOCK).where(
        (F.col("sources") == F.col("n_h"))
        & (F.col("min_into") == F.col("n_f"))
        & (F.col("max_h_out") == F.col("n_f"))
        & F.col("k").isNotNull()
    )
    swap = F.col("k.k_kind") != F.col("h_kind")
    # A swap needs every member of F to lead somewhere.
    found = found.where(~swap | (F.col("min_out") > 0))
    if strict:
        narrow = (F.col("max_h_in") == 1) & (F.col("max_out") == 1)
        found = found.where(F.col("one_kind") & (~swap | narrow))
    found = found.select(
        *BLOCK,
        "h_kind",
        "n_f",
        "k.k",
        "k.k_kind",
        F.when(swap, "swap").otherwise("merge").alias("rule"),
    )
    return found, groups.select(*NODE, "n_h", "h1", "h2")


def block_redexes(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Complete blocks: `model_id, k, k_kind, h_kind, n_h, n_f, rule`.

    `strict` also asks that F is of one kind, and for a swap that members of H
    have one predecessor and members of F one successor.
    """
    found, _ = _blocks(edges, strict)
    return found.select("model_id", "k", "k_kind", "h_kind", "n_h", "n_f", "rule")


def _block_renaming(edges: DataFrame, found: DataFrame, f_members: DataFrame) -> DataFrame:
    """New name and kind of the nodes of those blocks of `found` that are applied in this round."""
    rank = F.struct("k", "k_kind").alias("rank")
    in_f = f_members.join(found, BLOCK).select(*NODE, *BLOCK[1:], rank, F.lit("F").alias("side"))
    in_f = materialize(in_f, "block-ends")
    src = edges.select("model_id", "src", "src_kind", F.col("dst").alias("node"), F.col("dst_kind").alias("kind"))
    dst = edges.select("model_id", "dst", "dst_kind", F.col("src").alias("node"), F.col("src_kind").alias("kind"))

    def before(side, tag):
        return (
            src.join(side.select(*NODE, *BLOCK[1:], "rank"), NODE)
            .select("model_id", F.col("src").alias("node"), F.col("src_kind").alias("kind"), *BLOCK[1:], "rank")
            .distinct()
            .withColumn("side", F.lit(tag))
        )

    after_f = (
        dst.join(in_f.select(*NODE, *BLOCK[1:], "rank"), NODE)
        .select("model_id", F.col("dst").alias("node"), F.col("dst_kind").alias("kind"), *BLOCK[1:], "rank")
        .distinct()
        .withColumn("side", F.lit("after"))
    )
    in_h = materialize(before(in_f, "H"), "block-starts")
    footprint = in_f.unionByName(in_h).unionByName(before(in_h, "before")).unionByName(after_f)
    footprint = materialize(footprint, "footprint")
    lowest = footprint.groupBy(*NODE).agg(F.min("rank").alias("lowest"))
    free = (
        footprint.join(lowest, NODE)
        .groupBy(*BLOCK)
        .agg(F.bool_and(F.col("rank") == F.col("lowest")).alias("free"))
        .where("free")
        .drop("free")
    )
    applied = found.join(free, BLOCK)
    nodes = in_f.unionByName(in_h).drop("rank").join(applied, BLOCK)
    # A merge has one new node for both sides, a swap one for each.
    part = F.when(F.col("rule") == "merge", F.lit("HF")).otherwise(F.col("side"))
    new_kind = F.when((F.col("rule") == "swap") & (F.col("side") == "F"), F.col("h_kind")).otherwise(F.col("k_kind"))
    named = nodes.groupBy(*BLOCK, part.alias("part")).agg(F.min("node").alias("first"))
    prefix = F.when(new_kind == AND, "And").when(new_kind == XOR, "XOR")
    return (
        nodes.withColumn("part", part)
        .join(named, [*BLOCK, "part"])
        .select(
            *NODE,
            F.concat(prefix, F.lit("*:"), F.col("first")).alias("new_node"),
            new_kind.alias("new_kind"),
        )
    )


def apply_renaming(edges: DataFrame, renaming: DataFrame) -> DataFrame:
    """Replace nodes; edges inside one new node vanish, equal edges become one."""
    as_src = renaming.toDF("model_id", "src", "src_kind", "new_src", "new_src_kind")
    as_dst = renaming.toDF("model_id", "dst", "dst_kind", "new_dst", "new_dst_kind")
    return (
        edges.join(as_src, ["model_id", "src", "src_kind"], "left")
        .join(as_dst, ["model_id", "dst", "dst_kind"], "left")
        .select(
            "model_id",
            F.coalesce("new_src", "src").alias("src"),
            F.coalesce("new_src_kind", "src_kind").alias("src_kind"),
            F.coalesce("new_dst", "dst").alias("dst"),
            F.coalesce("new_dst_kind", "dst_kind").alias("dst_kind"),
        )
        .where((F.col("src") != F.col("dst")) | (F.col("src_kind") != F.col("dst_kind")))
        .distinct()
    )


def block_round(edges: DataFrame, strict: bool = False) -> tuple[DataFrame, bool]:
    """Apply the block rules to blocks that do not touch each other."""
    found, f_members = _blocks(edges, strict)
    found = materialize(found, "blocks")
    if found.isEmpty():
        return edges, False
    renaming = materialize(_block_renaming(edges, found, f_members), "renaming")
    return materialize(apply_renaming(edges, renaming), "edges"), True


def reduce_round(edges: DataFrame, strict: bool = False) -> tuple[DataFrame, bool]:
    """One round: series rule if it applies anywhere, else the block rules."""
    reduced, fired = series_round(edges)
    return (reduced, True) if fired else block_round(edges, strict)


def reduced_gateways(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Apply all rules until none fires. Every round lowers the number of nodes."""
    edges = materialize(edges, "edges")
    fired = True
    while fired:
        edges, fired = block_round(series_reduction(edges), strict)
    return edges
