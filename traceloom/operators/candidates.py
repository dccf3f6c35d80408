"""Candidate places from the directly-follows graph.

A place (A, B) is proposed when one side is a single activity and every
activity of the other side directly follows (or precedes) it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.joins import lookup_join
from traceloom.schema import PLACE
from traceloom.session import materialize, spread

#: Largest number of activities on one side of a place (fixed value).
MAX_SET_SIZE = 3


def adjacency_list(dfg: DataFrame) -> DataFrame:
    """Successors of each activity: `model_id, src, dsts`."""
    return dfg.groupBy("model_id", "src").agg(F.sort_array(F.collect_set("dst")).alias("dsts"))


def _subsets(neighbours: DataFrame, key: list[str], max_size: int, alpha: float | None = None) -> DataFrame:
    """All sets of 1..max_size values of `item` under the same key: `key, items`.

    Sets grow one element at a time in name order, by joins of the table with
    itself. The growing side is spread over the tasks, or salted by its elements
    if the table is too large to broadcast, so that the sets of one well
    connected activity are built by many tasks.

    With `alpha`, `key` ends with `n_one`, the occurrences of the other side, and
    `neighbours` has those of the item as `n`. A set that occurs more often than the
    other side by a larger gap than alpha can only move further away, so neither
    it nor what would grow from it is built.
    """
    rows = neighbours.count()
    weighed = neighbours if alpha is not None else neighbours.withColumn("n", F.lit(0).cast("bigint"))

    def bounded(sets: DataFrame) -> DataFrame:
        if alpha is None:
            return sets
        over = F.col("sum") - F.col("n_one")
        return sets.where(~((over > 0) & (over / (F.col("sum") + F.col("n_one")) > alpha)))

    other = weighed.select(*key, F.col("item").alias("next"), F.col("n").alias("more"))
    grown = bounded(spread(weighed).select(*key, F.array("item").alias("items"), F.col("n").alias("sum")))
    sets = grown
    for _ in range(1, max_size):
        grown = bounded(
            lookup_join(grown, other, key, rows)
            .where(F.col("next") > F.element_at("items", -1))
            .select(*key, F.concat("items", F.array("next")).alias("items"), (F.col("sum") + F.col("more")).alias("sum"))
        )
        sets = sets.unionByName(grown)
    return sets.drop("sum")


def successor_subsets(dfg: DataFrame, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """`model_id, src, b_set` for every set of at most max_size successors."""
    successors = dfg.select("model_id", "src", F.col("dst").alias("item"))
    return _subsets(successors, ["model_id", "src"], max_size).withColumnRenamed("items", "b_set")


def inverted_list(dfg: DataFrame, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """Which activities have all of `b_set` as successors: `model_id, b_set, srcs`."""
    return (
        successor_subsets(dfg, max_size)
        .groupBy("model_id", "b_set")
        .agg(F.sort_array(F.collect_set("src")).alias("srcs"))
    )


def _neighbours(dfg: DataFrame) -> DataFrame:
    """Both ends of each arc: `model_id, one, split, item`.

    `item` follows `one` where `split` is true and precedes it otherwise. The
    sides of a place are disjoint, so arcs x -> x never contribute.
    """
    ends = F.array(
        F.struct(F.col("src").alias("one"), F.lit(True).alias("split"), F.col("dst").alias("item")),
        F.struct(F.col("dst").alias("one"), F.lit(False).alias("split"), F.col("src").alias("item")),
    )
    arcs = dfg.where(F.col("src") != F.col("dst"))
    return arcs.select("model_id", F.explode(ends).alias("e")).select("model_id", "e.*")


def _as_places(sets: DataFrame) -> DataFrame:
    one, split = F.array("one"), F.col("split")
    return (
        sets
        # 1 -> 1 places are found from both ends and kept from one.
        .where(~split | (F.size("items") > 1))
        .select(
            "model_id",
            F.when(split, one).otherwise(F.col("items")).alias("a_set"),
            F.when(split, F.col("items")).otherwise(one).alias("b_set"),
        )
    )


def _places(neighbours: DataFrame, max_size: int) -> DataFrame:
    return _as_places(_subsets(neighbours, ["model_id", "one", "split"], max_size))


def split_candidates(dfg: DataFrame, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """Places 1 -> n with n = 2..max_size."""
    return _places(_neighbours(dfg).where("split"), max_size)


def join_candidates(dfg: DataFrame, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """Places n -> 1 with n = 1..max_size."""
    return _places(_neighbours(dfg).where("not split"), max_size)


def candidates(dfg: DataFrame, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """All candidate places: `model_id, a_set, b_set`. `dfg` is read several times."""
    return _places(_neighbours(dfg), max_size)


def balanced_candidates(dfg: DataFrame, totals: DataFrame, alpha: float, max_size: int = MAX_SET_SIZE) -> DataFrame:
    """The candidate places among which are all whose sides occur about equally often.

    `totals` (`model_id, activity, n`) bounds the enumeration: a side is no longer
    extended once its occurrences pass those of the single activity by more than
    `alpha` allows, so around a hub only sets that can still balance are built. What
    is returned still has to be checked from below (`checks.log_level_check`).
    """
    n_totals = totals.count()
    neighbours = _neighbours(dfg)
    for end, name in [("item", "n"), ("one", "n_one")]:
        counted = totals.select("model_id", F.col("activity").alias(end), F.col("n").alias("found"))
        neighbours = lookup_join(neighbours, counted, ["model_id", end], n_totals, "left").withColumn(
            name, F.coalesce("found", F.lit(0).cast("bigint"))
        )
        neighbours = neighbours.drop("found")
    neighbours = materialize(neighbours, "neighbours")
    return _as_places(_subsets(neighbours, ["model_id", "one", "split", "n_one"], max_size, alpha))


def place_members(places: DataFrame) -> DataFrame:
    """Activities of each place with their sign: `+1` in A, `-1` in B."""
    return places.select(*PLACE, F.explode("a_set").alias("activity"), F.lit(1).alias("d")).unionByName(
        places.select(*PLACE, F.explode("b_set").alias("activity"), F.lit(-1).alias("d"))
    )
