"""Checks of candidate places against the log.

Whether a place is balanced at the end of a trace depends only on how often its
activities occur, so traces with equal *bags* of activities are counted once and
the trace filter never looks at an order. The prefix filter then walks only the
places that are balanced in a bag and can still reach the threshold, and only the
occurrences of their activities. Rows between the steps hold keys and counts,
never a trace.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.operators.candidates import place_members
from traceloom.operators.compaction import Log
from traceloom.operators.joins import fits, lookup_join
from traceloom.schema import CASE, PLACE
from traceloom.session import materialize


def log_level_balance(places: DataFrame, totals: DataFrame) -> DataFrame:
    """`n_a, n_b` over the whole log and their relative `gap` = |n_a - n_b| / (n_a + n_b).

    `gap` is NULL for a place none of whose activities occurs. `totals` is read
    twice.
    """
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        lookup_join(place_members(places), totals, ["model_id", "activity"], totals.count(), "left")
        .groupBy(*PLACE)
        .agg(
            F.sum(F.when(F.col("d") > 0, n).otherwise(0)).alias("n_a"),
            F.sum(F.when(F.col("d") < 0, n).otherwise(0)).alias("n_b"),
        )
        .withColumn("gap", F.try_divide(F.abs(F.col("n_a") - F.col("n_b")), F.col("n_a") + F.col("n_b")))
    )


def log_level_check(places: DataFrame, totals: DataFrame, alpha: float) -> DataFrame:
    """Places whose sides occur about equally often in the whole log."""
    return log_level_balance(places, totals).where(F.col("gap") <= alpha)


#: Identifies a bag of activities (128 bits of hashes), or an oversized case.
BAG = ["h1", "h2"]


@dataclass
class Readings:
    """The places, and how they read the distinct activity sets they are made of.

    Several places have the same activities (a->bc, b->ac, ab->c, ...), so a bag
    is cut down to an activity set once for all of them.

    places:  place and `place_id`
    sets:    `set_id, model_id, members`
    signs:   `place_id, set_id, s0..`: +1 if a place's member is in A, -1 if in B
    """

    places: DataFrame
    n_places: int
    sets: DataFrame
    n_sets: int
    signs: DataFrame
    width: int

    def counts(self) -> list[str]:
        return [f"c{i}" for i in range(self.width)]

    def total(self, counted: Callable[[Column], Column]) -> Column:
        """Sum over members of their count, chosen by their sign."""
        return reduce(lambda x, y: x + y, [F.col(f"c{i}") * counted(F.col(f"s{i}")) for i in range(self.width)])


def _readings(places: DataFrame) -> Readings:
    members = F.sort_array(F.array_union("a_set", "b_set")).alias("members")
    named = materialize(places.select(*PLACE, members, F.monotonically_increasing_id().alias("place_id")), "places")
    sets = named.select("model_id", "members").distinct()
    sets = materialize(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    size = sets.agg(F.count("*").alias("rows"), F.max(F.size("members")).alias("width")).first()
    width = size["width"] or 1

    def sign(i: int) -> Column:
        member = F.get("members", F.lit(i))
        return F.when(member.isNull(), 0).when(F.array_contains("a_set", member), 1).otherwise(-1).cast("bigint")

    signs = named.join(sets, ["model_id", "members"]).select(
        "place_id", "set_id", *[sign(i).alias(f"s{i}") for i in range(width)]
    )
    return Readings(named.drop("members"), named.count(), sets, size["rows"], materialize(signs, "signs"), width)


def _bag_key(*parts: Column | str) -> list[Column]:
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")]


def _bag_counts(log: Log) -> DataFrame:
    """`h1, h2, mult, model_id, activity, n`: each distinct bag of the log, and each oversized case."""
    bag = F.col("bag")
    present = F.array_distinct(bag)
    # The bag is sorted: a run ends where the next one starts.
    starts = F.transform(present, lambda x: F.array_position(bag, x))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(bag) + F.lit(1).cast("bigint")))
    runs = F.explode(F.arrays_zip(present.alias("activity"), F.zip_with(ends, starts, lambda e, b: e - b).alias("n")))
    counted = (
        log.variants.groupBy("model_id", F.sort_array("activities").alias("bag"))
        .agg(F.sum("mult").alias("mult"))
        .select(*_bag_key("model_id", "bag"), "mult", "model_id", runs.alias("run"))
        .select(*BAG, "mult", "model_id", "run.activity", "run.n")
    )
    if log.pieces is None:
        return counted
    cases = (
        log.pieces.select(*CASE, F.explode("activities").alias("activity"))
        .groupBy(*CASE, "activity")
        .agg(F.count("*").alias("n"))
        .select(*_case_key(), F.lit(1).cast("bigint").alias("mult"), "model_id", "activity", "n")
    )
    return counted.unionByName(cases)


def _case_key() -> list[Column]:
    return _bag_key(F.lit("case"), *CASE)


def _touched(log: Log, reading: Readings) -> DataFrame:
    """`h1, h2, mult, set_id, c0..`: how often the members of each set occur in each bag that has any.

    An equi join on one activity finds the sets that touch a bag.
    """
    by_member = reading.sets.select("set_id", "model_id", F.posexplode("members").alias("i", "activity"))
    once = [F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(reading.counts())]
    bags = _bag_counts(log).repartition(*BAG)
    joined = lookup_join(bags, by_member, ["model_id", "activity"], reading.n_sets * reading.width)
    return joined.groupBy(*BAG, "mult", "set_id").agg(*once)


def _sides(touched: DataFrame, reading: Readings) -> DataFrame:
    """`place_id, mult, n_a, n_b`: how often both sides of each place occur, equal bags together."""
    shared = touched.groupBy("set_id", *reading.counts()).agg(F.sum("mult").alias("mult"))
    n_a = reading.total(lambda sign: F.greatest(sign, F.lit(0)))
    n_b = reading.total(lambda sign: F.greatest(-sign, F.lit(0)))
    return lookup_join(shared, reading.signs, ["set_id"], reading.n_places).select(
        "place_id", "mult", n_a.alias("n_a"), n_b.alias("n_b")
    )


def _tally(sides: DataFrame, reading: Readings, **hits: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    counts = sides.groupBy("place_id").agg(
        F.sum("mult").alias("touched"),
        *[F.sum(F.when(hit, F.col("mult")).otherwise(zero)).alias(name) for name, hit in hits.items()],
    )
    return reading.places.join(counts, "place_id")


def trace_support(log: Log, places: DataFrame) -> DataFrame:
    """Trace-level hits of each place: place, `touched`, `trace_hit`.

    `touched` are the traces with an activity of the place, `trace_hit` those in
    which A and B occur equally often. The sides of a place are disjoint. No order
    inside a trace is looked at.
    """
    reading = _readings(places)
    return _trace_tally(log, reading).drop("place_id")


def _trace_tally(log: Log, reading: Readings) -> DataFrame:
    return _tally(_sides(_touched(log, reading), reading), reading, trace_hit=F.col("n_a") == F.col("n_b"))


def _occurrences(log: Log) -> list[tuple[DataFrame, list[str], list[str]]]:
    """Variants and pieces exploded: `h1, h2, mult, <owner>, pos, activity`, the owner of a
    sequence, and what chains sequences to traces (nothing, or the piece)."""
    variants = log.variants
    if not log.compressed:
        # Equal sequences are walked once.
        variants = variants.groupBy("model_id", "activities").agg(F.sum("mult").alias("mult"))
    named = variants.withColumn("owner", F.monotonically_increasing_id())
    variants = named.select(
        *_bag_key("model_id", F.sort_array("activities")),
        "mult",
        "owner",
        F.posexplode("activities").alias("pos", "activity"),
    )
    out = [(variants, ["owner"], [])]
    if log.pieces is not None:
        pieces = log.pieces.select(
            *_case_key(), F.lit(1).cast("bigint").alias("mult"), *CASE, "piece", F.posexplode("activities").alias("pos", "activity")
        )
        out.append((pieces, CASE, ["piece"]))
    return out


def _walk() -> tuple[Column, Column]:
    """`fin, low`: balance at the end of `path` and the lowest on the way, for the members' signs `s0..` in `signs`."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("fin"), zero.alias("low"))

    def step(at: Column, i: Column) -> Column:
        balance = at["fin"] + F.get("signs", i)
        return F.struct(balance.alias("fin"), F.least(at["low"], balance).alias("low"))

    walked = F.aggregate("path", start, step)
    return walked["fin"], walked["low"]


def _prefix_hits(log: Log, reading: Readings, walked: DataFrame) -> DataFrame:
    """`place_id, prefix_hit` of the places `walked` (`place_id`).

    Only bags in which a place is balanced are walked. A sequence is cut down to
    the members of an activity set once for all places on the set, as a *path*
    of member numbers; equal paths of a set are counted once and walked once per
    place. Oversized cases are walked piece by piece; a piece starts from the
    balance that the pieces before it leave.
    """
    balanced = reading.total(lambda sign: sign) == 0
    kept = reading.signs.join(walked, "place_id", "left_semi")
    signs = kept.select("place_id", "set_id", F.array(*[f"s{i}" for i in range(reading.width)]).alias("signs"))
    pairs = lookup_join(_touched(log, reading), kept, ["set_id"], reading.n_places).where(balanced)
    members = reading.sets.select("set_id", F.posexplode("members").alias("i", "activity"))
    members = members.withColumn("i", F.col("i").cast("tinyint"))
    slots = materialize(
        lookup_join(pairs.select(*BAG, "set_id").distinct(), members, ["set_id"], reading.n_sets * reading.width), "slots"
    )
    n_slots = slots.count()
    lowest = []
    for occurrences, owner, chain in _occurrences(log):
        if fits(n_slots):
            # Each sequence stays in one partition, so that its paths need no further exchange.
            occurrences = occurrences.repartition(*owner)
        steps = F.sort_array(F.collect_list(F.struct("pos", "i")))
        paths = (
            lookup_join(occurrences, slots, [*BAG, "activity"], n_slots)
            .groupBy(*owner, "set_id", *chain, "mult")
            .agg(steps["i"].alias("path"))
        )
        if not chain:
            paths = paths.groupBy("set_id", "path").agg(F.sum("mult").alias("mult"))
        fin, low = _walk()
        walks = lookup_join(paths, signs, ["set_id"], reading.n_places).withColumns({"fin": fin, "low": low})
        if chain:
            before = Window.partitionBy(*owner, "place_id").orderBy(*chain).rowsBetween(Window.unboundedPreceding, -1)
            walks = (
                walks.withColumn("start", F.coalesce(F.sum("fin").over(before), F.lit(0)))
                .groupBy(*owner, "place_id", "mult")
                .agg(F.sum("fin").alias("fin"), F.min(F.col("start") + F.col("low")).alias("low"))
            )
        lowest.append(walks.where("fin = 0 AND low >= 0").select("place_id", "mult"))
    return reduce(DataFrame.unionByName, lowest).groupBy("place_id").agg(F.sum("mult").alias("prefix_hit"))


def support(log: Log, places: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Trace-level and prefix-level hits of each place.

    Columns: place, `touched`, `trace_hit` (see `trace_support`), `prefix_hit`
    (balanced at the end, and B is never ahead of A). A prefix hit is a trace hit,
    so places whose share of trace hits is below `at_least` are not walked: their
    `prefix_hit` is NULL.
    """
    reading = _readings(places)
    counts = materialize(_trace_tally(log, reading), "trace-support")
    walked = (F.col("trace_hit") > 0) & (F.col("trace_hit") / F.col("touched") >= at_least)
    hits = _prefix_hits(log, reading, counts.where(walked).select("place_id"))
    found = F.coalesce("prefix_hit", F.lit(0).cast("bigint"))
    known = walked | (F.col("trace_hit") == 0)
    return counts.join(hits, "place_id", "left").select(
        *PLACE, "touched", "trace_hit", F.when(known, found).alias("prefix_hit")
    )


def _outcome(counts: DataFrame, hit: str, threshold: float | None) -> DataFrame:
    """hit, miss and ratio; with a threshold, only places that reach it."""
    result = counts.select(
        *PLACE,
        F.col(hit).alias("hit"),
        (F.col("touched") - F.col(hit)).alias("miss"),
        F.try_divide(F.col(hit), F.col("touched")).alias("ratio"),
    )
    if threshold is None:
        return result
    return result.where((F.col("hit") > 0) & (F.col("ratio") >= threshold))


def trace_level_check(counts: DataFrame, beta: float | None = None) -> DataFrame:
    """Places balanced at the end of enough traces (`counts` from `trace_support` or `support`)."""
    return _outcome(counts, "trace_hit", beta)


def prefix_level_check(counts: DataFrame, gamma: float | None = None) -> DataFrame:
    """Places balanced in every prefix of enough traces (`counts` from `support`)."""
    return _outcome(counts, "prefix_hit", gamma)


def trace_similarity_check(log: Log, places: DataFrame, delta: float, threshold: float | None = None) -> DataFrame:
    """Places whose sides occur similarly often: min / max >= delta is a hit."""
    reading = _readings(places)
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    similar = (smaller > 0) & (smaller / larger >= delta)
    counts = _tally(_sides(_touched(log, reading), reading), reading, similar_hit=similar)
    return _outcome(counts, "similar_hit", threshold)
