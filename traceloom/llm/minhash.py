"""MinHash near-duplicates with tensored banding.

A table key is a pair: one value of the first and one of the second collection
of `COLLECTION` hashes, each the combination of `ROWS` minima. So
`COLLECTION ** 2` tables of `2 * ROWS` minima cost only
`2 * COLLECTION * ROWS` minhash computations. With 10 and 3, two documents of
similarity 0.8 share a table with probability (1 - (1 - 0.8^3)^10)^2 = 0.998.

Equal sets are one class from the start, so copies never meet in pairs, and texts
that share an id are apart. Every class is compared, on full shingle sets, with the
first classes of its buckets. Buckets that still hold several components go on to a
join on their members' rarest shingles, which finds all their pairs without forming
them in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm import words as W
from traceloom.session import materialize

COLLECTION = 10
ROWS = 3
#: A pair whose minima agree less often than this isn't compared on full sets:
#: 60 minima of a pair of similarity 0.8 agree 30 times or less in 10^-7 of cases.
LEAST_ESTIMATE = 0.5
#: Classes whose texts are sought are broadcast up to this number (24 bytes each), else shuffled.
BROADCAST_IDS = 700_000

_rng = np.random.default_rng(77)
_FLIP = _rng.integers(0, 1 << 32, 2 * COLLECTION * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, 2 * COLLECTION * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOIN = _rng.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 14

SIGNATURES = (
    "doc_id BIGINT, text_hash BIGINT, n_shingles BIGINT, h1 BIGINT, h2 BIGINT, "
    "a ARRAY<BIGINT>, b ARRAY<BIGINT>, minima ARRAY<INT>"
)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed shingles of each text."""
    for _, _, data, offsets in W.blocks(column):
        words = W.split(data, offsets)
        hashes = words.hashes(lower=True)
        at, grams = words.windows(hashes, size)
        bounds = np.searchsorted(at, words.first, "left")
        for d in range(len(offsets) - 1):
            n = words.first[d + 1] - words.first[d]
            if n >= size:
                yield np.unique(grams[bounds[d] : bounds[d + 1]])
            elif n:
                whole = hashes[words.first[d] : words.first[d + 1]]
                value = int((whole * W.powers(W._ROLL, n)).sum(dtype=np.uint64)) + int(n)
                yield W.mix(np.array([value % (1 << 64)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FLIP), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _STEP):
        part = (low[None, i : i + _STEP] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _arrays(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            counts = np.zeros(n, np.int64)
            sums = np.zeros((n, 2), np.uint64)
            least = np.zeros((n, len(_FLIP)), np.uint32)
            for i, s in enumerate(shingle_sets(batch.column(1), size)):
                counts[i] = len(s)
                if len(s):
                    sums[i] = s.sum(dtype=np.uint64), W.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    least[i] = minima(s)
            bands = W.mix((least.reshape(n, -1, ROWS).astype(np.uint64) * _JOIN).sum(axis=2, dtype=np.uint64))
            a, b = (W.signed(x) for x in np.split(bands, 2, axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts),
                    pa.array(W.signed(sums[:, 0])),
                    pa.array(W.signed(sums[:, 1])),
                    *(_arrays(x, pa.int64()) for x in (a, b)),
                    _arrays(least.view(np.int32), pa.int32()),
                ],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "a", "b", "minima"],
            )

    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, SIGNATURES)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(1), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return docs.mapInArrow(run, "node BIGINT, shingles BINARY")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of `x, y`, the pairs with 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good[i] = 100 * both >= threshold * (len(p) + len(q) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    return (
        pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
        .join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y")
        .select("x", "y", "sx", "sy")
        .mapInArrow(run, "x BIGINT, y BIGINT")
        .distinct()
    )


def _exploded(docs: DataFrame, size: int) -> DataFrame:
    """`node, n, shingle`: every hashed shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(shingle_sets(batch.column(1), size)):
                node = batch.column(0)[i].as_py()
                for low in range(0, len(s), _STEP):
                    part = s[low : low + _STEP]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), node, np.int64)),
                            pa.array(np.full(len(part), len(s), np.int64)),
                            pa.array(W.signed(part)),
                        ],
                        ["node", "n", "shingle"],
                    )

    return docs.mapInArrow(run, "node BIGINT, n BIGINT, shingle BIGINT").distinct()


def _share_rare_shingles(shingles: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """`x, y` of different components that may reach the threshold; none that does is left out.

    Shingles are put in one order, rare ones first. Of two sets that are similar
    enough, the first of each set's (1 - threshold) part hold a common shingle,
    and so many must follow it in both as the overlap still needs.
    """
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node", "n").orderBy("often", "shingle")
    first = (
        shingles.join(often, "shingle")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)
        .join(placed, "node")
        .where("often > 1")
    )
    first = materialize(first.select("shingle", "node", "component", "n", "place"), "rare")
    p = first.select("shingle", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    q = first.select("shingle", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"))
    ahead = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    return (
        p.join(q, "shingle")
        .where("x < y AND cx <> cy")
        .where(ahead * (100 + threshold) >= (F.col("nx") + F.col("ny")) * threshold)
        .select("x", "y")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """`node, component`: the smallest node reachable over edges `x, y`.

    Labels spread to neighbours and are then replaced by the label of the label,
    so paths shorten by a factor each round. Rounds are written, not kept in memory.
    """
    both = materialize(
        edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select(
            "node", F.least("node", "near").alias("component")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "y"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("step"), "component")
        of = labels.select(F.col("node").alias("step"), F.col("component").alias("further"))
        moved = materialize(
            spread.join(of, "step", "left").select(
                "node",
                F.least("step", "further").alias("component"),
                (F.least("step", "further") < F.col("component")).alias("changed"),
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept, text_hash` of each row of `doc_id, text`.

    `size` words (lower-cased A-Z, cut at white space) are a shingle; a text of
    fewer words is one shingle, one without words (or null) has none and is
    linked with nothing. Documents are linked from `threshold` percent of
    intersection over union. Rows are judged by
    their text: those of one doc_id with several texts each have their text's
    component, and equal rows have equal verdicts. A row without a doc_id is linked
    with nothing: its component is null and it is kept.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(plain, size), "signatures")
    classes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first(F.struct("a", "b", "minima")).alias("s"))
        .select("h1", "h2", "n_shingles", "one.*", "s.*")
    )
    # Classes are numbered in the order of their smallest ids: the first of a bucket, which all
    # others meet, is then its oldest document, whose copies are nearer to it than to each other.
    ordered = classes.orderBy("doc_id", "h1", "h2", "n_shingles")
    classes = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
    tables = (
        classes.select("node", "b", F.posexplode("a").alias("i", "u"))
        .select("node", "i", "u", F.posexplode("b").alias("j", "v"))
        .select("node", F.xxhash64("i", "u", "j", "v").alias("key"))
    )
    hubs = (
        tables.groupBy("key")
        .agg(F.min("node").alias("hub"), F.max("node").alias("last"))
        .where("hub < last")
        .select("key", "hub")
    )
    members = materialize(tables.join(hubs, "key").select("key", "hub", "node"), "buckets")
    minima_of = classes.select("node", "n_shingles", "minima")
    agreeing = F.aggregate(
        F.zip_with("mx", "my", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v
    )

    def likely(pairs: DataFrame) -> DataFrame:
        x = minima_of.select(F.col("node").alias("x"), F.col("n_shingles").alias("nx"), F.col("minima").alias("mx"))
        y = minima_of.select(F.col("node").alias("y"), F.col("n_shingles").alias("ny"), F.col("minima").alias("my"))
        return (
            pairs.join(x, "x")
            .join(y, "y")
            .where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * threshold)
            .where(agreeing >= LEAST_ESTIMATE * 2 * COLLECTION * ROWS)
            .select("x", "y")
            .distinct()
        )

    def texts_of(nodes: DataFrame) -> DataFrame:
        """`node, text`: a text of each class."""
        one = classes.select("node", "doc_id", F.col("text_hash").alias("h"))
        wanted = materialize(one.join(nodes.distinct(), "node", "left_semi"), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        same = (plain.doc_id == wanted.doc_id) & (text_hash() == wanted.h)
        return plain.join(wanted, same).select("node", "text")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y"))
        return materialize(_verified(pairs, _sets(texts_of(wanted), size), threshold), name)

    # First each class meets the bucket's first class it shares most buckets with.
    # Then only first classes of other components remain to be met.
    def joined(links: DataFrame, labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and labels after the true ones of `pairs`."""
        pairs = materialize(likely(pairs), "pairs")
        more = links if pairs.isEmpty() else confirmed(pairs, "edges")
        if more is links or more.isEmpty():
            return links, labels
        links = links.union(more)
        return links, components(links)

    starred = materialize(
        members.where("node <> hub").groupBy("node", "hub").count().withColumnRenamed("count", "shared"), "starred"
    )
    best = starred.groupBy("node").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("m"))
    links = confirmed(materialize(likely(best.select((-F.col("m.hub")).alias("x"), F.col("node").alias("y"))), "best"), "edges")
    labels = components(links)
    apart = (
        starred.join(labels.select(F.col("node"), F.col("component").alias("cr")), "node", "left")
        .join(labels.select(F.col("node").alias("hub"), F.col("component").alias("ch")), "hub", "left")
        .where(F.coalesce("cr", "node") != F.coalesce("ch", "hub"))
        .join(best.select("node", (-F.col("m.hub")).alias("hub")), ["node", "hub"], "left_anti")
    )
    links, labels = joined(links, labels, apart.select(F.col("hub").alias("x"), F.col("node").alias("y")))

    # What the first classes did not join: further members of buckets still open.
    placed = members.join(labels, "node", "left").select(
        "key", "hub", "node", F.coalesce("component", "node").alias("component")
    )
    opened = (
        placed.where("node <> hub")
        .groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("key")
    )
    rest = materialize(placed.join(opened, "key", "left_semi").select("node", "component").distinct(), "open")
    further = _share_rare_shingles(_exploded(texts_of(rest.select("node")), size), rest, threshold)
    links, labels = joined(links, labels, further)

    # A component is named by the smallest id of its documents.
    linked = classes.select("node", "doc_id").join(labels, "node")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("low"))
    low = linked.join(names, "component").select("node", "low")
    of_class = classes.join(low, "node", "left").select(
        "h1", "h2", F.col("n_shingles").alias("n"), F.coalesce("low", "doc_id").alias("component_id")
    )
    same = (signed.h1 == of_class.h1) & (signed.h2 == of_class.h2) & (signed.n_shingles == of_class.n)
    found = signed.join(of_class, same, "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        "text_hash",
    )
