"""Hard negatives by exact integer scores: Strassen products of anchor and candidate tiles.

Anchors are dealt into blocks of bounded size, and every block meets all rows in
two passes: the first finds each anchor's best rows of its own label, the second
the best rows of other labels whose score lies in the window that a positive sets.
A task streams candidates past the block and keeps, for every anchor, a heap of
bounded size; the heaps of all tasks are merged by a window over the anchor.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part. Shorter vectors are padded with zeros, an
empty one scores 0. Rows are told apart as rows: repeated rows each take part,
and a repeated anchor has its results once for each of its rows. Rows of the
anchor's own id are none of its positives. Other columns are ignored. Scores
beyond +-`LARGEST` count as `LARGEST`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import materialize

#: Bytes of an anchor block, which the driver reads and every task receives.
BLOCK_BYTES = 8 << 20
#: Rows on either side of a tile.
TILE = 1024
#: Sides up to this length are multiplied directly.
LEAF = 16
#: Largest score told apart; a hundred times it still fits 64 bits.
LARGEST = (1 << 63) // 101
_NONE, _NO_ID = np.int64(-(1 << 63) + 1), np.int64((1 << 63) - 1)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices modulo 2 ** 64, with seven products for eight at every level.

    Sides are padded with zeros so that they can be halved until the shortest is
    at most `leaf`.
    """
    (m, d), n = a.shape, b.shape[1]
    levels, shortest = 0, min(m, d, n)
    while shortest >> levels > leaf:
        levels += 1
    unit = 1 << levels
    mp, dp, npad = (-(-x // unit) * unit for x in (m, d, n))
    if (mp, dp, npad) != (m, d, n):
        a = np.pad(a, ((0, mp - m), (0, dp - d)))
        b = np.pad(b, ((0, dp - d), (0, npad - n)))
    return _product(a, b, levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return np.einsum("ij,jk->ik", a, b)
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:d, :n], b[:d, n:], b[d:, :n], b[d:, n:]
    p1 = _product(a11 + a22, b11 + b22, levels - 1)
    p2 = _product(a21 + a22, b11, levels - 1)
    p3 = _product(a11, b12 - b22, levels - 1)
    p4 = _product(a22, b21 - b11, levels - 1)
    p5 = _product(a11 + a12, b22, levels - 1)
    p6 = _product(a21 - a11, b11 + b12, levels - 1)
    p7 = _product(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered float64 vectors, as int64 up to +-`LARGEST`."""
    most = np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * max(1, anchors.shape[1])
    out = strassen(_modular(anchors), _modular(rows).T)
    if most >= LARGEST:
        with np.errstate(over="ignore", invalid="ignore"):
            about = anchors @ rows.T
        out = np.where(about >= LARGEST, LARGEST, np.where(about <= -LARGEST, -LARGEST, out))
    return out


def _modular(values: np.ndarray) -> np.ndarray:
    """Whole-numbered floats as int64 modulo 2 ** 64."""
    if np.abs(values).max(initial=0.0) < 2.0**62:
        return values.astype(np.int64)
    return np.remainder(values, 2.0**64).astype(np.uint64).view(np.int64)


class Heap:
    """The first `size` (score, id) of each of `n` keys: higher scores first, then smaller ids."""

    def __init__(self, n: int, size: int) -> None:
        self.score = np.full((n, size), _NONE)
        self.id = np.full((n, size), _NO_ID)

    def offer(self, at: slice, tile: np.ndarray, ids: np.ndarray) -> None:
        """Take the best of a tile of scores for the keys `at`; `ids` ascend, `tile` is used up."""
        row, size = np.arange(len(tile)), self.score.shape[1]
        score, found = np.empty((len(tile), size), np.int64), np.empty((len(tile), size), np.int64)
        for k in range(size):
            best = tile.argmax(1)  # the first of equal scores has the smallest id
            score[:, k] = tile[row, best]
            found[:, k] = np.where(score[:, k] == _NONE, _NO_ID, ids[best])
            tile[row, best] = _NONE
        self.merge(at, score, found)

    def merge(self, at: slice, score: np.ndarray, found: np.ndarray) -> None:
        score = np.concatenate([self.score[at], score], 1)
        found = np.concatenate([self.id[at], found], 1)
        order = np.lexsort((found, -score), 1)[:, : self.score.shape[1]]
        self.score[at] = np.take_along_axis(score, order, 1)
        self.id[at] = np.take_along_axis(found, order, 1)

    def batch(self) -> pa.RecordBatch:
        key, _ = held = np.nonzero(self.score != _NONE)
        columns = [key.astype(np.int32), self.score[held], self.id[held]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "score", "vec_id"])


def _matrix(column: pa.Array, dim: int | None, scale: int) -> np.ndarray:
    """floor(scale * x) of list rows as float64, cut or padded with zeros to `dim` columns."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(lengths.max(initial=0)) if dim is None else dim
    with np.errstate(over="ignore"):
        values = np.floor(scale * values)
    values = np.clip(values, np.finfo(float).min, np.finfo(float).max)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    inside = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    row, at = np.nonzero(inside)
    out[row[at < dim], at[at < dim]] = values[at < dim]
    return out


class _Block:
    """Anchors as arrays, and the passes over candidate batches."""

    def __init__(self, rows: pa.Table, scale: int) -> None:
        rows = rows.combine_chunks()
        self.ids = rows["vec_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        vectors = rows["vector"].combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
        self.vectors = _matrix(vectors, None, scale)
        self.scale = scale

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors, scores, ids and labels of every tile; ids ascend inside a tile."""
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], batch["label"].to_numpy()[order]
            vectors = _matrix(batch["vector"], self.vectors.shape[1], self.scale)[order]
            for c in range(0, len(ids), TILE):
                for a in range(0, len(self.ids), TILE):
                    at = slice(a, min(a + TILE, len(self.ids)))
                    yield at, scores(self.vectors[at], vectors[c : c + TILE]), ids[c : c + TILE], labels[c : c + TILE]

    def positives(self, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        heap = Heap(len(self.ids), size)
        for at, score, ids, labels in self.tiles(batches):
            allowed = (labels == self.labels[at, None]) & (ids != self.ids[at, None])
            heap.offer(at, np.where(allowed, score, _NONE), ids)
        yield heap.batch()

    def negatives(
        self, batches: Iterator[pa.RecordBatch], windows: list[tuple[np.ndarray, np.ndarray]], size: int
    ) -> Iterator[pa.RecordBatch]:
        """Heaps of every window (lowest, highest score of each anchor); key: anchor * windows + window."""
        heaps = [Heap(len(self.ids), size) for _ in windows]
        for at, score, ids, labels in self.tiles(batches):
            other = labels != self.labels[at, None]
            for heap, (low, high) in zip(heaps, windows, strict=True):
                allowed = other & (score >= low[at, None]) & (score <= high[at, None])
                heap.offer(at, np.where(allowed, score, _NONE), ids)
        for number, heap in enumerate(heaps):
            found = heap.batch()
            key = pa.array(found["key"].to_numpy().astype(np.int64) * len(windows) + number)
            yield pa.RecordBatch.from_arrays([key, found["score"], found["vec_id"]], names=["key", "score", "vec_id"])


def _first(heaps: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged: `key, rank, score, vec_id`."""
    along = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= size)


def usable(rows: DataFrame, vec_id: str, label: Column | str, vector: str) -> DataFrame:
    """`vec_id, label, vector` of the rows that take part."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    label = F.col(label) if isinstance(label, str) else label
    return rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).alias("vector")
    )


def mine(
    rows: DataFrame,
    anchors: Column | str,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `rows` are those of `usable`; `anchors` tells the query rows by `vec_id`. A
    component x counts as floor(scale * x). An anchor's positives are the first
    `positives` rows of its label by inner product; negatives of a positive are
    the first `negatives` rows of other labels that score between the two
    percentages of the positive's score. Higher scores come first, then smaller ids.
    """
    spark = rows.sparkSession
    queries = rows.where(anchors)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    per_block = max(1, BLOCK_BYTES // (8 * max(1, size["dim"] or 0)))
    blocks = -(-size["n"] // per_block)
    dealt = queries.repartition(max(1, blocks)).withColumn("block", F.spark_partition_id())
    dealt = materialize(dealt, "anchors")
    done = []
    for number in range(blocks):
        block = _Block(dealt.where(F.col("block") == number).drop("block").toArrow(), scale)
        done.append(_block_negatives(rows, block, positives, negatives, window))
    if not done:
        schema = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, done)


def _block_negatives(
    rows: DataFrame, block: _Block, positives: int, negatives: int, window: tuple[int, int]
) -> DataFrame:
    """Both passes of one block of anchors over all rows; the result is written before the next block starts."""
    spark, n = rows.sparkSession, len(block.ids)
    heaps = rows.mapInArrow(lambda batches: block.positives(batches, positives), "key INT, score BIGINT, vec_id BIGINT")
    best = _first(heaps, positives).toArrow()  # at most `positives` rows of each anchor of the block
    key, slot = best["key"].to_numpy(), best["rank"].to_numpy() - 1
    found, score = np.full((n, positives), _NO_ID), np.zeros((n, positives), np.int64)
    low, high = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # empty windows
    found[key, slot], score[key, slot] = best["vec_id"].to_numpy(), best["score"].to_numpy()
    low[key, slot] = -(-window[0] * score[key, slot] // 100)
    high[key, slot] = window[1] * score[key, slot] // 100
    windows = [(low[:, k].copy(), high[:, k].copy()) for k in range(positives)]
    heaps = rows.mapInArrow(
        lambda batches: block.negatives(batches, windows, negatives), "key BIGINT, score BIGINT, vec_id BIGINT"
    )
    at, k = np.nonzero(low <= high)
    pairs = pa.table(
        {
            "key": at * positives + k,
            "anchor_id": block.ids[at],
            "positive_id": found[at, k],
            "positive_score": score[at, k],
        }
    )
    pairs = spark.createDataFrame(pairs)
    out = (
        _first(heaps, negatives)
        .join(F.broadcast(pairs), "key")  # a few numbers for each anchor of the block
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    return materialize(out, "negatives")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The digest of the contract: rows of ids divisible by 50 are anchors, labels of ids divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(embeddings, "vec_id", label, "embedding"), F.col("vec_id") % 50 == 0)
