"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes.

Each text is the set of its lower-cased character n-grams, hashed. Features are
multiplied by their naive Bayes log-count ratios, so a logistic regression
starts from what the classes' counts say and only corrects it. The fit reads a
bounded sample of labelled texts; its gradients are summed in tasks, and the driver
holds a few vectors of one number a feature. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.session import materialize

SHORTEST, LONGEST = 3, 7
BITS = 20
#: Most labelled texts of each class that a fit reads.
SAMPLE = {1: 4000, 0: 8000}
#: Features with the most significant ratios stay, others weigh nothing.
FEATURES = 20_000
SMOOTHING = 1.0
LEAST_TEXTS = 3
STRENGTH = 1e-3
#: Most steps of the fit, and the length of the slope at which it ends; steps remembered.
ROUNDS, TOLERANCE, MEMORY = 40, 1e-4, 8
#: Tasks that share the labelled sample.
SPREAD = 12

#: Characters worked on at a time.
_BLOCK = 1 << 19
_WHITE = np.arange(128)
_WHITE = np.where((_WHITE >= 9) & (_WHITE <= 13), 32, _WHITE).astype(np.uint64)


@dataclass
class Model:
    """Weights (ratio times coefficient) of hashed n-grams. Without features the score is constant."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def grams(texts: list[str | None], only: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct hashed n-grams of texts: index of the first text, offsets in it, buckets.

    Yields runs of texts: text i of a run has `buckets[offsets[i]:offsets[i + 1]]`.
    `only` (one flag a bucket) limits what is kept. Null counts as empty.
    """
    at = 0
    while at < len(texts):
        run, size = [], 0
        while at + len(run) < len(texts) and (not run or size < _BLOCK):
            run.append(" " + (texts[at + len(run)] or "").lower() + " ")
            size += len(run[-1])
        lengths = np.array([len(t) for t in run])
        codes = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ascii_ = codes < 128
        codes[ascii_] = _WHITE[codes[ascii_]]
        ends = np.cumsum(lengths)
        text = np.repeat(np.arange(len(run)), lengths)
        room = ends[text] - np.arange(len(codes))
        found = []
        h = codes
        for n in range(2, LONGEST + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n < SHORTEST or not len(h):
                continue
            bucket = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)
            keep = room[: len(h)] >= n
            if only is not None:
                keep &= only[bucket]
            keep = np.flatnonzero(keep)
            found.append((text[keep] << BITS) | bucket[keep])
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        yield at, np.searchsorted(keys, np.arange(len(run) + 1) << BITS), keys & ((1 << BITS) - 1)
        at += len(run)


def _counts(sample: DataFrame) -> DataFrame:
    """`bucket, pos, neg`: texts of each class with the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for at, offsets, buckets in grams(batch.column(0).to_pylist(), None):
                label = np.repeat(labels[at : at + len(offsets) - 1], np.diff(offsets))
                for y in (0, 1):
                    counts[y] += np.bincount(buckets[label == y], minlength=1 << BITS)
        seen = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(seen), 50_000):
            b = seen[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b), pa.array(counts[1][b]), pa.array(counts[0][b])], ["bucket", "pos", "neg"]
            )

    parts = sample.select("text", "label").mapInArrow(run, "bucket BIGINT, pos BIGINT, neg BIGINT")
    return parts.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _ratios(counts: DataFrame) -> DataFrame:
    """`bucket, ratio` of the most significant n-grams."""
    total = counts.agg(F.sum(F.col("pos") + SMOOTHING).alias("p"), F.sum(F.col("neg") + SMOOTHING).alias("q"))
    p, q = total.first()
    pos, neg = F.col("pos") + SMOOTHING, F.col("neg") + SMOOTHING
    ratio = F.log(pos / p) - F.log(neg / q)
    return (
        counts.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS)
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / pos + 1 / neg)).alias("z"))
        .orderBy(F.desc("z"), "bucket")
        .limit(FEATURES)
        .select("bucket", "ratio")
    )


def _design(sample: DataFrame, buckets: np.ndarray) -> DataFrame:
    """`places, label`: which of the features each text has, as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.zeros(1 << BITS, bool)
        only[buckets] = True
        for batch in batches:
            out = []
            for _, offsets, found in grams(batch.column(0).to_pylist(), only):
                places = np.searchsorted(buckets, found).astype(np.int32)
                out += [places[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["places", "label"])

    return sample.select("text", "label").mapInArrow(run, "places BINARY, label INT")


def _loss(design: DataFrame, ratios: np.ndarray, share: dict[int, float], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss at `w` (a weight a feature, and the bias) and its gradient.

    Every task sums over its texts; the driver adds one vector a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ratios)
        scaled, loss, gradient = ratios * w[:k], 0.0, np.zeros(k + 1)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            data, offsets = batch.column(0).buffers()[2], np.frombuffer(batch.column(0).buffers()[1], np.int32)
            offsets = offsets[batch.column(0).offset :][: len(labels) + 1] // 4
            places = np.frombuffer(data or b"", np.int32)
            for i in range(0, len(labels), 256):  # a few texts at a time
                cut = offsets[i : i + 257]
                own = places[cut[0] : cut[-1]]
                row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                y = labels[i : i + 256].astype(float)
                ahead = np.clip(np.bincount(row, scaled[own], len(y)) + w[k], -40, 40)
                each = np.where(y == 1, share[1], share[0])
                loss += float(each @ (np.log1p(np.exp(ahead)) - y * ahead))
                error = each * (1 / (1 + np.exp(-ahead)) - y)
                gradient[:k] += np.bincount(own, error[row], k)
                gradient[k] += error.sum()
        gradient[:k] *= ratios
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])

    parts = design.mapInArrow(run, "loss DOUBLE, gradient BINARY").toArrow()
    loss, gradient = 0.0, np.zeros(len(w))
    for value, part in zip(parts["loss"].to_pylist(), parts["gradient"], strict=True):
        loss += value
        gradient += np.frombuffer(part.as_buffer(), np.float64)
    loss += STRENGTH / 2 * float(w[:-1] @ w[:-1])
    gradient[:-1] += STRENGTH * w[:-1]
    return loss, gradient


def _minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> np.ndarray:
    """Where a smooth convex function is smallest: limited-memory quasi-Newton steps from 0.

    Keeps the last `MEMORY` steps; a step that does not lower the function enough is halved.
    """
    w = np.zeros(size)
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.linalg.norm(slope) < TOLERANCE:
            break
        way, weights = slope.copy(), []
        for s, y in reversed(steps):
            weights.append(s @ way / (s @ y))
            way -= weights[-1] * y
        if steps:
            s, y = steps[-1]
            way *= s @ y / (y @ y)
        else:
            way /= np.linalg.norm(slope)
        for (s, y), weight in zip(steps, reversed(weights), strict=True):
            way += (weight - y @ way / (s @ y)) * s
        length = 1.0
        while True:
            new = w - length * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * length * (slope @ way) or length < 1e-6:
                break
            length /= 2
        if new_value >= value:
            break
        s, y = new - w, new_slope - slope
        w, value, slope = new, new_value, new_slope
        if s @ y > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y)]
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from `labels` (`doc_id`, `label` 0 or 1), joined with the texts of `docs`.

    Of each class at most `SAMPLE` rows are read, those of the smallest hashed
    doc_id; rows with null or another label are ignored. If a class is missing
    the score is constant: 1 when there are only ones, else 0.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id IS NOT NULL").distinct()
    chosen = [
        known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in SAMPLE.items()
    ]
    # At most 12,000 rows of 12 bytes.
    few = F.broadcast(materialize(chosen[0].union(chosen[1]), "labelled"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(few, "doc_id")
    # The sample is dealt out evenly: wherever its texts lay, all tasks share the work on them.
    sample = materialize(texts.select("text", "label").repartition(SPREAD), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), 40.0 if 1 in sizes else -40.0)
    found = _ratios(materialize(_counts(sample), "counts")).toArrow()
    order = np.argsort(found["bucket"].to_numpy())
    buckets, ratios = found["bucket"].to_numpy()[order], found["ratio"].to_numpy()[order]
    # Sums are taken in one order, whatever the order in which the sample was dealt out.
    design = materialize(_design(sample, buckets).sortWithinPartitions("label", "places"), "design")
    share = {y: 0.5 / n for y, n in sizes.items()}
    w = _minimum(lambda at: _loss(design, ratios, share, at), len(ratios) + 1)
    return Model(buckets, w[:-1] * ratios, float(w[-1]))


def score(model: Model, text: str = "text") -> Column:
    """Column of scores from 0 to 1 of the whole texts; null and empty texts get the bias's."""
    buckets, weights, bias = model.buckets, model.weights, model.bias

    @F.arrow_udf(T.DoubleType())
    def scored(batch: pa.Array) -> pa.Array:
        table = Model(buckets, weights, bias).table()
        only = table != 0
        total = np.full(len(batch), bias)
        for at, offsets, found in grams(batch.to_pylist(), only):
            sums = np.append(0.0, np.cumsum(table[found], dtype=np.float64))
            total[at : at + len(offsets) - 1] += sums[offsets[1:]] - sums[offsets[:-1]]
        return pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    return scored(F.col(text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row of `docs`, as `labels.toxic` marks toxicity.

    Learns from the labels of rows that are not `held_out`. Repeated rows are scored each.
    """
    learned = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, learned)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
