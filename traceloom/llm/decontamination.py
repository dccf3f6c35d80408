"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document
frequencies counted over the whole corpus. A distributed randomised SVD of these
passages gives a latent space; every window of every document whose cosine with a
passage reaches `NEAR` there is a candidate. A candidate is confirmed by the
longest common subsequence of words around the window, and for paraphrases by
the passage's ending, its answer.

Passages of fewer than `SHORT` words, which no window's cosine need show, are also
found by their first words, so that every copy of theirs is.

Passages are dealt into blocks of about `BLOCK` with a space of their own, so a
space keeps all directions of its passages. `AT_ONCE` blocks meet the corpus in
one pass; further ones take further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import words as W
from traceloom.session import materialize

BITS = 18
#: Words of a window, half of which it shares with the next.
WINDOW = 32
#: Most words of a passage.
PASSAGE = 64
BLOCK = 200
AT_ONCE = 32
#: Directions sought beyond the number of passages in a block.
EXTRA = 8
#: Runs of words scored at a time.
RUNS = 2048
NEAR = 0.35
#: Share of a passage's words, in order, that confirms a copy.
COPY = 0.7
#: The same for a paraphrase, which must have the passage's last words together.
PARAPHRASE = 0.5
ANSWER = 4
#: Passages of fewer words weigh too little beside the other words of a window: they
#: are also looked up by their first `FIRST` words (all, if fewer), and compared in order
#: with as many words and `SLACK` more.
SHORT, FIRST, SLACK = WINDOW // 2, 4, 4

FOUND = "doc_id BIGINT, item_id BIGINT, at INT, cosine DOUBLE, share DOUBLE, answer BOOLEAN"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with a word of each bucket (at most 2^BITS rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in W.blocks(batch.column(0)):
                words = W.split(data, offsets)
                doc = np.repeat(np.arange(len(offsets) - 1), words.per_doc())
                pairs = np.unique((doc << BITS) | _bucket(words.hashes(lower=True)))
                counts += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], texts))], ["bucket", "n"]
        )

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket BIGINT, n BIGINT")
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    counts = np.zeros(1 << BITS, np.int64)
    counts[buckets[buckets >= 0]] = n[buckets >= 0]
    return int(n[buckets < 0].sum()), counts


def passages(benchmark: DataFrame) -> DataFrame:
    """`item_id, part, hashes`: hashed lower-cased words of runs of at most `PASSAGE` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, part, hashes = [], [], []
            for first, _, data, offsets in W.blocks(batch.column(1)):
                words = W.split(data, offsets)
                every = words.hashes(lower=True)
                for d in range(len(offsets) - 1):
                    own = every[words.first[d] : words.first[d + 1]]
                    for p, piece in enumerate(np.array_split(own, -(-len(own) // PASSAGE) or 1)):
                        if len(piece):
                            item.append(first + d)
                            part.append(p)
                            hashes.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(item, pa.int64())), pa.array(part, pa.int32()), pa.array(hashes, pa.binary())],
                ["item_id", "part", "hashes"],
            )

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInArrow(run, "item_id BIGINT, part INT, hashes BINARY")


def weigh(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and unit-length TF-IDF weights of one passage."""
    features, tf = np.unique(_bucket(hashes), return_counts=True)
    weights = tf * idf[features]
    return features, weights / np.linalg.norm(weights)


def _signs(features: np.ndarray, width: int) -> np.ndarray:
    """Rows of a random matrix of +1 and -1, the same wherever they are made."""
    bits = W.mix(features.astype(np.uint64)[:, None] * np.uint64(1 << 10) + np.arange(width, dtype=np.uint64) + np.uint64(1))
    return np.where(bits & np.uint64(1), 1.0, -1.0)


def _sketch(cut: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """`block, feature, j, value`: the sum over passages a of a' (a S), S random: the range of A'A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            rows = [weigh(np.frombuffer(h.as_buffer(), np.uint64), idf) for h in batch.column(1)]
            for b in np.unique(block):
                own = [rows[i] for i in np.flatnonzero(block == b)]
                features = np.unique(np.concatenate([f for f, _ in own]))
                a = np.zeros((len(own), len(features)))
                for i, (f, w) in enumerate(own):
                    a[i, np.searchsorted(features, f)] = w
                z = a.T @ (a @ _signs(features, width))
                for i in range(0, len(features), 256):
                    part = z[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(part.size, b, np.int64)),
                            pa.array(np.repeat(features[i : i + 256], width)),
                            pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                            pa.array(part.reshape(-1)),
                        ],
                        ["block", "feature", "j", "value"],
                    )

    parts = cut.select("block", "hashes").mapInArrow(run, "block BIGINT, feature BIGINT, j INT, value DOUBLE")
    return parts.groupBy("block", "feature", "j").agg(F.sum("value").alias("value"))


@dataclass
class Space:
    """The latent space of a block of passages, as what it makes of a window's features.

    `scores[f]` is row f of V V'B' (V: right singular vectors, B: passages), so
    the weighted sum over a window's features is its latent dot product with each passage.
    """

    features: np.ndarray
    scores: np.ndarray
    items: list[int | None]
    words: list[np.ndarray]


def _spaces(cut: DataFrame, idf: np.ndarray, width: int) -> list[Space]:
    sketch = _sketch(cut, idf, width).toArrow()
    rows = cut.select("block", "item_id", "part", "hashes").orderBy("block", "item_id", "part").collect()
    out = []
    for b in sorted({r.block for r in rows}):
        mine = sketch.filter(pc.equal(sketch.column("block"), b))
        feature = mine.column("feature").to_numpy()
        features = np.unique(feature)
        y = np.zeros((len(features), width))
        y[np.searchsorted(features, feature), mine.column("j").to_numpy()] = mine.column("value").to_numpy()
        q, _ = np.linalg.qr(y)
        own = [r for r in rows if r.block == b]
        words = [np.frombuffer(r.hashes, np.uint64) for r in own]
        a = np.zeros((len(own), len(features)))
        for i, h in enumerate(words):
            f, w = weigh(h, idf)
            a[i, np.searchsorted(features, f)] = w
        _, sizes, turn = np.linalg.svd(a @ q, full_matrices=False)
        v = q @ turn[sizes > 1e-6 * sizes[0]].T
        out.append(Space(features, (v @ (v.T @ a.T)).astype(np.float32), [r.item_id for r in own], words))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of `a`."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    state, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        if m := masks.get(x):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def _holds(span: np.ndarray, answer: np.ndarray) -> bool:
    n = len(span) - len(answer) + 1
    return n > 0 and bool(np.all([span[i : n + i] == x for i, x in enumerate(answer)], axis=0).any())


def _norm(buckets: np.ndarray, idf: np.ndarray) -> float:
    features, tf = np.unique(buckets, return_counts=True)
    return float(np.linalg.norm(tf * idf[features]))


def _near(space: Space, scaled: np.ndarray, place: np.ndarray, starts: np.ndarray, joins: np.ndarray, energy: np.ndarray):
    """Windows and passages whose cosine may reach `NEAR`, and their dot products.

    `place` has each word's row in `scaled` or -1, `starts` the first word of
    each run (and the end), `joins` whether the next run is of the same text.
    The dot product is a sum over words; `energy`, the sum of squared weights of
    a window's words, is at most its squared length (equal, if no word repeats).
    """
    words = np.flatnonzero(place >= 0)
    bounds = np.searchsorted(words, starts)
    for low in range(0, len(joins), RUNS):
        high = min(low + RUNS, len(joins))
        upto = min(high + 1, len(joins))
        sums = np.zeros((upto - low + 1, scaled.shape[1]), np.float32)
        cut = bounds[low : upto + 1]
        full = np.flatnonzero(cut[1:] > cut[:-1])
        if not len(full):
            continue
        rows = scaled[place[words[cut[0] : cut[-1]]]]
        sums[full] = np.add.reduceat(rows, cut[full] - cut[0], axis=0)
        dots = sums[: high - low] + sums[1 : high - low + 1] * joins[low:high, None]
        window, passage = np.nonzero(dots >= NEAR * np.sqrt(energy[low:high, None]))
        hit = dots[window, passage]
        positive = hit > 0
        yield window[positive] + low, passage[positive], hit[positive]


@dataclass
class Short:
    """Passages too short to stand out in a window: they are looked up by their first words.

    `first[k]`: sorted hashes of the first k words, and the passage of each.
    """

    first: dict[int, tuple[np.ndarray, np.ndarray]]
    items: list[int | None]
    words: list[np.ndarray]

    def places(self, words: W.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, float, bool]]:
        """Document, passage, word, share and answer of copies; of a passage in a document none after a whole one."""
        whole = set()
        for k, (wanted, passage) in self.first.items():
            at, grams = words.windows(hashes, k)
            low, high = np.searchsorted(wanted, grams, "left"), np.searchsorted(wanted, grams, "right")
            for hit in np.flatnonzero(high > low):
                where = int(at[hit])
                doc = int(np.searchsorted(words.first, where, "right")) - 1
                for i in passage[low[hit] : high[hit]].tolist():
                    if (doc, i) in whole:
                        continue
                    item = self.words[i]
                    span = hashes[where : min(words.first[doc + 1], where + len(item) + SLACK)]
                    share, answer = common(item, span) / len(item), _holds(span, item[-ANSWER:])
                    if share >= COPY or share >= PARAPHRASE and answer:
                        if share == 1:
                            whole.add((doc, i))
                        yield doc, i, int(where - words.first[doc]), share, answer


def _short(cut: DataFrame) -> Short:
    """The passages of fewer than `SHORT` words. `cut` holds the passages of a pass."""
    brief = cut.where(F.length("hashes") < 8 * SHORT).select("item_id", "part", "hashes").orderBy("item_id", "part").collect()
    words = [np.frombuffer(r.hashes, np.uint64) for r in brief]
    first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in sorted({min(len(h), FIRST) for h in words}):
        own = [i for i, h in enumerate(words) if min(len(h), FIRST) == k]
        grams = np.array([W.rolling(words[i][:k], k)[0] for i in own], np.uint64)
        order = np.argsort(grams, kind="stable")
        first[k] = grams[order], np.array(own)[order]
    return Short(first, [r.item_id for r in brief], words)


def _search(docs: DataFrame, spaces: list[Space], short: Short, idf: np.ndarray) -> DataFrame:
    half = WINDOW // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = idf**2
        rows = np.full((len(spaces), 1 << BITS), -1, np.int32)
        scaled = []
        for s, space in enumerate(spaces):
            rows[s, space.features] = np.arange(len(space.features))
            scaled.append((idf[space.features][:, None] * space.scores).astype(np.float32))
        for batch in batches:
            found: list[tuple] = []
            for first, _, data, offsets in W.blocks(batch.column(1)):
                words = W.split(data, offsets)
                if not len(words):
                    continue
                hashes = words.hashes(lower=True)
                bucket = _bucket(hashes)
                # Runs of half a window from each text's start; a window is a run and the next.
                n = words.per_doc()
                runs = -(-n // half)
                doc = np.repeat(np.arange(len(n)), runs)
                within = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
                begin = words.first[doc] + within * half
                stop = np.minimum(begin + WINDOW, words.first[doc + 1])
                joins = np.append(doc[1:] == doc[:-1], False)
                total = np.append(0, np.cumsum(square[bucket]))
                energy = total[stop] - total[begin]
                starts = np.append(begin, len(words))
                for d, i, at, share, answer in short.places(words, hashes):
                    found.append((first + d, short.items[i], at, 1.0, share, answer))
                for s, space in enumerate(spaces):
                    for windows, hits, dots in _near(space, scaled[s], rows[s][bucket], starts, joins, energy):
                        length = {w: _norm(bucket[begin[w] : stop[w]], idf) for w in np.unique(windows).tolist()}
                        for w, i, dot in zip(windows.tolist(), hits.tolist(), dots.tolist(), strict=True):
                            cosine = dot / length[w]
                            if cosine < NEAR:
                                continue
                            item = space.words[i]
                            low = max(words.first[doc[w]], begin[w] - len(item))
                            span = hashes[low : min(words.first[doc[w] + 1], stop[w] + len(item))]
                            share = common(item, span) / len(item)
                            if share < PARAPHRASE:
                                continue
                            answer = _holds(span, item[-ANSWER:])
                            if share >= COPY or answer:
                                at = int(begin[w] - words.first[doc[w]])
                                found.append((first + doc[w], space.items[i], at, cosine, share, answer))
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[0] = batch.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "at", "cosine", "share", "answer"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, at, cosine, share, answer`: benchmark items found in documents.

    One row per pair, of its window with the largest share of the item's words
    in common order; `at` is the window's first word. Words are lower-cased and
    cut at white space. Items and documents without words are never found; rows
    that share an id (or have none) count as one. Without items there are no rows.
    """
    docs = docs.select("doc_id", "text")
    empty = docs.sparkSession.createDataFrame([], FOUND)
    cut = materialize(passages(benchmark).distinct(), "passages")
    n = cut.count()
    if not n:
        return empty
    texts, counts = frequencies(docs)
    idf = np.log((texts + 1) / (counts + 0.5)).clip(0.01)
    blocks = -(-n // BLOCK)
    cut = materialize(cut.withColumn("block", F.pmod(F.xxhash64("hashes"), F.lit(blocks))), "passages")
    width = cut.groupBy("block").count().agg(F.max("count")).first()[0] + EXTRA
    found = None
    for low in range(0, blocks, AT_ONCE):
        some = cut.where((F.col("block") >= low) & (F.col("block") < low + AT_ONCE))
        # Written before the next pass starts, so that the driver holds the spaces of one pass only.
        part = materialize(_search(docs, _spaces(some, idf, width), _short(some), idf), "found")
        found = part if found is None else found.union(part)
    best = F.max(F.struct("share", "cosine", (-F.col("at")).alias("back"), "answer")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        (-F.col("m.back")).alias("at"),
        F.col("m.cosine").alias("cosine"),
        F.col("m.share").alias("share"),
        F.col("m.answer").alias("answer"),
    )
