"""Repeated word windows across documents, by super-k-mer partitioning.

A window's minimiser is the smallest hash of its word groups. Consecutive
windows that share it form a super-k-mer. A minimiser that has one super-k-mer,
and one in which no word group comes again, has no repeated window. Super-k-mers
of all others are packed: as one string of their words, to the bucket of the
minimiser. There their windows are sorted, and
all but the first place of each is marked.

A minimiser with more than `HOT` super-k-mers would fill a bucket; its windows
are counted one by one instead, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import words as W
from traceloom.session import materialize

WINDOW = 20
#: Words of a group; a window has WINDOW - GROUP + 1 of them.
GROUP = 4
HOT = 20_000
#: Super-k-mers of a bucket, on average.
BUCKET = 20_000
_SALT = 0x6A09E667F3BCC909


def _super_kmers(docs: DataFrame) -> DataFrame:
    """`minimiser, id, text_hash, start, n, again`: runs of n windows from word `start`.

    `again` says that a word group comes again within a window's length.
    """
    groups = WINDOW - GROUP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in W.blocks(batch.column(2)):
                words = W.split(data, offsets)
                at = words.inside(WINDOW)
                if not len(at):
                    continue
                least = grams = W.rolling(words.hashes(), GROUP)
                width = 1
                while 2 * width <= groups:
                    least = np.minimum(least[:-width], least[width:])
                    width *= 2
                least = np.minimum(least[: len(least) - (groups - width)], least[groups - width :])[at]
                doc = np.searchsorted(words.first, at, "right") - 1
                new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
                n = np.diff(np.append(new, len(at)))
                again = np.zeros(len(grams) + 1, np.int64)
                for d in range(1, min(groups, len(grams) - 1) + 1):
                    again[1 : len(grams) - d + 1] |= grams[:-d] == grams[d:]
                again = np.cumsum(again)
                again = again[at[new] + n + groups - 1] > again[at[new]]
                row = pa.array(low + doc[new])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(least[new])),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array((at[new] - words.first[doc[new]]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(again),
                    ],
                    ["minimiser", "id", "text_hash", "start", "n", "again"],
                )

    return docs.select("id", "text_hash", "text").mapInArrow(
        run, "minimiser BIGINT, id BIGINT, text_hash BIGINT, start INT, n INT, again BOOLEAN"
    )


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`minimiser, id, text_hash, start, packed`: the words of the wanted super-k-mers."""
    of = wanted.groupBy("id", "text_hash").agg(F.collect_set(F.struct("minimiser", "start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(3)[i].as_py().encode().split()
                text = b" ".join(words)
                place = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
                runs = batch.column(4)[i].values
                minimiser, start, n = (runs.field(f) for f in range(3))
                low = start.to_numpy()
                begin, end = place[low], place[low + n.to_numpy() + WINDOW - 1] - 1
                count = len(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        minimiser,
                        pa.repeat(batch.column(1)[i], count),
                        pa.repeat(batch.column(2)[i], count),
                        start,
                        pa.array([text[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
                    ],
                    ["minimiser", "id", "text_hash", "start", "packed"],
                )

    return (
        docs.join(of, ["id", "text_hash"])
        .select("doc_id", "id", "text_hash", "text", "runs")
        .mapInArrow(run, "minimiser BIGINT, id BIGINT, text_hash BIGINT, start INT, packed BINARY")
    )


def _windows(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and two hashes of all windows of packed words."""
    parts = []
    for low, _, data, offsets in W.blocks(packed):
        words = W.split(data, offsets)
        hashes = words.hashes()
        at, one = words.windows(hashes, WINDOW)
        row = np.searchsorted(words.first, at, "right") - 1
        parts.append((low + row, at - words.first[row], one, words.windows(hashes, WINDOW, _SALT)[1]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _intervals(table: pa.Table) -> pa.Table:
    """Of one bucket, the words `low` to `high` (exclusive) of runs of repeated windows."""
    ids, starts = table.column("id").to_numpy(), table.column("start").to_numpy().astype(np.int64)
    row, offset, one, two = _windows(table.column("packed").combine_chunks())
    doc, place = ids[row], starts[row] + offset
    order = np.lexsort((place, doc, two, one))
    one, two, doc, place = one[order], two[order], doc[order], place[order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeated = np.empty(len(order), bool)
    repeated[order] = (doc != doc[first]) | (place != place[first])
    row, offset = row[repeated], offset[repeated]
    begin = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(row)]
    end = np.append(begin[1:], True)[: len(row)]
    of = row[begin]
    return pa.table(
        {
            "id": ids[of],
            "text_hash": table.column("text_hash").to_numpy()[of],
            "low": starts[of] + offset[begin],
            "high": starts[of] + offset[end] + WINDOW,
        }
    )


def _singly(packed: DataFrame) -> DataFrame:
    """Intervals of hot minimisers: each window's first place is found by a combining aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, offset, one, two = _windows(batch.column(4))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(one)),
                        pa.array(W.signed(two)),
                        batch.column(1).take(pa.array(row)),
                        batch.column(2).take(pa.array(row)),
                        pa.array(batch.column(3).to_numpy()[row].astype(np.int64) + offset),
                    ],
                    ["one", "two", "id", "text_hash", "place"],
                )

    schema = "one BIGINT, two BIGINT, id BIGINT, text_hash BIGINT, place BIGINT"
    windows = materialize(packed.mapInArrow(run, schema), "windows")
    place = F.struct("id", "place")
    first = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = windows.join(first, ["one", "two"]).where(place > F.col("first"))
    return later.select("id", "text_hash", F.col("place").alias("low"), (F.col("place") + WINDOW).alias("high"))


def repeated_words(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """`id, text_hash, low, high` intervals of words to remove, of `doc_id, id, text_hash, text`."""
    supers = materialize(_super_kmers(docs), "supers")
    often = supers.groupBy("minimiser").agg(F.count("*").alias("often"), F.max("again").alias("again"))
    often = often.where("often > 1 OR again").select("minimiser", "often")
    often = materialize(often, "often")
    few, many = often.where(F.col("often") <= hot), often.where(F.col("often") > hot)
    wanted = supers.join(few, "minimiser", "left_semi")
    total = often.where(F.col("often") <= hot).agg(F.sum("often")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("minimiser"), F.lit(max(1, -(-total // BUCKET))))
    found = (
        _packed(docs, wanted)
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInArrow(_intervals, "id BIGINT, text_hash BIGINT, low BIGINT, high BIGINT")
    )
    if many.isEmpty():
        return found
    return found.union(_singly(_packed(docs, supers.join(many, "minimiser", "left_semi"))))


def drop_repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, text` of each row of `doc_id, text`.

    Removed is each word that a window of `WINDOW` words covers whose words also
    start earlier: in a smaller doc_id, or earlier in the same document. `text`
    is the rest, joined by spaces. Rows with equal doc_id and text are one place
    and don't repeat each other; a null doc_id counts as the smallest; a null
    text has no words. Windows are compared by 128 bits of hash.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gone = repeated_words(plain, hot)
    gone = gone.groupBy("id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    joined = plain.join(gone, ["id", "text_hash"], "left").select("doc_id", "id", "text_hash", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, rest = [], [], [], []
            for i in range(batch.num_rows):
                words = batch.column(3)[i].as_py().encode().split()
                n_words.append(len(words))
                if batch.column(4)[i].is_valid:
                    keep = np.ones(len(words), bool)
                    runs = batch.column(4)[i].values
                    for low, high in zip(runs.field(0).to_pylist(), runs.field(1).to_pylist(), strict=True):
                        keep[low:high] = False
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                text = b" ".join(words)
                sha.append(hashlib.sha256(text).hexdigest())
                rest.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
            )

    return joined.mapInArrow(run, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_sha256 STRING, text STRING")
