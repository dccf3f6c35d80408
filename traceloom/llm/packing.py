"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Packing only needs the lengths: rows without ids are dealt into shards of
bounded size and each is packed in one task. A shard leaves at most its last
sequences part full.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import materialize

LENGTH = 2048
#: Pieces packed together. More fit a little more tightly and take longer in one task.
SHARD = 1 << 15

PLACED = (
    "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, sequence_id BIGINT, offset BIGINT"
)


def public_bpe() -> tuple:
    """The public byte-level vocabulary, at the same place on every machine: arguments of `encoder`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


def encoder(path: str, pattern: str, special: dict[str, int]) -> Callable[[str], list[int]]:
    """The byte-level BPE of a file of ranks. Texts that hold a special token get its id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)
    return lambda text: encoding.encode(text, allowed_special=names, disallowed_special=())


def pieces(docs: DataFrame, tokenizer: tuple, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` (and `ids`) of each row of `docs`.

    A document is the ids of its text (null: empty) and a last id 0. Documents
    over `length` ids are cut; their first piece takes the remainder. `tokenizer`
    holds the arguments of `encoder`.
    """
    schema = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT" + ", ids ARRAY<INT>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*tokenizer)
        for batch in batches:
            of, piece, start, size, crc, out = [], [], [], [], [], []
            for i in range(batch.num_rows):
                tokens = np.array([*encode(batch.column(1)[i].as_py() or ""), 0], np.uint32)
                begin, number = 0, 0
                end = len(tokens) % length or length
                while begin < len(tokens):
                    part = tokens[begin:end]
                    of.append(i)
                    piece.append(number)
                    start.append(begin)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if ids:
                        out.append(part.astype(np.int32))
                    begin, end, number = end, end + length, number + 1
            columns = [
                batch.column(0).take(pa.array(of, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, size, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; every item is at most `size` long.

    A bin takes the largest item left, then again and again the largest that
    still fits. Then its smallest item (not the only one) is exchanged for the
    two items left that fill the widened gap most tightly, if they fill more.
    """
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1)
    first = np.zeros(size + 2, np.int64)  # of each length: its next item in `order`
    first[:-1] = len(lengths) - np.cumsum(left)
    below = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))  # largest length left up to here
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            smaller, stop = below[n - 1], n
            while stop <= size and below[stop] == n:
                stop += 1
            below[n:stop] = smaller

    def give_back(n: int) -> None:
        left[n] += 1
        if left[n] == 1:
            stop = n
            while stop <= size and below[stop] < n:
                stop += 1
            below[n:stop] = n

    number = 0
    while below[size]:
        inside, room = [], size
        while n := int(below[room]):
            take(n)
            inside.append(n)
            room -= n
        if room and len(inside) > 1:
            least = inside[-1]
            gap = room + least
            a = np.arange(1, gap)
            b = below[gap - a]
            fits = (left[a] > 0) & (b > 0) & ((a != b) | (left[a] > 1))
            sums = np.where(fits, a + b, 0)
            if len(sums) and sums.max() > least:
                one = int(sums.argmax()) + 1
                two = int(b[one - 1])
                inside.pop()
                take(one)
                take(two)
                give_back(least)
                inside += [one, two]
        at = 0
        for n in inside:
            item = order[first[n]]
            first[n] += 1
            bins[item], offsets[item] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`.

    Full pieces are sequences of their own. Others are dealt by hash into shards
    of about `SHARD` pieces. Sequences are numbered from 0 within a shard of
    2^32 numbers, so their numbers have gaps.
    """
    spark = cut.sparkSession
    count = cut.where(F.col("length") < length).count()
    shards = max(1, -(-count // SHARD))
    full = cut.where(F.col("length") >= length).select(
        *cut.columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id BIGINT, offset BIGINT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        shard = table.column("__shard")[0].as_py()
        bins, offsets = best_two_fit(table.column("length").to_numpy(), length)
        table = table.drop_columns(["__shard"])
        table = table.append_column("sequence_id", pa.array(bins + (shard << 32)))
        yield from table.append_column("offset", pa.array(offsets)).to_batches(max_chunksize=10_000)

    part = cut.where(F.col("length") < length).withColumn("__shard", key)
    packed = part.groupBy("__shard").applyInArrow(lambda table: pa.Table.from_batches(run(table.to_batches())), schema)
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: tuple, length: int = LENGTH) -> DataFrame:
    """Every piece of every row of `docs` with its place: the columns of `PLACED`.

    A sequence holds at most `length` ids without gaps. Repeated rows are packed
    each. An empty text is the id 0 alone.
    """
    return pack(materialize(pieces(docs, tokenizer, length), "pieces"), length)


def sequences(docs: DataFrame, tokenizer: tuple, length: int = LENGTH) -> DataFrame:
    """`sequence_id, ids, doc_ids`: the ids of each sequence in order, and whose they are."""
    placed = pack(materialize(pieces(docs, tokenizer, length, ids=True), "pieces"), length)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))  # at most `length` rows
    return placed.groupBy("sequence_id").agg(inside.alias("s")).select(
        "sequence_id", F.flatten("s.ids").alias("ids"), F.col("s.doc_id").alias("doc_ids")
    )
