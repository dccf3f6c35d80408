"""Spelling variants of a corpus' words by an index of variable-length grams.

Words are padded with an end mark on either side. From each position a gram grows
from `QMIN` letters while it is still a frequent one, up to `QMAX`; the dictionary
that steers this holds only grams frequent enough for its size to be bounded. One
edit changes only grams that cover its place, so a word shares all but its most
covered place's grams with any near word: at least four of the grams of a word of
seven letters. Grams are ranked rare first, hence near words have two grams in
common among the few rarest of each; the lists of such pairs of grams are merged
with the places of the grams, and what is left is compared letter by letter. A
pair of grams with more than `HOT` words is not expanded: its words are merged by
three grams, then by four.

Defined results: null and empty texts have no words, a null id counts as an empty
one, repeated rows count each; other columns are ignored. Words hold letters up to
U+00FF only. Of near words with equal counts the first in code-point order is taken.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.words import blocks, mix, split, texts
from traceloom.session import materialize, shuffle_width

#: Shortest words grouped, in code points: two to four grams of theirs survive any edit.
MIN_LENGTH = 7
QMIN, QMAX = 2, 4
#: The dictionary holds grams that make up more than 1 / FREQUENT of all grams: fewer than this many.
FREQUENT = 150_000
#: Words with the same pair of grams that are compared directly.
HOT = 20_000
#: Bytes of text whose words are counted at a time.
TEXT_BLOCK = 4 << 20
#: Postings merged at a time, and letters compared at a time.
CHUNK, CELLS = 200_000, 4_000_000
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF; their second bytes are 0x80 to 0xBF

_codes = np.arange(256)
_LETTER = ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A))
_LOWER = (_codes + 32 * ((_codes >= 0x41) & (_codes <= 0x5A))).astype(np.uint8)
_CRC = _codes.astype(np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end], going on from the values `before`."""
    size = end - start
    crc = before.astype(np.uint32)
    long = size > 64
    for i in np.flatnonzero(long):
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    order = np.argsort(-size[~long], kind="stable")
    order = np.flatnonzero(~long)[order]
    state, at, size = ~crc[order], start[order], size[order]
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -j))  # words longer than j come first
        byte = data[at[:n] + j]
        state[:n] = _CRC[(state[:n] ^ byte) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    crc[order] = ~state
    return crc


def _count(batches: Iterator[pa.RecordBatch], min_length: int, every: int) -> Iterator[pa.RecordBatch]:
    """`word, n` of each block of texts; every `every`-th run by hash loses a letter."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, last, data, offsets in blocks(batch.column(1), TEXT_BLOCK):
            if not len(data):
                continue
            lead = data == _LEAD
            inside = _LETTER[data] | lead
            inside[1:] |= lead[:-1]
            low = np.where(inside, _LOWER[data], np.uint8(0x20))
            found = split(low, offsets)
            leads = np.zeros(len(data) + 1, np.int64)
            np.cumsum(lead, out=leads[1:])
            length = (found.end - found.start) - (leads[found.end] - leads[found.start])
            chosen = length >= min_length
            start, end, length = found.start[chosen], found.end[chosen], length[chosen]
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first:last]], np.uint32)
            doc = np.repeat(np.arange(last - first), found.per_doc())[chosen]
            crc = _crc32(low, start, end, prefix[doc])
            hit = crc % np.uint32(every) == 0
            shortened: Counter[str] = Counter()
            for i in np.flatnonzero(hit & (length > min_length)):
                word = low[start[i] : end[i]].tobytes().decode()
                cut = int(crc[i]) % int(length[i])
                shortened[word[:cut] + word[cut + 1 :]] += 1
            counts = pc.value_counts(_strings(low, start[~hit], end[~hit]))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])
            if shortened:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shortened.keys(), pa.string()), pa.array(shortened.values(), pa.int64())], names=["word", "n"]
                )


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """data[start:end] of ascending, disjoint ranges as an Arrow array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = 2, every: int = 31) -> DataFrame:
    """`word, n` of the runs of letters in `text`, lower-cased in A-Z; rare and short ones left out.

    A run whose crc32 of `<doc_id>:<run>` is divisible by `every` loses the code
    point at crc32 % length first.
    """
    runs = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(
        lambda batches: _count(batches, min_length, every), "word STRING, n BIGINT"
    )
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a UTF-8 column as one byte a letter, and where each begins."""
    data, offsets = texts(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    lead = data == _LEAD
    before = np.concatenate([[0], np.cumsum(lead)])
    letters = data[~lead].copy()
    letters[letters >= 0x80] += 0x40
    return letters, offsets - before[offsets]


def _by_length(letters: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their numbers, and their letters between end marks, a row each."""
    size = np.diff(offsets)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, CELLS // int(n + 2))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            out = np.empty((len(some), n + 2), np.uint32)
            out[:, 0], out[:, -1] = 1, 2
            out[:, 1:-1] = letters[offsets[some][:, None] + np.arange(n)]
            yield some, out


def _grams(padded: np.ndarray) -> list[np.ndarray]:
    """Grams of 2, 3 and 4 letters from each position, as numbers; 0 where the word ends before."""
    width = padded.shape[1]
    grams = [np.zeros((len(padded), width - 1), np.uint32) for _ in range(QMIN, QMAX + 1)]
    code = padded
    for size, out in enumerate(grams, QMIN):
        code = (code[:, : width - size + 1] << np.uint32(8)) | padded[:, size - 1 :]
        out[:, : width - size + 1] = code
    return grams


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [g[g > 0] for _, padded in _by_length(*_letters(batch.column(0))) for g in _grams(padded)]
        if codes:
            gram, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], names=["gram", "n"])


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> np.ndarray:
    """The frequent grams, rarest first; fewer than `frequent`, whatever the words."""
    grams = words.select("word").mapInArrow(_gram_counts, "gram BIGINT, n BIGINT")
    grams = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    return grams.where(F.col("n") > total // frequent).orderBy("n", "gram").toArrow()["gram"].to_numpy()


def _decompose(padded: np.ndarray, dictionary: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram and rank of the gram from each position, and the most grams that cover one letter.

    `dictionary`: the frequent grams in order, and their ranks from 1; others have rank 0.
    """
    codes, rank = dictionary

    def place(gram: np.ndarray) -> np.ndarray:
        at = np.searchsorted(codes, gram)
        at[at == len(codes)] = 0
        return np.where(codes[at] == gram, rank[at], 0) if len(codes) else np.zeros(gram.shape, np.int64)

    grams = _grams(padded)
    gram, frequency = grams[0], place(grams[0])
    size = np.full(gram.shape, QMIN)
    growing = frequency > 0
    for longer in grams[1:]:
        growing = growing & (longer > 0)
        gram = np.where(growing, longer, gram)
        found = place(longer)
        frequency = np.where(growing, found, frequency)
        size += growing
        growing = growing & (found > 0)
    cover = np.zeros(padded.shape, np.int64)
    for d in range(QMAX):
        cover[:, d : gram.shape[1] + d] += (size > d)[:, : padded.shape[1] - d]
    return gram, frequency, cover[:, 1:-1].max(1)


def _bijection(x: np.ndarray) -> np.ndarray:
    """32-bit numbers in another, fixed order."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return x ^ (x >> np.uint32(16))


def _postings(batches: Iterator[pa.RecordBatch], dictionary: tuple, arity: int) -> Iterator[pa.RecordBatch]:
    """`key, at, word, n` for every `arity` grams among the rarest of each word."""
    for batch in batches:
        letters, offsets = _letters(batch.column(0))
        plain = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)]
        )
        of, keys, places = [], [], []
        for rows, padded in _by_length(letters, offsets):
            gram, frequency, covered = _decompose(padded, dictionary)
            prefix = int(covered.max()) + arity
            order = (frequency.astype(np.uint64) << np.uint64(32)) | _bijection(gram)
            first = np.argsort(order, 1, kind="stable")[:, :prefix]  # equal grams from left to right
            gram = np.take_along_axis(gram, first, 1).astype(np.uint64)
            for some in combinations(range(first.shape[1]), arity):
                use = some[-1] < covered + arity
                key, at = np.zeros(int(use.sum()), np.uint64), np.zeros(int(use.sum()), np.uint64)
                for i in some:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + gram[use, i])
                    at = (at << np.uint64(16)) | (first[use, i].astype(np.uint64) & np.uint64(0xFFFF))
                of.append(rows[use])
                keys.append(key.view(np.int64))
                places.append(at.view(np.int64))
        if of:
            of = pa.array(np.concatenate(of))
            columns = [np.concatenate(keys), np.concatenate(places), plain.take(of), batch.column(1).take(of)]
            table = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["key", "at", "word", "n"])
            for i in range(0, len(table), 10_000):
                yield table.slice(i, 10_000)


def _near(batches: Iterator[pa.RecordBatch], arity: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    """Merge the lists of a partition sorted by key: `a, n_a, b, n_b` of near words.

    `b` is null for words of a key with more than `hot` words.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    over = None  # a key already known to be hot

    def key_of(batch: pa.RecordBatch, i: int) -> int:
        return batch["key"][i].as_py()

    def merged(done: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(done).combine_chunks()
        key = table["key"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(edge, len(key))), np.diff(np.append(edge, len(key))))
        many = (size > hot) if hot is not None else np.zeros(len(key), bool)
        if over is not None:
            many |= key == over
        if many.any():
            yield _out(table.filter(pa.array(many)), None)
        yield from _pairs(table.filter(pa.array(~many & (size > 1))), arity)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        last = key_of(batch, batch.num_rows - 1)
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(table["key"].to_numpy(), last, "left"))
        if cut:
            yield from merged(table.slice(0, cut).to_batches())
            over = None
        held, rows = table.slice(cut).to_batches(), len(table) - cut
        if hot is not None and (rows > hot or over == last):  # one long list: pass its words on
            over = last
            yield _out(pa.Table.from_batches(held), None)
            held, rows = [], 0
    if held:
        yield from merged(held)


def _out(left: pa.Table, right: pa.Table | None) -> pa.RecordBatch:
    left = left.combine_chunks()
    if right is None:
        words, counts = pa.nulls(len(left), pa.binary()), pa.nulls(len(left), pa.int64())
    else:
        right = right.combine_chunks()
        words, counts = right["word"], right["n"]
    table = pa.table({"a": left["word"], "n_a": left["n"], "b": words, "n_b": counts}).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.column_names
    )


def _pairs(table: pa.Table, arity: int) -> Iterator[pa.RecordBatch]:
    """Near words among the postings of whole lists.

    Grams on the two sides of an added letter stand at equal places, or one
    further on in the longer word; so each posting looks up the few places its
    partners can have. Equal hashes of places are proven by comparing letters.
    """
    if not len(table):
        return
    table = table.combine_chunks()
    data, offsets = texts(table["word"])
    size = np.diff(offsets).astype(np.uint64)
    key, at = (table[c].to_numpy().view(np.uint64) for c in ("key", "at"))
    key = key * np.uint64(0xD6E8FEB86659FD93)
    code = mix(key ^ mix(at + size * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    parts = [(at >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(arity)]
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def compare(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        count = high - low
        use = count > 0
        a, low, count = a[use], low[use], count[use]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(a):
            upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 1_000_000, "right")))
            n = count[begin:upto]
            left = np.repeat(a[begin:upto], n)
            skip = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            right = order[np.repeat(low[begin:upto], n) + skip]
            near = _one_edit(data, offsets, left, right)
            found_a.append(left[near])
            found_b.append(right[near])
            begin = upto

    # Equal lengths: partners are the later ones with equal places.
    last = np.searchsorted(ranked, ranked, "right")
    compare(order, np.arange(1, len(order) + 1), last)
    for shift in product((0, 1), repeat=arity):
        moved = np.zeros(len(at), np.uint64)
        for k, s in enumerate(shift):
            moved |= ((parts[k] + np.uint64(s)) & np.uint64(0xFFFF)) << np.uint64(16 * k)
        wanted = mix(key ^ mix(moved + (size + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        compare(np.arange(len(at)), np.searchsorted(ranked, wanted, "left"), np.searchsorted(ranked, wanted, "right"))
    left, right = np.concatenate(found_a), np.concatenate(found_b)
    if len(left):
        # Two words may meet in several lists; they are passed on once.
        name = pc.index_in(table["word"], pc.unique(table["word"])).to_numpy()
        both = np.minimum(name[left], name[right]).astype(np.int64) << 32 | np.maximum(name[left], name[right])
        _, once = np.unique(both, return_index=True)
        yield _out(table.take(pa.array(left[once])), table.take(pa.array(right[once])))


def _one_edit(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether right is left with exactly one letter replaced, or added."""
    start, size = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(left), bool)
    shape = size[left] * 2 + (size[right] > size[left])
    for s in np.unique(shape):
        pairs = np.flatnonzero(shape == s)
        n, longer = int(s) // 2, bool(s % 2)
        step = max(1, CELLS // max(1, n))
        for i in range(0, len(pairs), step):
            some = pairs[i : i + step]
            a = data[start[left[some]][:, None] + np.arange(n)]
            b = data[start[right[some]][:, None] + np.arange(n + longer)]
            differ = a != b[:, :n]
            if not longer:
                out[some] = differ.sum(1) == 1
                continue
            late = (a != b[:, 1:])[:, ::-1]
            ahead = np.where(differ.any(1), differ.argmax(1), n)
            behind = np.where(late.any(1), late.argmax(1), n)
            out[some] = ahead + behind >= n
    return out


def near_words(words: DataFrame, hot: int = HOT, frequent: int = FREQUENT) -> DataFrame:
    """`word, other, n_other`: both directions of every two words that are one edit apart.

    `words` (`word, n`) have at least `MIN_LENGTH` letters.
    """
    spark = words.sparkSession
    grams = gram_dictionary(words, frequent)
    order = np.argsort(grams, kind="stable")
    dictionary = (grams[order].astype(np.uint32), order.astype(np.int64) + 1)
    found, left, arity = [], words.select("word", "n"), 2
    while True:
        limit = hot if arity < 4 else None

        def postings(batches, arity=arity):
            return _postings(batches, dictionary, arity)

        def merged(batches, arity=arity, limit=limit):
            return _near(batches, arity, limit)

        lists = left.mapInArrow(postings, "key BIGINT, at BIGINT, word BINARY, n BIGINT")
        pairs = lists.repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
        pairs = materialize(pairs.mapInArrow(merged, "a BINARY, n_a BIGINT, b BINARY, n_b BIGINT"), "near")
        found.append(pairs.where("b IS NOT NULL"))
        more = pairs.where("b IS NULL")
        if limit is None or more.isEmpty():
            break
        left = materialize(more.select(F.decode("a", "ISO-8859-1").alias("word"), F.col("n_a").alias("n")).distinct(), "hot-words")
        arity += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    ends = [F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(n).alias("n_other")) for x, y, n in [("a", "b", "n_b"), ("b", "a", "n_a")]]
    both = pairs.select(F.inline(F.array(*ends))).groupBy("word", "other").agg(F.first("n_other").alias("n_other"))
    return both.select(
        F.decode("word", "ISO-8859-1").alias("word"), F.decode("other", "ISO-8859-1").alias("other"), "n_other"
    )


def _roots(links: DataFrame) -> DataFrame:
    """`word, root` of `word, form` links: the links followed to the last, twice as far each round.

    A form is many times more frequent than its word, so there are few rounds.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = 10, hot: int = HOT, frequent: int = FREQUENT) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of every word of `words` (`word, n`).

    The form is the most frequent near word, if it is at least `ratio` times as
    frequent as the word; the root is where forms lead in the end.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("form")))
    near = near_words(words, hot, frequent).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    formed = materialize(
        words.join(near, "word", "left").select(
            "word",
            F.when(taken, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(taken, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of the words of whole `documents` texts."""
    return variants(corpus_words(docs))
