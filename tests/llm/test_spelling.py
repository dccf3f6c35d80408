"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from traceloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(brute.lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def edits(word):
    """Keys that two words share if they are at most one edit apart."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + "\0" + word[i + 1 :] for i in range(len(word))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    where = defaultdict(list)
    for word in counts:
        for key in edits(word):
            where[key].append(word)
    near = defaultdict(set)
    for words in where.values():
        for a in words:
            near[a].update(b for b in words if one_edit(a, b))
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_words():
    rng = random.Random(5)
    parts = ["tion", "ment", "ab", "é", "ing", "over", "aa", "aaaa", "ß", "ÿz", "er"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(400)}
    for word in sorted(words):
        for _ in range(3):
            i, c = rng.randrange(len(word)), rng.choice("abeé")
            words |= {word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:]}
    words |= {"a" * n for n in range(7, 12)} | {"ab" * 300, "ab" * 300 + "a", "ab" * 299 + "aa", "x" * 3000, "x" * 3001}
    return {w: rng.choice([2, 3, 25, 300, 4000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize(("hot", "frequent"), [(20_000, 150_000), (20_000, 100), (3, 2000), (0, 1)])
def test_words_against_plain_python(spark, hot, frequent):
    counts = made_words()
    df = spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT").repartition(4)
    assert found(spelling.variants(df, hot=hot, frequent=frequent)) == plain(counts)


def test_long_lists_in_small_chunks(spark, monkeypatch):
    """Lists that span chunks, and lists that are passed on in parts."""
    counts = {w: n for w, n in made_words().items() if len(w) < 100}
    df = spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT").coalesce(1)
    pairs = {(r.word, r.other) for r in spelling.near_words(df, hot=5, frequent=50).collect()}
    want = {(a, b) for a in counts for b in counts if one_edit(a, b)}
    assert pairs == want
    lists = spelling._postings
    dictionary = (np.empty(0, np.uint32), np.empty(0, np.int64))
    batches = list(lists(iter(df.toArrow().to_batches()), dictionary, 2))
    import pyarrow as pa

    table = pa.Table.from_batches(batches).sort_by("key")
    monkeypatch.setattr(spelling, "CHUNK", 40)
    for hot in (None, 4):
        out = pa.Table.from_batches(list(spelling._near(iter(table.to_batches(max_chunksize=7)), 2, hot)))
        got = {frozenset((a.decode("latin-1"), b.decode("latin-1"))) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True) if b is not None}
        assert got <= {frozenset(p) for p in want}
        assert hot or got == {frozenset(p) for p in want}


def test_documents(spark, odd, empty):
    rng = random.Random(2)
    words = sorted(made_words())[:60]
    rows = [(i % 40, " ".join(rng.choice(words) + rng.choice(["", ",", "1", "\n", "—", "Ā"]) for _ in range(120))) for i in range(60)]
    rows += [(None, "Variantes VARIANTES variantés × ÷ÀÉ"), (7, None), (8, ""), (9, "variantes" * 5000 + " variantes")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert found(spelling.spelling_variants(df)) == plain(counted(rows))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spelling.spelling_variants(odd)) == plain(counted(rows))
    assert spelling.spelling_variants(empty).collect() == []
