import hashlib
import random

import pytest

from tests.llm import brute
from traceloom.llm.substrings import drop_repeated


def removed(docs, window=20):
    """Of distinct ids: number of words, of removed ones, digest of the rest."""
    first, places = {}, []
    for i, text in sorted(docs):
        w = brute.words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            places.append((i, p, key))
            first.setdefault(key, (i, p))
    gone = {(i, p + k) for i, p, key in places if first[key] != (i, p) for k in range(window)}
    out = {}
    for i, text in docs:
        w = brute.words(text)
        kept = [x for p, x in enumerate(w) if (i, p) not in gone]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def texts(seed=3):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(55)]
    docs = []
    for i in range(40):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 150))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        if i % 7 == 0:
            w += w[:30]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    docs.append((50, "same " * 100))
    docs.append((51, docs[3][1]))
    return docs


@pytest.mark.parametrize("hot", [3, 20_000])
def test_equals_brute_force(spark, hot):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeated(df, hot).collect()}
    assert got == removed(docs)


def test_odd_rows(odd, empty):
    rows = drop_repeated(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[4].n_words == 0 and by_id[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    # The row without an id comes first, so its copies are removed whole.
    assert by_id[1].n_removed == by_id[2].n_removed == 60
    assert by_id[13].text == "x y"
    assert drop_repeated(empty).collect() == []
