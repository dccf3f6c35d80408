import random

from pyspark.sql import functions as F

from tests.llm import brute
from traceloom.llm.minhash import components, near_duplicates


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def variants(seed=5, families=12):
    """Families of near copies at all distances, with chains that only link through others."""
    rng = random.Random(seed)
    docs, n = [], 0
    for _ in range(families):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 15])):
            copy = [f"x{rng.randrange(9000)}" if rng.random() < 0.02 else w for w in text]
            docs.append((n, " ".join(copy)))
            text = copy if rng.random() < 0.5 else text
            n += 1
    return docs


def test_equals_brute_force(spark):
    docs = variants()
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    for size, threshold in [(4, 80), (5, 80)]:
        assert result(near_duplicates(df, size, threshold)) == brute.near_duplicates(docs, size, threshold)


def test_odd_rows(odd, empty):
    rows = near_duplicates(odd, 4, 80).collect()
    assert len(rows) == odd.count()
    known = {r.doc_id: r for r in rows if r.doc_id is not None}
    docs = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute.near_duplicates(list(docs.items()), 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in known.items()} == want
    assert known[8].component_id == 7 and not known[8].kept
    assert known[4].n_shingles == known[5].n_shingles == known[6].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_duplicates(empty).collect() == []


def test_texts_that_share_an_id(spark):
    """Rows are judged by their text: two unlike texts of one id link nothing together."""
    rng = random.Random(1)
    a, b = ([f"{c}{rng.randrange(10_000)}" for _ in range(100)] for c in "ab")
    near = lambda w: " ".join([*w[:99], "other"])
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (9, near(b)), (9, near(b)), (None, near(b)), (2, near(b)[:-5] + "third")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({"node": F.lit(1), "h": F.lit(2), "low": F.lit(3)})
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 4, 80).collect() if r.doc_id)
    assert got == [(2, 2, True), (3, 3, True), (5, 2, False), (5, 3, False), (9, 2, False), (9, 2, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 70), (70, 99)]
    df = spark.createDataFrame(edges, "x BIGINT, y BIGINT")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 70: 70, 99: 70, 100: 70}
