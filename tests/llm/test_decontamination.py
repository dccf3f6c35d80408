import random

from traceloom.llm.decontamination import common, leaks


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 80)), rng.integers(0, 6, rng.integers(1, 120))
        assert common(a, b) == brute_common(a.tolist(), b.tolist())


def planted(spark, seed=4):
    rng = random.Random(seed)
    often = [f"of{i}" for i in range(12)]

    def prose(n):
        return [rng.choice(often) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(n)]

    items = [prose(rng.choice([14, 30, 59])) for _ in range(230)]
    docs, want = [], set()
    for i in range(300):
        w = prose(rng.choice([40, 200, 700]))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            copy = [x.upper() for x in items[k]]
            if i % 2:  # a paraphrase: one word in eight is another
                copy = [f"q{rng.randrange(99)}" if j % 8 == 3 else x for j, x in enumerate(copy)]
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(w)))
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4),
        spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id BIGINT, text STRING"),
        want,
    )


def test_finds_planted_passages(spark):
    docs, benchmark, want = planted(spark)
    got = {(r.doc_id, r.item_id) for r in leaks(docs, benchmark).collect()}
    assert got - want == set()
    assert len(got & want) >= 0.98 * len(want)


def test_odd_rows(spark, odd, empty):
    benchmark = odd.where("doc_id = 12 OR doc_id = 4 OR text IS NULL").selectExpr("doc_id AS item_id", "text")
    assert {(r.doc_id, r.item_id) for r in leaks(odd, benchmark).collect()} == {(12, 12)}
    assert leaks(empty, benchmark).collect() == []
    assert leaks(odd, benchmark.where("false")).collect() == []


def test_short_and_common_items(spark):
    """Copies of short items are found whatever stands around them, and copies in order only."""
    rng = random.Random(9)
    often = [f"of{i}" for i in range(12)]
    prose = lambda n: [rng.choice(often) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [[f"u{n}x{j}" for j in range(n)] for n in (1, 2, 3, 5, 9)]
    items += [[often[(5 * n + 7 * j * j + j) % 12] for j in range(n)] for n in (10, 12, 15)]
    docs, want = [], set()
    for i in range(120):
        w = prose(rng.choice([20, 300]))
        if i % 2:
            k = (i // 2) % len(items)
            at = rng.randrange(len(w))
            w[at:at] = items[k]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id BIGINT, text STRING")
    rows = leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.share == 1} == want
    assert {(r.doc_id, r.item_id) for r in rows if r.item_id < 5} == {x for x in want if x[1] < 5}
