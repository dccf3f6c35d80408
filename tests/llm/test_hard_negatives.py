"""Hard negatives against plain Python, and the exactness of the products."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import hard_negatives as hn

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, rank STRING, key INT, score DOUBLE"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (40, 64, 33), (70, 17, 100), (128, 64, 128), (5, 0, 4)])
@pytest.mark.parametrize("leaf", [1, 16])
def test_products_equal_plain_ones(shape, leaf):
    m, d, n = shape
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 40), 1 << 40, (m, d)), rng.integers(-(1 << 40), 1 << 40, (d, n))
    assert (hn.strassen(a, b, leaf) == a @ b).all()  # both modulo 2 ** 64


def test_scores_are_exact_or_saturate():
    big = np.array([[2.0**70, 2.0**70, 3.0], [1.0, 2.0, 3.0]])
    rows = np.array([[1.0, -1.0, 5.0], [1.0, 1.0, 0.0], [-1.0, -1.0, 0.0]])
    assert hn.scores(big, rows).tolist() == [[15, hn.LARGEST, -hn.LARGEST], [14, 3, -3]]


def plain(rows, positives=5, negatives=3):
    used = []
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = Counter()
    for a, label, v in used:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, other, w in used)
        for p, pid, _ in [s for s in scored if s[2] and s[1] != a][:positives]:
            window = [s for s in scored if not s[2] and -50 * p <= -100 * s[0] <= -95 * p][:negatives]
            for rank, (n, nid, _) in enumerate(window, 1):
                out[a, pid, rank, nid, -p, -n] += 1
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(260):
        v = [float(x) for x in rng.integers(0, 3, 6)]  # coarse: many ties
        out.append((i, v, int(rng.integers(0, 3)), "x", 1, 2.0))
    out += [out[50], out[50], out[51], out[0]]  # repeated rows, anchors too
    out += [(300, None, 1, "x", 1, 1.0), (350, [], 1, "x", 1, 1.0), (400, [1.0, 2.0], None, None, None, None)]
    out += [(450, [1.0, None], 2, "x", 1, 1.0), (500, [float("nan")], 2, "x", 1, 1.0), (550, [float("inf"), 1.0], 2, "x", 1, 1.0)]
    out += [(None, [1.0] * 6, 1, "x", 1, 1.0), (600, [1.0, 1.0], 0, "x", 1, 1.0), (601, [1.0] * 9, 2, "x", 1, 1.0)]
    return out


def test_against_plain_python(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert mined(hn.hard_negatives(df)) == plain(rows)


def test_small_blocks_and_tiles_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 2 * 8 * 9)
    monkeypatch.setattr(hn, "TILE", 7)
    monkeypatch.setattr(hn, "LEAF", 2)
    assert mined(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_without_rows_or_anchors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert hn.hard_negatives(df.where("false")).collect() == []
    assert hn.hard_negatives(df.where("vec_id % 50 != 0")).collect() == []
    assert hn.mine(hn.usable(df, "vec_id", "label", "embedding"), F.lit(False)).columns == COLUMNS
