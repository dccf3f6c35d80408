import random
import zlib

import pytest
from pyspark.sql import functions as F

from traceloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = ["".join(rng.choice(["ba", "lo", "ti", "ren", "osk"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        toxic = int(i % 6 == 0)
        if toxic:
            w[rng.randrange(80)] = rng.choice(["Vrumpf", "zquekk"])
        rows.append((i, " ".join(w), toxic))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")


def test_held_out_labels(corpus):
    rows = toxicity.classify(corpus.drop("toxic"), corpus.select("doc_id", "toxic")).join(corpus, "doc_id").collect()
    assert len(rows) == 600
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_read(corpus):
    docs = corpus.drop("toxic")
    labels = corpus.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.classify(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_odd_rows(odd, empty, corpus):
    learned = corpus.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(corpus, learned)
    rows = odd.select("doc_id", toxicity.score(model).alias("s")).collect()
    assert len(rows) == odd.count() and all(0 <= r.s <= 1 for r in rows)
    assert toxicity.classify(odd, corpus.select("doc_id", "toxic").where("false")).where("score > 0.01").count() == 0
    assert toxicity.classify(empty, corpus.select("doc_id", "toxic")).collect() == []


def test_distinct_grams():
    (_, offsets, buckets), = toxicity.grams(["abcabc", None, ""], None)
    # " abcabc " has 6 + 5 + 4 + 3 + 2 grams of 3 to 7 characters, of which "abc" occurs twice.
    assert offsets[1] == 19 and offsets[2] == offsets[1] and offsets[3] == offsets[1]
    assert len(buckets) == 19
