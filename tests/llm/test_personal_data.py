"""Spans of personal data: base rules against plain regular expressions, the labelers' model, and added spans."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from traceloom.llm import personal_data as pd

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
        for i, (kind, rule) in enumerate(BASE)
        for m in re.finditer(rule, text or "")
        if passes(kind, m.group())
    ]
    return [s for _, _, s in sorted(found)]


PIECES = [
    "a.b%c@mail-1.example.com", "@x.y", "a@b", "x@y.z@w.v", "é", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "007.0.0.0255",
    "4111 1111 1111 1111", "4111-1111--1111 1111", "4111111111111112", "+1 (602) 555-5136", "+1((", "++49 30 1234567", " ", "\n",
    "-", ".", "(", "12", "0", "+", "password=ab12cd34ef56", "token = \"00ff00ff00ff\"", "joe (at) mail (dot) example.com", "602-555-5136",
    "1..2.3.4", "x", "١٢", "𝔘",
]


def made_texts():
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


def test_base_spans_equal_plain_ones():
    for text in made_texts():
        base, every = pd._decided(pd._candidates(text), np.full(pd.BUCKETS, 1.0))
        assert pd._text(base).split(",") == (base_spans(text) or [""]), text
        assert set(base) <= set(every) and every == sorted(every)
        taken = sorted((a, b) for a, _, b in base)
        for a, _, b in set(every) - set(base):
            assert all(b <= c or d <= a for c, d in taken)


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ["a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1(" * 70_000, "1 " * 100_000, "token=" * 40_000]:
        pd._candidates(text + " x")
    assert time.perf_counter() - began < 60


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(8)
    true = rng.random(20_000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.6, 0.75]
    votes = np.zeros(len(true), np.int64)
    for share in right:
        correct = rng.random(len(true)) < share
        vote = np.where(rng.random(len(true)) < 0.2, 1, np.where(correct == true, 2, 0))
        votes = votes * 3 + vote
    pattern, n = np.unique(votes, return_counts=True)
    found = pd.reliabilities(np.zeros(len(pattern), np.int64), pattern, n.astype(float))
    assert abs(found.prior[0] - 0.4) < 0.03
    for labeler, share in enumerate(right):
        assert abs(found.chances[1, labeler, 2] - 0.8 * share) < 0.03
    guess = found.posterior(np.zeros(len(votes), np.int64), votes) > 0.5
    assert (guess == true).mean() > 0.95


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(400):
        local = f"{rng.choice('abcd')}{digits(2)}"
        rows += [
            (f"mail {local}@mail{i % 7}.example.com now", None),
            (f"call +1 ({digits(3)}) 555-{digits(4)} today", None),
            (f"login password=a{digits(4)}ff{digits(6)}c1 ok", "secret"),
            (f"version 3{digits(2)}.{digits(1)}.9{digits(2)}.400 and order {digits(13)}", ""),
        ]
    rows += [(f"please call ({digits(3)}) 555-{digits(4)} or mail joe{i} (at) mail (dot) example.com", "both") for i in range(100)]
    rows = [(i, t, k) for i, (t, k) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, kind STRING").repartition(4)


def test_the_classifier_adds_spans(corpus):
    rows, df = corpus
    out = {r.doc_id: r for r in pd.personal_data(df).collect()}
    assert len(out) == len(rows)
    for doc_id, text, kind in rows:
        base, spans = base_spans(text), out[doc_id].spans.split(",")
        assert out[doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(spans)
        added = set(spans) - set(base) - {""}
        if kind == "secret":
            assert {s.split(":")[0] for s in added} == {"secret"}
        elif kind == "both":
            assert {s.split(":")[0] for s in added} == {"phone", "email"}
        else:
            assert not added, text


def test_a_sample_decides_much_the_same(corpus):
    _, df = corpus
    whole, part = ({r.doc_id: r.spans for r in pd.personal_data(df, n).collect()} for n in (pd.SAMPLE, 300))
    assert sum(whole[i] == part[i] for i in whole) > 0.97 * len(whole)


def test_odd_rows(odd, empty, spark):
    out = pd.personal_data(odd).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd.collect())
    assert {r.n_email + r.n_ip + r.n_card + r.n_phone for r in out} == {0}
    assert pd.personal_data(empty).collect() == []
    again = [(1, "a@b.cd 1.2.3.4", 5)] * 2 + [(None, "a@b.cd", 5), (2, None, 5)]
    rows = pd.personal_data(spark.createDataFrame(again, "doc_id BIGINT, text STRING, spans INT")).collect()
    assert sorted((r.n_email, r.n_ip, r.spans) for r in rows) == [(0, 0, ""), (1, 0, "email:0:6"), *[(1, 1, "email:0:6,ip:7:14")] * 2]
