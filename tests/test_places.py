"""Candidates, checks and discovery against brute force."""

import pytest

from tests.helpers import (
    brute_candidates,
    brute_support,
    dfg_df,
    events_df,
    places_df,
    rows,
    support_dict,
    traces_df,
)
from tests.test_log import random_traces
from traceloom import discover, log_from_events, log_from_traces, session
from traceloom.operators import candidates, checks, compaction
from traceloom.plans.discovery import funnel, place_listing


def compact(spark, traces):
    return log_from_traces(traces_df(spark, traces))


def dfg_of(spark, traces):
    return compaction.directly_follows(compact(spark, traces))


def test_neighbours(spark):
    dfg = dfg_df(spark, [("a", "b", 1), ("a", "c", 1), ("a", "a", 1), ("b", "c", 1)])
    assert rows(candidates.adjacency_list(dfg), "src", "dsts") == [("a", ("a", "b", "c")), ("b", ("c",))]
    subsets = [(src, "".join(b)) for src, b in rows(candidates.successor_subsets(dfg), "src", "b_set")]
    assert sorted(subsets) == [("a", x) for x in ["a", "ab", "abc", "ac", "b", "bc", "c"]] + [("b", "c")]
    assert (("c",), ("a", "b")) in rows(candidates.inverted_list(dfg), "b_set", "srcs")


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_candidates(spark, size):
    traces = ["abcd", "acbd", "aabd", "dca", "e"]
    got = rows(candidates.candidates(dfg_of(spark, traces), size), "a_set", "b_set")
    assert len(got) == len(set(got))
    assert set(got) == brute_candidates(traces, size)


def test_candidates_of_a_large_graph(spark, monkeypatch):
    # The way taken when the graph is too large to broadcast.
    monkeypatch.setattr(session, "BROADCAST_BYTES", 600)
    traces = ["abcd", "acbd", "aabd", "dca"]
    got = rows(candidates.candidates(dfg_of(spark, traces)), "a_set", "b_set")
    assert len(got) == len(set(got))
    assert set(got) == brute_candidates(traces)


# trace, log totals of a and b, trace level, prefix level, similarity 0.5;
# None: the trace is ignored.
CASES = [
    ("ab", (1, 1), True, True, True),
    ("ba", (1, 1), True, False, True),
    ("aab", (2, 1), False, False, True),
    ("aabb", (2, 2), True, True, True),
    ("abba", (2, 2), True, False, True),
    ("a", (1, 0), False, False, False),
    ("b", (0, 1), False, False, False),
    ("cd", (0, 0), None, None, None),
    ("", (0, 0), None, None, None),
]


@pytest.mark.parametrize("trace,totals,trace_hit,prefix_hit,similar", CASES)
def test_check_cases(spark, trace, totals, trace_hit, prefix_hit, similar):
    log = compact(spark, [trace])
    place = places_df(spark, [("a", "b")])
    balance = checks.log_level_balance(place, compaction.activity_totals(log)).first()
    assert (balance.n_a, balance.n_b) == totals
    assert (balance.gap is None) == (totals == (0, 0))

    def outcome(result):
        return [(r.hit, r.miss) for r in result.collect()]

    def expected(hit):
        return [] if hit is None else [(int(hit), int(not hit))]

    counts = checks.support(log, place)
    assert outcome(checks.trace_level_check(counts)) == expected(trace_hit)
    assert outcome(checks.prefix_level_check(counts)) == expected(prefix_hit)
    assert outcome(checks.trace_similarity_check(log, place, 0.5)) == expected(similar)


def test_log_level_threshold(spark):
    places = places_df(spark, [("a", "b"), ("a", "c"), ("c", "x")])
    totals = compaction.activity_totals(compact(spark, ["aab", "c"]))
    assert rows(checks.log_level_check(places, totals, 0.34), "a_set", "b_set") == [
        (("a",), ("b",)),
        (("a",), ("c",)),
    ]
    assert rows(checks.log_level_check(places, totals, 0.0), "a_set") == []


@pytest.mark.parametrize("limit", [1000, 10])
@pytest.mark.parametrize("broadcast", [True, False])
def test_support(spark, monkeypatch, limit, broadcast):
    """All candidates; large cases in pieces or whole; with and without broadcast joins."""
    traces = random_traces()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    try:
        log = log_from_events(events_df(spark, traces), limit, compress=broadcast)
        places = sorted(brute_candidates(traces))
        got = support_dict(checks.support(log, places_df(spark, places)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_support(traces, places)


def test_balanced_large_case(spark):
    """A case cut into pieces is a hit only if the pieces fit together."""
    good, bad = "a" * 25 + "b" * 25, "ab" * 12 + "ba" + "ab" * 12
    log = log_from_traces(traces_df(spark, [good, bad]), max_case_events=7)
    counts = checks.support(log, places_df(spark, [("a", "b")]))
    assert support_dict(counts) == {(("a",), ("b",)): (2, 2, 1)}
    similar = checks.trace_similarity_check(log, places_df(spark, [("a", "b")]), 0.9)
    assert rows(similar, "hit", "miss") == [(2, 0)]


def kept(run):
    return rows(run.kept, "model_id", "a_set", "b_set", "hit", "miss")


def test_discovery_filters(spark):
    traces = random_traces(3) + ["abc"] * 30 + ["acb"] * 20 + ["de"] * 25
    log = compact(spark, traces)
    base = discover(log, gamma=0.2)
    assert kept(base)
    # hits in every prefix are hits at the end, out of the same traces
    counts = checks.support(log, base.candidates)
    assert all(h3 <= h2 <= n for n, h2, h3 in support_dict(counts).values())
    # a trace filter that is no stricter than the prefix filter changes nothing
    assert kept(discover(log, gamma=0.2, beta=0.2)) == kept(base)
    # stricter thresholds keep fewer places
    for stricter in [
        discover(log, gamma=0.3),
        discover(log, gamma=0.2, beta=0.4),
        discover(log, gamma=0.2, alpha=0.1),
    ]:
        assert set(kept(stricter)) < set(kept(base))
    run = discover(log, gamma=0.2, beta=0.4, alpha=0.3)
    sizes = {stage[:1]: n for _, stage, n in rows(funnel(run))}
    assert sizes["1"] >= sizes["2"] >= sizes["3"] >= sizes["4"] == run.kept.count()


def test_discovery_is_independent_of_form(spark):
    traces = random_traces(5)
    expected = kept(discover(log_from_events(events_df(spark, traces)), gamma=0.05))
    assert kept(discover(log_from_events(events_df(spark, traces), 10), gamma=0.05)) == expected
    assert kept(discover(log_from_traces(traces_df(spark, traces), compress=False), gamma=0.05)) == expected
    # repeating the log multiplies the counts and keeps the ratios
    many = kept(discover(compact(spark, traces * 3), gamma=0.05))
    assert many == [(m, a, b, 3 * hit, 3 * miss) for m, a, b, hit, miss in expected]
    # names do not matter
    swap = str.maketrans("abcde", "edcba")
    renamed = discover(compact(spark, ["".join(t).translate(swap) for t in traces]), gamma=0.05)
    back = [
        (m, tuple(sorted(x.translate(swap) for x in a)), tuple(sorted(x.translate(swap) for x in b)), hit, miss)
        for m, a, b, hit, miss in kept(renamed)
    ]
    assert sorted(back, key=repr) == expected


def test_models_are_independent(spark):
    traces = random_traces(9)
    together = kept(discover(log_from_events(events_df(spark, traces, "m"), 10), gamma=0.05))
    for m in ["m0", "m1"]:
        alone = discover(compact(spark, [t for c, t in enumerate(traces) if f"m{c % 2}" == m]), gamma=0.05)
        assert [r[1:] for r in together if r[0] == m] == [r[1:] for r in kept(alone)]


def test_given_dfg(spark):
    """The graph of an earlier job can be handed in, here without one arc."""
    traces = ["abc", "abc", "acb"]
    log = compact(spark, traces)
    part = compaction.directly_follows(log).where("not (src = 'a' and dst = 'c')")
    run = discover(log, gamma=0.1, dfg=part)
    assert kept(run)
    assert not [r for r in kept(run) if "a" in r[1] and "c" in r[2]]


def test_listing(spark):
    assert rows(place_listing(places_df(spark, [("a", "bc"), ("ab", "c")])), "place") == [
        ("a.b.|c.",),
        ("a.|b.c.",),
    ]


def test_names_with_separators(spark):
    """Names may contain dots, plus signs, colons and gateway prefixes."""
    traces = [["a.b", "XOR:1", "+"], ["a.b", "+", "XOR:1"]]
    run = discover(compact(spark, traces), gamma=1.0)
    assert ("all", ("a.b",), ("+",), 2, 0) in kept(run)
    assert ("all", ("a.b",), ("XOR:1",), 2, 0) in kept(run)


def test_wide_places(spark):
    """More activities than digits: letters take over."""
    names = [f"x{i:02d}" for i in range(12)]
    traces = [["a", *names], ["a", "x11"], ["x03", "a"], ["a"], ["b"]]
    counts = checks.support(compact(spark, traces), places_df(spark, [({"a"}, set(names)), ({"a"}, {"x11"})]))
    assert support_dict(counts) == brute_support(traces, [(("a",), tuple(names)), (("a",), ("x11",))])
