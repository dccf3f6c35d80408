"""Logs: text form, order inside cases, oversized cases, compaction."""

import random

import pytest

from tests.helpers import brute_dfg, events_df, rows, traces_df
from traceloom import log_from_events, log_from_traces, session
from traceloom.operators import compaction, ordering, statistics
from traceloom.session import new_path
from traceloom.sources import text


def random_traces(seed=7):
    """Ordinary traces, and one that holds well over a third of all events."""
    rng = random.Random(seed)
    traces = [[rng.choice("abcde") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    traces.append([rng.choice("abcde") for _ in range(400)])
    traces.append([rng.choice("ab") for _ in range(57)])
    return traces


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value STRING")


def test_text_lines(spark):
    parsed = text.parse_traces(lines_df(spark, ["0,a,b,c,d", "1,a,c,b,d", "2,a,b,d", "3,a", "4,a,,b,,"]))
    assert rows(parsed, "case_id", "activities") == [
        ("0", ("a", "b", "c", "d")),
        ("1", ("a", "c", "b", "d")),
        ("2", ("a", "b", "d")),
        ("3", ("a",)),
        ("4", ("a", "", "b")),
    ]
    dfg = compaction.directly_follows(log_from_traces(parsed))
    assert rows(dfg, "src", "dst", "n") == [
        ("", "b", 1),
        ("a", "", 1),
        ("a", "b", 2),
        ("a", "c", 1),
        ("b", "c", 1),
        ("b", "d", 2),
        ("c", "b", 1),
        ("c", "d", 1),
    ]


def test_line_without_activities(spark):
    parsed = text.parse_traces(lines_df(spark, ["7", "8,"]))
    assert rows(parsed, "case_id", "activities") == [("7", ()), ("8", ())]
    log = log_from_traces(parsed)
    assert rows(compaction.directly_follows(log)) == []
    assert rows(compaction.activity_totals(log)) == []


def test_log_files(spark):
    path = new_path(spark, "log")
    traces = traces_df(spark, ["abc", "ab", "a"])
    text.write_traces(traces, path)
    read = text.read_traces(spark, path, partitions=3)
    assert rows(read) == rows(traces)
    assert read.rdd.getNumPartitions() >= 3
    wide = text.read_traces(spark, path, partitions=40)
    assert rows(wide) == rows(traces) and wide.rdd.getNumPartitions() >= 40
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_dfg_files(spark):
    path = new_path(spark, "dfg")
    dfg = spark.createDataFrame(
        [("all", "a", "b", 2), ("all", "a", "c", 1), ("all", "b", "c", 1), ("all", "b", "d", 2)],
        "model_id STRING, src STRING, dst STRING, n BIGINT",
    )
    assert rows(text.adjacency_lines(dfg), "value") == [("a,(b,2),(c,1)",), ("b,(c,1),(d,2)",)]
    text.write_dfg(dfg, path)
    assert rows(text.read_dfg(spark, path)) == rows(dfg)


def test_replicated_log(spark):
    copies = text.replicate_log(traces_df(spark, ["ab", "ba", "c"]), 2)
    assert rows(copies, "case_id", "activities") == [
        ("0", ("a", "b")),
        ("1", ("b", "a")),
        ("2", ("c",)),
        ("3", ("a", "b")),
        ("4", ("b", "a")),
        ("5", ("c",)),
    ]


@pytest.mark.parametrize("limit", [None, 1000, 10])
def test_positions_of_large_cases(spark, limit):
    traces = random_traces()
    got = ordering.positions(events_df(spark, traces), limit)
    expected = [(str(c), i + 1, a) for c, t in enumerate(traces) for i, a in enumerate(t)]
    assert rows(got, "case_id", "pos", "activity") == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [None, 1000, 10])
def test_successions_of_large_cases(spark, limit):
    traces = random_traces()
    events = events_df(spark, traces)
    got = ordering.succession_pairs(events, limit)
    expected = [(str(c), i + 1, t[i], t[i + 1]) for c, t in enumerate(traces) for i in range(len(t) - 1)]
    assert rows(got, "case_id", "pos", "src", "dst") == sorted(expected, key=repr)
    counts = {(s, d): n for s, d, n in rows(statistics.dfg_of_events(events, limit), "src", "dst", "n")}
    assert counts == brute_dfg(traces)


def test_many_large_cases(spark, monkeypatch):
    """More oversized cases than may be broadcast."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    traces = random_traces()
    got = ordering.positions(events_df(spark, traces), 10)
    expected = [(str(c), i + 1, a) for c, t in enumerate(traces) for i, a in enumerate(t)]
    assert rows(got, "case_id", "pos", "activity") == sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [1000, 10])
@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("source", ["events", "traces"])
def test_compact_log(spark, limit, compress, source):
    traces = random_traces()
    if source == "events":
        log = log_from_events(events_df(spark, traces), limit, compress)
    else:
        log = log_from_traces(traces_df(spark, traces), limit, compress)
    assert (log.pieces is None) == (limit == 1000)
    if log.pieces is not None:
        longest = log.pieces.selectExpr("max(size(activities))").first()[0]
        assert longest <= limit
        # The two long cases in pieces: 40 of 10 events, 6 of at most 10.
        assert log.pieces.count() == 46
    counts = {(s, d): n for s, d, n in rows(compaction.directly_follows(log), "src", "dst", "n")}
    assert counts == brute_dfg(traces)
    totals = {a: n for a, n in rows(compaction.activity_totals(log), "activity", "n")}
    assert totals == {a: sum(t.count(a) for t in traces) for a in "abcde"}


def test_bags_and_summary(spark):
    events = events_df(spark, ["aab", "b"])
    assert rows(statistics.trace_bags(events), "case_id", "activity", "cnt") == [("0", "a", 2), ("0", "b", 1), ("1", "b", 1)]
    assert rows(statistics.log_summary(events)) == [("all", 2, 4)]


def test_variants(spark):
    variants = compaction.trace_variants(traces_df(spark, ["ab", "ba", "ab", "ab"]))
    assert rows(variants, "activities", "mult") == [(("a", "b"), 3), (("b", "a"), 1)]
