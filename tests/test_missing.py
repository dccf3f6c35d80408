"""Missing names, names with separators, and limits of the text forms."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.logs import LOGS
from catalog.params import PARAMS
from catalog.queries import QUERIES
from tests.helpers import dfg_df, edges_df, places_df, rows, traces_df
from tests.test_log import random_traces
from traceloom import event_log, log_from_events, log_from_traces, session
from traceloom.operators import candidates as places
from traceloom.operators import checks, labels
from traceloom.operators.checks import support
from traceloom.operators.compaction import dfg_of_traces, directly_follows
from traceloom.operators.gateways import gateway_edges, gateway_nodes
from traceloom.operators.statistics import dfg_of_events
from traceloom.plans.discovery import discover, discover_grid, funnel
from traceloom.session import materialize, new_path
from traceloom.sources import text
from traceloom.sources.tables import events_without_case


def events(spark, traces):
    table = [(str(c), i, a) for c, t in enumerate(traces) for i, a in enumerate(t)]
    return spark.createDataFrame(table, "c STRING, i INT, a STRING")


TRACES = [["c", None], ["b", "c"], ["b", None, "c"]]


def test_missing_activity(spark):
    log = log_from_events(event_log(events(spark, TRACES), "c", ["i"], "a"))
    same = log_from_traces(traces_df(spark, TRACES))
    places = places_df(spark, [({"b"}, {"c"})])
    for each in (log, same):
        assert rows(support(each, places), "touched", "trace_hit", "prefix_hit") == [(3, 2, 2)]
        assert rows(directly_follows(each)) == rows(dfg_of_events(event_log(events(spark, TRACES), "c", ["i"], "a")))
    assert ("all", "b", "", 1) in rows(directly_follows(log))


def test_missing_case_and_model(spark):
    table = spark.createDataFrame(
        [(None, 1, "x", "m")] * 50 + [("1", 1, "a", None), ("1", 2, "b", None), ("2", 1, "a", "m"), ("2", 2, "b", "m")],
        "c STRING, i INT, a STRING, m STRING",
    )
    log = event_log(table, "c", ["i"], "a", "m")
    assert log.count() == 4 and events_without_case(table, "c") == 50
    places = places_df(spark, [({"a"}, {"b"})], "").union(places_df(spark, [({"a"}, {"b"})], "m"))
    found = rows(support(log_from_events(log), places), "model_id", "prefix_hit")
    assert found == [("", 1), ("m", 1)]


def test_pieces_are_joined_by_their_ends_only(spark):
    log = log_from_traces(traces_df(spark, ["abcabcab", "ab"]), max_case_events=3)
    assert rows(directly_follows(log)) == rows(directly_follows(log_from_traces(traces_df(spark, ["abcabcab", "ab"]))))
    plan = directly_follows(log)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(model_id" in line and "activities" in line]


def test_gateways_of_names_with_separators(spark):
    places = places_df(spark, [({"a", "b+c"}, {"x"}), ({"a+b", "c"}, {"x"})])
    xors = [n for _, n, kind in rows(gateway_nodes(gateway_edges(places))) if kind == "XOR"]
    assert len(set(xors)) == 2
    plain = gateway_nodes(gateway_edges(places_df(spark, [({"a", "b"}, {"x"})])))
    assert "XOR:a+b>x" in [r.node for r in plain.collect()]


def test_copies(spark):
    traces = traces_df(spark, ["ab", "c"])
    assert text.replicate_log(traces, 0).count() == 0
    assert text.replicate_log(traces, 1).count() == 2
    with pytest.raises(ValueError, match="negative"):
        text.replicate_log(traces, -1)


def test_graph_text_of_several_models(spark):
    names = ["m", "01", "1", "", "a b+c%41=/x", "é?"]
    arcs = [(m, "a", "b", i + 1) for i, m in enumerate(names)] + [("m", "b", "c", 9)]
    dfg = spark.createDataFrame(arcs, "model_id STRING, src STRING, dst STRING, n BIGINT")
    path = new_path(spark, "two")
    text.write_dfg(dfg, path)
    assert rows(text.read_dfg(spark, path)) == rows(dfg)
    flat = new_path(spark, "flat")
    text.adjacency_lines(dfg.where("model_id = 'm'")).select("value").write.text(flat)
    assert rows(text.read_dfg(spark, flat, "x")) == [("x", "a", "b", 1), ("x", "b", "c", 9)]


def test_the_job_reads_the_log_once(spark):
    """The graph is written from one plan over the log."""
    log, graph = new_path(spark, "log"), new_path(spark, "graph")
    spark.createDataFrame([("0,a,b",), ("1,a,b,c",)], "value STRING").write.text(log)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = spark.read.text(log).mapInArrow(counted, "value STRING")
    text.write_dfg(dfg_of_traces(text.parse_traces(lines)), graph)
    assert seen.value == 2
    assert rows(text.read_dfg(spark, graph), "src", "dst", "n") == [("a", "b", 2), ("b", "c", 1)]


def test_reading_leaves_the_session_alone(spark):
    path = new_path(spark, "log")
    text.write_traces(traces_df(spark, ["ab"]), path)
    text.read_traces(spark, path, partitions=3)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_a_missing_user_is_no_case(spark, tmp_path):
    spark.sql("SELECT 1L AS event_id, CAST(NULL AS BIGINT) AS user_id, timestamp'2024-01-01' AS ts, 'a' AS event_type"
              " UNION ALL SELECT 2, 7, timestamp'2024-01-01', 'b'").write.parquet(str(tmp_path / "events.parquet"))
    assert rows(LOGS["events_day"](spark, str(tmp_path)), "case_id") == [("7@2024-01-01",)]


def test_sets_around_a_hub_are_bounded(spark):
    """300 successors: only sets that can balance are built, and all that do."""
    arcs = [("hub", f"x{i:03d}", 1) for i in range(300)]
    totals = [("all", "hub", 100)] + [("all", f"x{i:03d}", 10 + i) for i in range(300)]
    dfg, totals = dfg_df(spark, arcs), spark.createDataFrame(totals, "model_id STRING, activity STRING, n BIGINT")
    every = places.candidates(dfg, 2)
    bounded = materialize(places.balanced_candidates(dfg, totals, 0.1, 2), "bounded")
    assert bounded.count() < every.count() / 4
    assert rows(checks.log_level_check(bounded, totals, 0.1)) == rows(checks.log_level_check(every, totals, 0.1))
    assert rows(places.balanced_candidates(dfg, totals, 1.0, 2)) == rows(every)


def test_a_grid_equals_single_runs(spark):
    traces = random_traces(3) + ["abc"] * 30 + ["acb"] * 20
    grid = [(alpha, beta, gamma) for alpha in (None, 0.1, 0.3) for beta in (None, 0.4) for gamma in (0.2, 0.3)]
    log = log_from_traces(traces_df(spark, traces))
    for cells in (grid, grid[4:]):
        cell = ["alpha", "beta", "gamma"]
        found = rows(discover_grid(log, cells), *cell, "a_set", "b_set", "hit", "miss")
        single = [
            (alpha, beta, gamma, *r)
            for alpha, beta, gamma in cells
            for r in rows(discover(log, gamma, beta, alpha).kept, "a_set", "b_set", "hit", "miss")
        ]
        assert found == sorted(single, key=repr) and found


def test_no_exchange_carries_a_trace(spark, monkeypatch):
    """Beyond the broadcast bound only keys and counts are shuffled, and only survivors are walked."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    log = log_from_traces(traces_df(spark, ["abc", "acb", "ab", "bca"] * 5))
    reading = checks._readings(places_df(spark, [("a", "b"), ("a", "bc"), ("ab", "c"), ("b", "c")]))
    walked = reading.places.where("a_set[0] = 'a' AND size(b_set) = 1").select("place_id")
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for plan in (checks._trace_tally(log, reading), checks._prefix_hits(log, reading, walked)):
        nodes = plan._jdf.queryExecution().explainString(formatted).split("\n\n")
        exchanges = [n for n in nodes if re.match(r"\(\d+\) Exchange", n.strip())]
        assert exchanges and not any("activities#" in n.split("Arguments")[0] for n in exchanges)
    assert {r.place_id for r in checks._prefix_hits(log, reading, walked).collect()} <= {r[0] for r in walked.collect()}


def test_thresholds_split_the_candidates(spark):
    kept = {}
    for name in ("discover_0f", "discover_1f", "discover_2f"):
        out = QUERIES[name](spark, "/root/testdata/sf0.01")
        kept[name] = {repr(r) for r in out.select(*[F.col(c).cast("string") for c in ("a_set", "b_set")]).collect()}
    assert kept["discover_2f"] < kept["discover_1f"] < kept["discover_0f"]
    assert set(PARAMS["lineitem"]) == {"0f", "1f", "2f"}


def test_graph_of_traces_in_one_pass(spark):
    traces = traces_df(spark, TRACES)
    assert rows(dfg_of_traces(traces)) == rows(directly_follows(log_from_traces(traces)))
    plan = dfg_of_traces(traces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


@pytest.mark.parametrize("depth", [1, 2, 9])
def test_reach_of_a_deep_chain_takes_few_rounds(spark, monkeypatch, depth):
    chain = ["a", *[f"XOR{i}" for i in range(depth)], "z"]
    edges = edges_df(spark, [f"{x}->{y}" for x, y in zip(chain, chain[1:], strict=False)] + ["XOR0->q"])
    written = []
    monkeypatch.setattr(labels, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    assert set(rows(labels.gateway_reach(edges, True), "node", "activity")) == {(x, "z") for x in chain[1:-1]} | {("XOR0", "q")}
    assert len(written) <= 2 + 2 * (depth - 1).bit_length()
    assert set(rows(labels.gateway_reach(edges, False), "node", "activity")) == {(x, "a") for x in chain[1:-1]}


def test_funnel_keeps_empty_stages(spark):
    traces = traces_df(spark, ["ab", "ab"], "m").unionByName(traces_df(spark, ["a"], "n"))
    counts = {(m, s[:1]): n for m, s, n in rows(funnel(discover(log_from_traces(traces), gamma=0.9)))}
    assert len(counts) == 14
    assert [counts["m", s] for s in "1234567"] == [1] * 7
    assert [counts["n", s] for s in "1234567"] == [0] * 7
