"""Small logs, and brute-force answers to compare with."""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import functions as F

from traceloom import event_log, schema


def traces_df(spark, traces, model="all"):
    rows = [(model, str(i), list(t)) for i, t in enumerate(traces)]
    return spark.createDataFrame(rows, schema.TRACES)


def events_df(spark, traces, model=None):
    """Shuffled event rows of the traces, ready for `log_from_events`."""
    rows = [(str(c), i, a, f"m{c % 2}") for c, t in enumerate(traces) for i, a in enumerate(t)]
    rows.sort(key=lambda r: hash((r[1], r[2], r[0])))
    table = spark.createDataFrame(rows, "c STRING, i INT, a STRING, m STRING")
    return event_log(table, "c", ["i"], "a", model)


def places_df(spark, places, model="all"):
    return spark.createDataFrame([(model, sorted(a), sorted(b)) for a, b in places], schema.PLACES)


def edges_df(spark, edges, model="all"):
    """Edges given as "a->X1"; the kind is taken from the first letters."""

    def kind(node):
        return "AND" if node.startswith("And") else "XOR" if node.startswith("XOR") else "ACT"

    rows = []
    for e in edges:
        src, dst = e.split("->")
        rows.append((model, src, kind(src), dst, kind(dst)))
    return spark.createDataFrame(rows, schema.EDGES)


def dfg_df(spark, arcs, model="all"):
    return spark.createDataFrame([(model, s, d, n) for s, d, n in arcs], schema.DFG)


def rows(df, *columns):
    """Rows as a sorted list of tuples; arrays as tuples."""

    def plain(value):
        return tuple(value) if isinstance(value, list) else value

    selected = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in selected.collect()), key=repr)


def brute_dfg(traces):
    return Counter(pair for t in traces for pair in itertools.pairwise(t))


def brute_candidates(traces, size=3):
    arcs = set(brute_dfg(traces))
    names = sorted({x for arc in arcs for x in arc})
    found = set()
    for one in names:
        after = [x for x in names if (one, x) in arcs and x != one]
        before = [x for x in names if (x, one) in arcs and x != one]
        for k in range(1, size + 1):
            found |= {((one,), s) for s in itertools.combinations(after, k)}
            found |= {(s, (one,)) for s in itertools.combinations(before, k)}
    return found


def brute_outcome(trace, a, b):
    """touched, balanced at the end, balanced in every prefix - for one trace."""
    balance, low, touched = 0, 0, False
    for x in trace:
        touched |= x in a or x in b
        balance += (x in a) - (x in b)
        low = min(low, balance)
    return touched, touched and balance == 0, touched and balance == 0 and low == 0


def brute_support(traces, places):
    result = {}
    for a, b in places:
        outcomes = [brute_outcome(t, a, b) for t in traces]
        result[(a, b)] = tuple(sum(o[i] for o in outcomes) for i in range(3))
    return {p: s for p, s in result.items() if s[0]}


def support_dict(df):
    return {
        (tuple(r.a_set), tuple(r.b_set)): (r.touched, r.trace_hit, r.prefix_hit)
        for r in df.select("a_set", "b_set", F.col("touched"), "trace_hit", "prefix_hit").collect()
    }
