"""Gateway graphs: expansion, rewriting, labels, text form."""

import itertools

import pytest

from catalog import queries
from tests.golden import LOG1, LOG2
from tests.helpers import dfg_df, edges_df, places_df, rows
from traceloom import model_from_places
from traceloom.operators import gateways, labels, reduction
from traceloom.operators.gateways import gateway_nodes
from traceloom.session import new_path
from traceloom.sources import text


def arrows(df):
    return sorted(f"{s}->{d}" for s, d in rows(df, "src", "dst"))


def reach_pairs(edges):
    """Activity pairs joined through gateways only, by brute force."""
    succ = {}
    for _, s, sk, d, dk in edges:
        succ.setdefault((s, sk), set()).add((d, dk))
    found = set()
    for start in [n for n in succ if n[1] == "ACT"]:
        stack, seen = list(succ[start]), set()
        while stack:
            node = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            if node[1] == "ACT":
                found.add((start[0], node[0]))
            else:
                stack.extend(succ.get(node, ()))
    return found


def test_expansion(spark):
    edges = gateways.gateway_edges(places_df(spark, [("a", "bc"), ("a", "b")]))
    assert arrows(edges) == sorted(
        [
            "a->AndS:a",
            "AndS:a->XOR:a>b+c",
            "AndS:a->XOR:a>b",
            "XOR:a>b+c->AndJ:b",
            "XOR:a>b+c->AndJ:c",
            "XOR:a>b->AndJ:b",
            "AndJ:b->b",
            "AndJ:c->c",
        ]
    )
    numbers = rows(gateways.gateway_numbering(edges), "family", "node", "number")
    assert numbers == [
        ("AndJ", "AndJ:b", 0),
        ("AndJ", "AndJ:c", 1),
        ("AndS", "AndS:a", 0),
        ("XOR", "XOR:a>b", 0),
        ("XOR", "XOR:a>b+c", 1),
    ]
    degrees = {n: (i, o) for n, i, o in rows(gateways.gateway_degrees(edges), "node", "n_in", "n_out")}
    assert degrees["AndS:a"] == (1, 2) and degrees["AndJ:b"] == (2, 1) and degrees["b"] == (1, 0)


BICLIQUE = [
    "{h1}->{f1}", "{h1}->{f2}", "{h2}->{f1}", "{h2}->{f2}",
    "{f1}->c", "{f2}->d", "a->{h1}", "b->{h2}",
]


def biclique(h, f):
    names = {"h1": h + "1", "h2": h + "2", "f1": f + "3", "f2": f + "4"}
    return [e.format(**names) for e in BICLIQUE]


def test_series(spark):
    assert arrows(reduction.reduced_gateways(edges_df(spark, ["p->XOR", "XOR->s"]))) == ["p->s"]
    # a long chain, and a shortcut that is there already
    chain = ["p->XOR1", "XOR1->And2", "And2->XOR3", "XOR3->XOR4", "XOR4->And5", "And5->s", "p->s"]
    assert arrows(reduction.reduced_gateways(edges_df(spark, chain))) == ["p->s"]


def test_series_after_shortcut(spark):
    """A bypass that merges with an edge can make the next gateway a series one."""
    edges = ["p->And1", "And1->XOR2", "And1->XOR3", "XOR3->XOR2", "XOR2->s"]
    assert arrows(reduction.reduced_gateways(edges_df(spark, edges))) == ["p->s"]


def test_merge(spark):
    """Block of one kind: all four gateways become one."""
    result = rows(reduction.reduced_gateways(edges_df(spark, biclique("And", "And"))))
    hubs = {d for _, s, _, d, _ in result if s in "ab"}
    assert len(hubs) == 1 and len(result) == 4
    assert {(s, dk) for _, s, _, d, dk in result if s in "ab"} == {("a", "AND"), ("b", "AND")}
    assert {(sk, d) for _, s, sk, d, _ in result if d in "cd"} == {("AND", "c"), ("AND", "d")}


def test_swap(spark):
    """Block of XOR then AND: becomes AND then XOR."""
    result = rows(reduction.reduced_gateways(edges_df(spark, biclique("XOR", "And"))))
    assert len(result) == 5
    (middle,) = [(s, d) for _, s, sk, d, dk in result if (sk, dk) == ("AND", "XOR")]
    assert {(s, d) for _, s, _, d, _ in result} == {
        ("a", middle[0]),
        ("b", middle[0]),
        middle,
        (middle[1], "c"),
        (middle[1], "d"),
    }


def test_series_before_merge(spark):
    edges = ["a->AndS1", "b->AndS2", "AndS1->AndJ", "AndS2->AndJ", "AndJ->c"]
    assert arrows(reduction.reduced_gateways(edges_df(spark, edges))) == ["AndJ->c", "a->AndJ", "b->AndJ"]


def test_incomplete_block(spark):
    edges = [e for e in biclique("XOR", "And") if e != "XOR2->And4"]
    df = edges_df(spark, edges)
    assert reduction.block_redexes(df).isEmpty()
    # XOR2 and And4 are series gateways
    assert arrows(reduction.reduced_gateways(df)) == ["And3->c", "XOR1->And3", "XOR1->d", "a->XOR1", "b->And3"]


def test_extra_successor_is_no_block(spark):
    edges = [*biclique("XOR", "And"), "XOR1->And5", "x->And5", "And5->e"]
    assert reduction.block_redexes(edges_df(spark, edges)).isEmpty()


def test_mixed_block(spark):
    """F of both kinds: reduced to one kind, left alone when strict."""
    edges = [e.replace("And4", "XOR4") for e in biclique("XOR", "And")]
    df = edges_df(spark, edges)
    assert rows(reduction.block_redexes(df), "k", "rule") == [("And3", "swap")]
    assert len(rows(reduction.reduced_gateways(df))) == 5
    assert reduction.block_redexes(df, strict=True).isEmpty()
    assert arrows(reduction.reduced_gateways(df, strict=True)) == sorted(edges)


def test_swap_with_wide_ends(spark):
    """k needs a single successor for a swap; strict asks it of all of F."""
    edges = [*biclique("XOR", "And"), "And4->e"]
    df = edges_df(spark, edges)
    assert rows(reduction.block_redexes(df), "k", "rule") == [("And3", "swap")]
    assert reduction.block_redexes(df, strict=True).isEmpty()
    both_wide = edges_df(spark, [*edges, "And3->x"])
    assert reduction.block_redexes(both_wide).isEmpty()


def test_touching_blocks(spark):
    """Of two blocks in a row only one is applied per round; the rest follows."""
    first = [f"And{h}->And{f}" for h, f in itertools.product("12", "34")]
    second = [f"And{h}->And{f}" for h, f in itertools.product("34", "56")]
    ends = ["a->And1", "b->And2", "And5->c", "And6->d"]
    df = edges_df(spark, first + second + ends)
    assert len(rows(reduction.block_redexes(df))) == 2
    once, fired = reduction.block_round(df)
    assert fired and len(rows(reduction.block_redexes(once))) <= 1
    result = rows(reduction.reduced_gateways(df))
    assert len(result) == 4 and len({d for _, s, _, d, _ in result if s in "ab"}) == 1


def test_models_reduce_apart(spark):
    df = edges_df(spark, biclique("XOR", "And"), "m1").unionByName(edges_df(spark, biclique("And", "And"), "m2"))
    df = df.unionByName(edges_df(spark, ["p->XOR1", "XOR1->s"], "m3"))
    result = rows(reduction.reduced_gateways(df))
    assert [len([r for r in result if r[0] == m]) for m in ["m1", "m2", "m3"]] == [5, 4, 1]


def test_names_do_not_mix_kinds(spark):
    """An activity called like a gateway stays an activity."""
    places = places_df(spark, [({"AndS:a"}, {"b", "XOR:q"}), ({"a"}, {"b"})])
    edges = gateways.gateway_edges(places)
    result = rows(reduction.reduced_gateways(edges))
    assert reach_pairs(result) == {("AndS:a", "b"), ("AndS:a", "XOR:q"), ("a", "b")}


@pytest.mark.parametrize("log", [LOG1, LOG2], ids=["log1", "log2"])
def test_published_models(spark, log):
    """Expansion, reduction, labels and fuzzy arcs of published models."""
    places = places_df(spark, log["places"])
    dfg = dfg_df(spark, log["arcs"])
    expanded = gateways.gateway_edges(places)
    assert expanded.count() == log["expanded"]
    reduced = rows(reduction.reduced_gateways(expanded))
    assert len(reduced) == len(log["precise"])
    assert reach_pairs(reduced) == reach_pairs(rows(expanded))
    model = model_from_places(places, dfg).where("layer = 'precise'")
    # Gateways are named after their activity or place, with numbers in the
    # published text; edges are compared by kinds, activity ends and count.
    got = sorted((s if sk == "ACT" else sk, d if dk == "ACT" else dk, n) for s, sk, d, dk, n in rows(model, "src", "src_kind", "dst", "dst_kind", "n"))
    assert got == sorted(log["precise"])
    explained = {(x, y) for a, b in log["places"] for x in a for y in b}
    fuzzy = rows(labels.fuzzy_arcs(dfg, places), "src", "dst", "n")
    assert fuzzy == sorted((a for a in log["arcs"] if a[:2] not in explained), key=repr)


def test_reach_of_cycle(spark):
    edges = edges_df(spark, ["a->XOR1", "XOR1->And2", "And2->XOR1", "And2->b"])
    assert rows(labels.gateway_reach(edges, True), "node", "activity") == [("And2", "b"), ("XOR1", "b")]
    assert rows(labels.gateway_reach(edges, False), "node", "activity") == [("And2", "a"), ("XOR1", "a")]


def test_missing_arcs_count_nothing(spark):
    model = model_from_places(places_df(spark, [("a", "b")]), dfg_df(spark, [("a", "c", 4)]))
    assert rows(model, "src", "dst", "layer", "n") == [("a", "b", "precise", 0), ("a", "c", "fuzzy", 4)]


def test_model_text(spark):
    model = model_from_places(
        places_df(spark, [("a", "bc"), ({"a"}, {'q"x'})]),
        dfg_df(spark, [("a", "b", 2), ("a", "c", 3), ("a", 'q"x', 1), ("z", "a", 9)]),
    )
    path = new_path(spark, "model")
    text.write_model(model, path)
    lines = [r.value for r in spark.read.text(path + "/model_id=all").collect()]
    assert lines[0] == "digraph model { node [shape=box, style=rounded]" and lines[-1] == "}"
    assert '"z" -> "a" [color=black,label="9"];' in lines
    assert '"AndS:a" [shape=diamond,label="AND"];' in lines
    assert any('\\"x"' in line and "color=purple" in line for line in lines)
    kinds = ["shape" in x if i else True for i, x in enumerate(lines[:-1])]
    assert kinds == sorted(kinds, reverse=True)


def test_a_swap_enables_a_merge(spark):
    """One block round is not the end of the layered graph."""
    edges = queries._layered_graph(spark, "/root/testdata/sf0.001")
    once, fired = reduction.block_round(edges)
    end = reduction.reduced_gateways(edges)
    assert fired and set(rows(once)) != set(rows(end)) != set(rows(edges))
    gates = {r.node for r in gateway_nodes(end).collect()}
    assert {g.split(":")[0] for g in gates} == {"XOR*", "And*"} and len(gates) == 2


def test_nodes_with_equal_activities_share_a_set(spark, monkeypatch):
    members = [("m", f"XOR{i}", "XOR", a) for i, names in enumerate(["ab", "ba", "a", "abc", "b"]) for a in names]
    members += [("n", "XOR0", "XOR", "a"), ("n", "XOR0", "XOR", "b"), ("m", "b", "ACT", "b")]
    df = spark.createDataFrame(members, "model_id STRING, node STRING, kind STRING, activity STRING")

    def sets():
        return {(r.model_id, r.node): r.set.node for r in labels.shared_sets(df).collect()}

    want = {("m", "XOR0"): "XOR0", ("m", "XOR1"): "XOR0", ("m", "XOR2"): "XOR2", ("m", "XOR3"): "XOR3"}
    assert sets() == want | {("m", "XOR4"): "XOR4", ("m", "b"): "XOR4", ("n", "XOR0"): "XOR0"}
    # Hashes that tell nothing apart: sets of equal size are told apart by the proof.
    monkeypatch.setattr(labels.F, "xxhash64", lambda *columns: labels.F.lit(0).cast("bigint"))
    assert sets() == want | {("m", "XOR2"): "XOR2", ("m", "XOR4"): "XOR4", ("m", "b"): "b", ("n", "XOR0"): "XOR0"}
