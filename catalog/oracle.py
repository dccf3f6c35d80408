"""SQL statements that give the registered queries' results independently.

Written for DuckDB over the same tables. Sets are shown as `a+b`.
"""

from __future__ import annotations

import re

from catalog.params import COPIES, DELTA, GRID, PARAMS

RAW = {
    "events_day": """
        SELECT 'all' AS model_id, user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id,
               row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
               event_type AS activity
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL""",
    "conversations": """
        SELECT 'all' AS model_id, CAST(conv_id AS VARCHAR) AS case_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role AS activity
        FROM conversations""",
    "orders": """
        SELECT c_mktsegment AS model_id, CAST(o_custkey AS VARCHAR) AS case_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos,
               o_orderstatus AS activity
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lineitem": """
        SELECT 'all' AS model_id, CAST(l_orderkey AS VARCHAR) AS case_id,
               row_number() OVER (PARTITION BY l_orderkey
                                  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS pos,
               l_returnflag || l_linestatus AS activity
        FROM lineitem""",
}


def _sets(key: str, item: str) -> str:
    """One to three neighbours `item` of `key`, in name order, as lists."""
    arcs = f"(SELECT model_id, {key} AS one, {item} AS x FROM dfg)"
    return f"""
        SELECT model_id, one, [x] AS items FROM {arcs}
        UNION ALL
        SELECT model_id, one, [p.x, q.x] FROM {arcs} p JOIN {arcs} q USING (model_id, one) WHERE p.x < q.x
        UNION ALL
        SELECT model_id, one, [p.x, q.x, r.x]
        FROM {arcs} p JOIN {arcs} q USING (model_id, one) JOIN {arcs} r USING (model_id, one)
        WHERE p.x < q.x AND q.x < r.x"""


def _log(log: str) -> list[tuple[str, str]]:
    return [("ev", RAW[log])]


def _dfg(log: str) -> list[tuple[str, str]]:
    return _log(log) + [
        (
            "pairs",
            """
        SELECT * FROM (
            SELECT model_id, case_id, pos, activity AS src,
                   lead(activity) OVER (PARTITION BY model_id, case_id ORDER BY pos) AS dst
            FROM ev)
        WHERE dst IS NOT NULL""",
        ),
        ("dfg", "SELECT model_id, src, dst, count(*) AS n FROM pairs GROUP BY model_id, src, dst"),
    ]


def _candidates(log: str) -> list[tuple[str, str]]:
    return _dfg(log) + [
        ("successors", _sets("src", "dst")),
        ("predecessors", _sets("dst", "src")),
        (
            "cand",
            """
        SELECT model_id, [one] AS a_set, items AS b_set FROM successors
        WHERE len(items) > 1 AND NOT list_contains(items, one)
        UNION ALL
        SELECT model_id, items, [one] FROM predecessors WHERE NOT list_contains(items, one)""",
        ),
    ]


def _checked(log: str, alpha: float | None = None) -> list[tuple[str, str]]:
    members = """
        SELECT model_id, a_set, b_set, unnest(a_set) AS activity, 1 AS d FROM {0}
        UNION ALL SELECT model_id, a_set, b_set, unnest(b_set), -1 FROM {0}"""
    result = _candidates(log) + [
        ("totals", "SELECT model_id, activity, count(*) AS n FROM ev GROUP BY model_id, activity"),
        ("cand_members", members.format("cand")),
        (
            "log_level",
            """
        SELECT *, abs(n_a - n_b) / (n_a + n_b) AS gap FROM (
            SELECT model_id, a_set, b_set,
                   CAST(sum(CASE WHEN d > 0 THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS n_a,
                   CAST(sum(CASE WHEN d < 0 THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS n_b
            FROM cand_members LEFT JOIN totals USING (model_id, activity)
            GROUP BY model_id, a_set, b_set)
        WHERE n_a + n_b > 0""",
        ),
    ]
    chosen = "SELECT model_id, a_set, b_set FROM "
    chosen += "cand" if alpha is None else f"log_level WHERE gap <= {_double(alpha)}"
    return result + [
        ("after_log", chosen),
        ("members", members.format("after_log")),
        (
            "steps",
            """
        SELECT model_id, a_set, b_set, case_id, d,
               sum(d) OVER (PARTITION BY model_id, a_set, b_set, case_id ORDER BY pos
                            ROWS UNBOUNDED PRECEDING) AS balance
        FROM ev JOIN members USING (model_id, activity)""",
        ),
        (
            "walks",
            """
        SELECT model_id, a_set, b_set, case_id, sum(d) AS fin, min(balance) AS low,
               count(*) FILTER (WHERE d > 0) AS n_a, count(*) FILTER (WHERE d < 0) AS n_b
        FROM steps GROUP BY model_id, a_set, b_set, case_id""",
        ),
        (
            "supp",
            f"""
        SELECT model_id, a_set, b_set, count(*) AS touched,
               count(*) FILTER (WHERE fin = 0) AS trace_hit,
               count(*) FILTER (WHERE fin = 0 AND low >= 0) AS prefix_hit,
               count(*) FILTER (WHERE least(n_a, n_b) > 0
                                AND least(n_a, n_b) / greatest(n_a, n_b) >= {_double(DELTA)}) AS similar_hit
        FROM walks GROUP BY model_id, a_set, b_set""",
        ),
    ]


def _double(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _kept(log: str, gamma: float, beta: float | None = None, alpha: float | None = None) -> list[tuple[str, str]]:
    trace = "SELECT * FROM supp"
    if beta is not None:
        trace += f" WHERE trace_hit > 0 AND trace_hit / touched >= {_double(beta)}"
    return _checked(log, alpha) + [
        ("after_trace", trace),
        (
            "kept",
            f"SELECT * FROM after_trace WHERE prefix_hit > 0 AND prefix_hit / touched >= {_double(gamma)}",
        ),
    ]


def _expanded(log: str) -> list[tuple[str, str]]:
    return _kept(log, **PARAMS[log]["0f"]) + [
        ("a_side", f"SELECT model_id, {PLACE_ID} AS place, unnest(a_set) AS x FROM kept"),
        ("b_side", f"SELECT model_id, {PLACE_ID} AS place, unnest(b_set) AS x FROM kept"),
        (
            "gw",
            """
        SELECT model_id, x AS src, 'ACT' AS src_kind, 'AndS:' || x AS dst, 'AND' AS dst_kind FROM a_side
        UNION SELECT model_id, 'AndS:' || x, 'AND', 'XOR:' || place, 'XOR' FROM a_side
        UNION SELECT model_id, 'XOR:' || place, 'XOR', 'AndJ:' || x, 'AND' FROM b_side
        UNION SELECT model_id, 'AndJ:' || x, 'AND', x, 'ACT' FROM b_side""",
        ),
    ]


def _sql(ctes: list[tuple[str, str]], select: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"


A, B = "array_to_string(a_set, '+') AS a_set", "array_to_string(b_set, '+') AS b_set"
PLACE_ID = "array_to_string(a_set, '+') || '>' || array_to_string(b_set, '+')"

DEGREES = """
    SELECT model_id, node, kind, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out
    FROM (SELECT model_id, dst AS node, dst_kind AS kind, 1 AS i, 0 AS o FROM {0}
          UNION ALL SELECT model_id, src, src_kind, 0, 1 FROM {0})
    GROUP BY model_id, node, kind"""


def _outcome(hit: str, condition: str = "TRUE") -> str:
    return (
        f"SELECT model_id, {A}, {B}, {hit} AS hit, touched - {hit} AS miss, {hit} / touched AS ratio"
        f" FROM supp WHERE {condition}"
    )


def _discovery(log: str, variant: str) -> str:
    select = (
        f"SELECT model_id, {A}, {B}, prefix_hit AS hit, touched - prefix_hit AS miss,"
        " prefix_hit / touched AS ratio FROM kept"
    )
    return _sql(_kept(log, **PARAMS[log][variant]), select)


def _grid(log: str) -> str:
    """Every cell of the grid filtered on its own."""

    def cell(alpha: float | None, beta: float | None, gamma: float) -> str:
        tests = [f"prefix_hit > 0 AND prefix_hit / touched >= {_double(gamma)}"]
        if beta is not None:
            tests.append(f"trace_hit > 0 AND trace_hit / touched >= {_double(beta)}")
        if alpha is not None:
            tests.append(f"gap <= {_double(alpha)}")
        shown = [f"CAST({'NULL' if x is None else x} AS DOUBLE) AS {c}" for c, x in zip(["alpha", "beta", "gamma"], (alpha, beta, gamma), strict=True)]
        return (
            f"SELECT {', '.join(shown)}, model_id, {A}, {B}, prefix_hit AS hit, touched - prefix_hit AS miss,"
            f" prefix_hit / touched AS ratio FROM supp JOIN log_level USING (model_id, a_set, b_set) WHERE {' AND '.join(tests)}"
        )

    return _sql(_checked(log), "\nUNION ALL ".join(cell(*c) for c in GRID))


def _funnel(log: str) -> str:
    stages = [("1 candidates", "cand"), ("2 log level", "after_log"), ("3 trace level", "after_trace"), ("4 prefix level", "kept")]
    counted = "\nUNION ALL ".join(
        [f"SELECT model_id, '{stage}' AS stage, count(*) AS n FROM {table} GROUP BY model_id" for stage, table in stages]
        + [
            f"SELECT model_id, '{stage}', count(DISTINCT x) FROM (SELECT model_id, {item} AS x FROM kept) GROUP BY model_id"
            for stage, item in [
                ("5 AND-splits", "unnest(a_set)"),
                ("6 AND-joins", "unnest(b_set)"),
                ("7 XORs", "[a_set, b_set]"),
            ]
        ]
    )
    names = ", ".join(f"('{s}')" for s in [s for s, _ in stages] + ["5 AND-splits", "6 AND-joins", "7 XORs"])
    return _sql(
        _kept(log, **PARAMS[log]["2f"]) + [("counted", counted)],
        f"""
        SELECT model_id, stage, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT model_id FROM ev) CROSS JOIN (VALUES {names}) AS s(stage)
        LEFT JOIN counted USING (model_id, stage)""",
    )


# One complete block of AND gateways, merged into one; no row if a pair is missing.
BLOCK_MERGE = """
    WITH pairs AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem),
    merged AS (
        SELECT 'And*:' || least('AndS:' || min(a), 'AndJ:' || min(b)) AS node
        FROM pairs HAVING count(*) = count(DISTINCT a) * count(DISTINCT b))
    SELECT DISTINCT 'all' AS model_id, a AS src, 'ACT' AS src_kind, node AS dst, 'AND' AS dst_kind FROM pairs, merged
    UNION ALL
    SELECT DISTINCT 'all', node, 'AND', b, 'ACT' FROM pairs, merged"""


ROUNDS = 8  # series rounds written out; the result is an error if the last one still changed an edge


def _series_round(edges: str, i: int) -> list[tuple[str, str]]:
    """Bypass every series gateway that does not follow another one."""
    return [
        (f"deg{i}", DEGREES.format(edges)),
        (
            f"ser{i}",
            f"""
        SELECT d.model_id, d.node, d.kind, i.src AS pred, i.src_kind AS pred_kind, o.dst AS succ, o.dst_kind AS succ_kind
        FROM deg{i} d
        JOIN {edges} i ON i.model_id = d.model_id AND i.dst = d.node AND i.dst_kind = d.kind
        JOIN {edges} o ON o.model_id = d.model_id AND o.src = d.node AND o.src_kind = d.kind
        WHERE d.kind <> 'ACT' AND n_in = 1 AND n_out = 1""",
        ),
        (
            f"head{i}",
            f"""
        SELECT * FROM ser{i} s WHERE NOT EXISTS (
            SELECT 1 FROM ser{i} p WHERE p.model_id = s.model_id AND p.node = s.pred AND p.kind = s.pred_kind)""",
        ),
        (
            f"gw{i}",
            f"""
        SELECT * FROM {edges} e WHERE NOT EXISTS (
            SELECT 1 FROM head{i} h WHERE h.model_id = e.model_id
               AND ((h.node = e.src AND h.kind = e.src_kind) OR (h.node = e.dst AND h.kind = e.dst_kind)))
        UNION SELECT model_id, pred, pred_kind, succ, succ_kind FROM head{i}""",
        ),
    ]


def _reduced(log: str) -> list[tuple[str, str]]:
    ctes, edges = _expanded(log), "gw"
    for i in range(1, ROUNDS + 1):
        ctes, edges = ctes + _series_round(edges, i), f"gw{i}"
    return ctes + [
        ("open", f"SELECT count(*) AS n FROM head{ROUNDS}"),
        ("gw_end", f"SELECT * FROM gw{ROUNDS} WHERE CASE WHEN (SELECT n FROM open) > 0 THEN error('more rounds are needed') ELSE true END"),
    ]


def _blocks(edges: str) -> list[tuple[str, str]]:
    """Complete blocks by comparing neighbour lists."""
    return [
        (
            "preds",
            f"""
        SELECT model_id, dst AS node, dst_kind AS kind, list_sort(list(src)) AS h_nodes,
               count(*) AS n_h, min(src_kind) AS h_kind, count(DISTINCT src_kind) AS h_kinds
        FROM {edges} GROUP BY model_id, dst, dst_kind""",
        ),
        (
            "succs",
            f"""
        SELECT model_id, src AS node, src_kind AS kind, list_sort(list(dst)) AS f_nodes, count(*) AS n_out
        FROM {edges} GROUP BY model_id, src, src_kind""",
        ),
        (
            "groups",
            """
        SELECT p.model_id, p.h_nodes, p.n_h, p.h_kind, list_sort(list(p.node)) AS f_nodes, count(*) AS n_f,
               min(CASE WHEN p.kind = p.h_kind OR s.n_out = 1 THEN p.node END) AS k
        FROM preds p JOIN succs s USING (model_id, node, kind)
        WHERE p.kind <> 'ACT' AND p.n_h > 1 AND p.h_kinds = 1 AND p.h_kind <> 'ACT'
        GROUP BY p.model_id, p.h_nodes, p.n_h, p.h_kind""",
        ),
        (
            "blocks",
            """
        SELECT g.* FROM groups g WHERE k IS NOT NULL AND g.n_h = (
            SELECT count(*) FROM succs s
            WHERE s.model_id = g.model_id AND s.kind = g.h_kind AND list_contains(g.h_nodes, s.node)
              AND s.f_nodes = g.f_nodes)""",
        ),
        (
            "redexes",
            """
        SELECT b.model_id, b.k, p.kind AS k_kind, b.h_kind, b.n_h, b.n_f,
               CASE WHEN p.kind = b.h_kind THEN 'merge' ELSE 'swap' END AS rule
        FROM blocks b JOIN preds p ON p.model_id = b.model_id AND p.node = b.k AND p.kind <> 'ACT'""",
        ),
    ]


def _reduce_round(edges: str) -> list[tuple[str, str]]:
    """One series round: of neighbouring series gateways the lowest hash goes."""
    return _series_round(edges, 1) + [
        ("ranked", "SELECT *, md5(kind || ':' || node) AS rank FROM ser1"),
        (
            "lowest",
            """
        SELECT model_id, node, kind, min(rank) AS lo FROM (
            SELECT model_id, node, kind, rank FROM ranked
            UNION ALL SELECT model_id, pred, pred_kind, rank FROM ranked
            UNION ALL SELECT model_id, succ, succ_kind, rank FROM ranked)
        GROUP BY model_id, node, kind""",
        ),
        ("chosen", "SELECT r.* FROM ranked r JOIN lowest USING (model_id, node, kind) WHERE rank = lo"),
        (
            "round",
            f"""
        SELECT * FROM {edges} e WHERE NOT EXISTS (
            SELECT 1 FROM chosen c WHERE c.model_id = e.model_id
               AND ((c.node = e.src AND c.kind = e.src_kind) OR (c.node = e.dst AND c.kind = e.dst_kind)))
        UNION SELECT model_id, pred, pred_kind, succ, succ_kind FROM chosen""",
        ),
    ]


def _block_round(edges: str) -> list[tuple[str, str]]:
    """One block round: of blocks that touch, the one with the smallest k is applied."""
    return _blocks(edges) + [
        (
            "named_blocks",
            """
        SELECT b.*, p.kind AS k_kind, p.kind <> b.h_kind AS swap
        FROM blocks b JOIN preds p ON p.model_id = b.model_id AND p.node = b.k AND p.kind <> 'ACT'""",
        ),
        (
            "inner_nodes",
            """
        SELECT model_id, k, unnest(h_nodes) AS node, 'H' AS side FROM named_blocks
        UNION ALL SELECT model_id, k, unnest(f_nodes), 'F' FROM named_blocks""",
        ),
        (
            "footprint",
            f"""
        SELECT model_id, k, node FROM inner_nodes
        UNION SELECT i.model_id, i.k, e.src FROM inner_nodes i
            JOIN {edges} e ON e.model_id = i.model_id AND e.dst = i.node WHERE i.side = 'H'
        UNION SELECT i.model_id, i.k, e.dst FROM inner_nodes i
            JOIN {edges} e ON e.model_id = i.model_id AND e.src = i.node WHERE i.side = 'F'""",
        ),
        (
            "free_blocks",
            """
        SELECT model_id, k FROM footprint
        JOIN (SELECT model_id, node, min(k) AS lo FROM footprint GROUP BY model_id, node) USING (model_id, node)
        GROUP BY model_id, k HAVING bool_and(k = lo)""",
        ),
        (
            "renaming",
            """
        SELECT i.model_id, i.node,
               CASE WHEN swap AND side = 'F' THEN h_kind ELSE k_kind END AS new_kind,
               CASE CASE WHEN swap AND side = 'F' THEN h_kind ELSE k_kind END WHEN 'AND' THEN 'And*:' ELSE 'XOR*:' END
               || CASE WHEN NOT swap THEN least(list_min(h_nodes), list_min(f_nodes))
                       WHEN side = 'H' THEN list_min(h_nodes) ELSE list_min(f_nodes) END AS new_node
        FROM inner_nodes i JOIN free_blocks USING (model_id, k) JOIN named_blocks USING (model_id, k)""",
        ),
        (
            "round",
            f"""
        SELECT DISTINCT * FROM (
            SELECT e.model_id, coalesce(s.new_node, e.src) AS src, coalesce(s.new_kind, e.src_kind) AS src_kind,
                   coalesce(t.new_node, e.dst) AS dst, coalesce(t.new_kind, e.dst_kind) AS dst_kind
            FROM {edges} e
            LEFT JOIN renaming s ON s.model_id = e.model_id AND s.node = e.src AND e.src_kind <> 'ACT'
            LEFT JOIN renaming t ON t.model_id = e.model_id AND t.node = e.dst AND e.dst_kind <> 'ACT')
        WHERE src <> dst OR src_kind <> dst_kind""",
        ),
    ]


LAYERED = """
    SELECT 'all' AS model_id, l_returnflag AS src, 'ACT' AS src_kind, 'AndS:' || l_returnflag AS dst, 'AND' AS dst_kind FROM lineitem
    UNION SELECT 'all', 'AndS:' || l_returnflag, 'AND', 'XOR:' || l_linestatus, 'XOR' FROM lineitem
    UNION SELECT 'all', 'XOR:' || l_linestatus, 'XOR', 'AndJ:' || l_linestatus, 'AND' FROM lineitem
    UNION SELECT 'all', CAST(l_linenumber AS VARCHAR), 'ACT', 'AndS:' || l_linenumber, 'AND' FROM lineitem
    UNION SELECT 'all', 'AndS:' || l_linenumber, 'AND', 'AndJ:' || l_linestatus, 'AND' FROM lineitem
    UNION SELECT 'all', 'AndJ:' || l_linestatus, 'AND', l_linestatus, 'ACT' FROM lineitem"""

BLOCK_ROUNDS = 3  # the last one must find nothing left to do


def _block_rounds(graph: str) -> str:
    """Block rounds one after the other; an error if the last still applies a rule or a series gateway is left."""
    ctes, edges = [("gw", graph)], "gw"
    for i in range(1, BLOCK_ROUNDS + 1):
        own = _block_round(edges)
        for name, sql in own:
            for other, _ in own:
                sql = re.sub(rf"\b{other}\b", f"{other}_{i}", sql)
            ctes.append((f"{name}_{i}", sql))
        edges = f"round_{i}"
    left = f"(SELECT count(*) FROM free_blocks_{BLOCK_ROUNDS}) + (SELECT count(*) FROM ser1)"
    select = f"SELECT * FROM {edges} WHERE CASE WHEN {left} > 0 THEN error('more rounds are needed') ELSE true END"
    return _sql(ctes + _series_round(edges, 1), select)


def _reach(edges: str) -> list[tuple[str, str]]:
    def walk(frm: str, to: str) -> str:
        return f"""
        SELECT model_id, {frm} AS node, {frm}_kind AS kind, {to} AS t, {to}_kind AS t_kind
        FROM {edges} WHERE {frm}_kind <> 'ACT'
        UNION
        SELECT w.model_id, w.node, w.kind, e.{to}, e.{to}_kind
        FROM {{name}} w JOIN {edges} e ON e.model_id = w.model_id AND e.{frm} = w.t AND e.{frm}_kind = w.t_kind
        WHERE w.t_kind <> 'ACT'"""

    return [
        ("fwd", walk("src", "dst").format(name="fwd")),
        ("bwd", walk("dst", "src").format(name="bwd")),
    ]


def _labelled(edges: str) -> list[tuple[str, str]]:
    return _reach(edges) + [
        ("nodes", f"SELECT model_id, src AS node, src_kind AS kind FROM {edges} UNION SELECT model_id, dst, dst_kind FROM {edges}"),
        (
            "ends",
            """
        SELECT model_id, node, kind, t AS activity FROM fwd WHERE t_kind = 'ACT'
        UNION SELECT model_id, node, kind, node FROM nodes WHERE kind = 'ACT'""",
        ),
        (
            "starts",
            """
        SELECT model_id, node, kind, t AS activity FROM bwd WHERE t_kind = 'ACT'
        UNION SELECT model_id, node, kind, node FROM nodes WHERE kind = 'ACT'""",
        ),
        (
            "precise",
            f"""
        SELECT e.model_id, e.src, e.src_kind, e.dst, e.dst_kind, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n
        FROM {edges} e
        JOIN starts s ON s.model_id = e.model_id AND s.node = e.src AND s.kind = e.src_kind
        JOIN ends t ON t.model_id = e.model_id AND t.node = e.dst AND t.kind = e.dst_kind
        LEFT JOIN dfg d ON d.model_id = e.model_id AND d.src = s.activity AND d.dst = t.activity
        GROUP BY e.model_id, e.src, e.src_kind, e.dst, e.dst_kind""",
        ),
    ]


FUZZY = """
    SELECT model_id, src, dst, n FROM dfg d WHERE NOT EXISTS (
        SELECT 1 FROM kept k WHERE k.model_id = d.model_id
           AND list_contains(a_set, d.src) AND list_contains(b_set, d.dst))"""


def _model(log: str) -> list[tuple[str, str]]:
    return _reduced(log) + _labelled("gw_end") + [
        (
            "model",
            f"""
        SELECT model_id, src, src_kind, dst, dst_kind, 'precise' AS layer, n FROM precise
        UNION ALL SELECT model_id, src, 'ACT', dst, 'ACT', 'fuzzy', n FROM ({FUZZY})""",
        ),
    ]


MODEL_LINES = """
    SELECT DISTINCT model_id, CAST(0 AS INTEGER) AS section, 'digraph model { node [shape=box, style=rounded]' AS line FROM model
    UNION ALL SELECT DISTINCT model_id, 4, '}' FROM model
    UNION ALL SELECT model_id, 1, '"' || node || '" [shape=diamond,label="' || kind || '"];'
    FROM nodes WHERE kind <> 'ACT'
    UNION ALL SELECT model_id, CASE layer WHEN 'precise' THEN 2 ELSE 3 END,
        '"' || src || '" -> "' || dst || '" [color=' || CASE layer WHEN 'precise' THEN 'purple' ELSE 'black' END
        || ',label="' || n || '"];' FROM model"""


ORACLE: dict[str, str] = {
    "trace_text_roundtrip": _sql(
        _log("events_day"),
        "SELECT case_id, CAST(count(*) AS INTEGER) AS n, string_agg(activity, ',' ORDER BY pos) AS activities"
        " FROM ev GROUP BY case_id",
    ),
    "event_positions": _sql(_log("events_day"), "SELECT model_id, case_id, pos, activity FROM ev"),
    "trace_arrays": _sql(
        _log("events_day"),
        "SELECT model_id, case_id, string_agg(activity, '+' ORDER BY pos) AS activities FROM ev GROUP BY model_id, case_id",
    ),
    "trace_variants": _sql(
        _log("lineitem"),
        "SELECT model_id, activities, count(*) AS mult FROM (SELECT model_id, case_id,"
        " string_agg(activity, '+' ORDER BY pos) AS activities FROM ev GROUP BY model_id, case_id)"
        " GROUP BY model_id, activities",
    ),
    "replicate_log": _sql(
        _log("conversations")
        + [
            (
                "lines",
                "SELECT model_id, case_id, string_agg(activity, '+' ORDER BY pos) AS activities FROM ev GROUP BY model_id, case_id",
            ),
            ("numbered", "SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS p, count(*) OVER () AS n FROM lines"),
        ],
        f"SELECT model_id, CAST(copy * n + p AS VARCHAR) AS case_id, activities"
        f" FROM numbered, range({COPIES}) AS r(copy)",
    ),
    "log_summary": _sql(
        _log("orders"),
        "SELECT model_id, count(DISTINCT case_id) AS n_traces, count(*) AS n_events FROM ev GROUP BY model_id",
    ),
    "activity_counts": _sql(
        _log("events_day"), "SELECT model_id, activity, count(*) AS n FROM ev GROUP BY model_id, activity"
    ),
    "trace_bags": _sql(
        _log("events_day"),
        "SELECT model_id, case_id, activity, count(*) AS cnt FROM ev GROUP BY model_id, case_id, activity",
    ),
    "succession_pairs": _sql(_dfg("events_day"), "SELECT model_id, case_id, pos, src, dst FROM pairs"),
    "dfg": _sql(_dfg("events_day"), "SELECT * FROM dfg"),
    "dfg_lineitem": _sql(_dfg("lineitem"), "SELECT * FROM dfg"),
    "segmented_dfg": _sql(_dfg("orders"), "SELECT * FROM dfg"),
    "dfg_adjacency_lines": _sql(
        _dfg("orders"),
        "SELECT model_id, src || ',' || string_agg('(' || dst || ',' || n || ')', ',' ORDER BY dst) AS value"
        " FROM dfg GROUP BY model_id, src",
    ),
    "dfg_text_roundtrip": _sql(_dfg("lineitem"), "SELECT * FROM dfg"),
    "segmented_dfg_text_roundtrip": _sql(_dfg("orders"), "SELECT * FROM dfg"),
    "dfg_from_text": _sql(_dfg("events_day"), "SELECT * FROM dfg"),
    "adjacency_list": _sql(
        _dfg("events_day"),
        "SELECT model_id, src, string_agg(dst, '+' ORDER BY dst) AS dsts FROM dfg GROUP BY model_id, src",
    ),
    "successor_subsets": _sql(
        _candidates("events_day"), "SELECT model_id, one AS src, array_to_string(items, '+') AS b_set FROM successors"
    ),
    "inverted_list": _sql(
        _candidates("orders"),
        "SELECT model_id, array_to_string(items, '+') AS b_set, string_agg(one, '+' ORDER BY one) AS srcs"
        " FROM successors GROUP BY model_id, items",
    ),
    "candidates_split": _sql(_candidates("events_day"), f"SELECT model_id, {A}, {B} FROM cand WHERE len(b_set) > 1"),
    "candidates_join": _sql(_candidates("events_day"), f"SELECT model_id, {A}, {B} FROM cand WHERE len(b_set) = 1"),
    "candidates_all": _sql(_candidates("lineitem"), f"SELECT model_id, {A}, {B} FROM cand"),
    "log_level_check": _sql(
        _checked("lineitem"),
        f"SELECT model_id, {A}, {B}, n_a, n_b, gap FROM log_level"
        f" WHERE gap <= {_double(PARAMS['lineitem']['2f']['alpha'])}",
    ),
    "candidates_balanced": _sql(
        _checked("lineitem"),
        f"SELECT model_id, {A}, {B}, n_a, n_b, gap FROM log_level"
        f" WHERE gap <= {_double(PARAMS['lineitem']['2f']['alpha'])}",
    ),
    "trace_level_check": _sql(_checked("lineitem"), _outcome("trace_hit")),
    "prefix_level_check": _sql(_checked("lineitem"), _outcome("prefix_hit")),
    "trace_level_check_events": _sql(
        _checked("events_day"),
        _outcome("trace_hit", f"trace_hit / touched >= {_double(PARAMS['events_day']['1f']['beta'])}"),
    ),
    "prefix_level_check_events": _sql(
        _checked("events_day"),
        _outcome("prefix_hit", f"prefix_hit / touched >= {_double(PARAMS['events_day']['0f']['gamma'])}"),
    ),
    "trace_similarity_check": _sql(_checked("events_day"), _outcome("similar_hit")),
    "discover_0f": _discovery("lineitem", "0f"),
    "discover_1f": _discovery("lineitem", "1f"),
    "discover_2f": _discovery("lineitem", "2f"),
    "discover_segments": _discovery("orders", "2f"),
    "discovery_grid": _grid("events_day"),
    "discovery_funnel": _funnel("events_day"),
    "discovery_funnel_segments": _funnel("orders"),
    "place_listing": _sql(
        _kept("events_day", **PARAMS["events_day"]["0f"]),
        "SELECT model_id, array_to_string(a_set, '.') || '.|' || array_to_string(b_set, '.') || '.' AS place FROM kept",
    ),
    "fuzzy_arcs": _sql(_kept("events_day", **PARAMS["events_day"]["0f"]), FUZZY),
    "gateway_edges": _sql(_expanded("orders"), "SELECT * FROM gw"),
    "gateway_numbering": _sql(
        _expanded("orders"),
        "SELECT model_id, family, node, dense_rank() OVER (PARTITION BY model_id, family ORDER BY node) - 1 AS number"
        " FROM (SELECT DISTINCT model_id, split_part(src, ':', 1) AS family, src AS node FROM gw WHERE src_kind <> 'ACT')",
    ),
    "node_kinds": _sql(
        _expanded("lineitem"),
        "SELECT model_id, src AS node, src_kind AS kind FROM gw UNION SELECT model_id, dst, dst_kind FROM gw",
    ),
    "gateway_degrees": _sql(_expanded("lineitem"), DEGREES.format("gw")),
    "series_redexes": _sql(
        _expanded("orders") + _series_round("gw", 1), "SELECT model_id, node, kind, pred, succ FROM ser1"
    ),
    "block_redexes": _sql(_expanded("orders") + _blocks("gw"), "SELECT * FROM redexes"),
    "series_reduction": _sql(_reduced("orders"), "SELECT * FROM gw_end"),
    "reduce_round": _sql(_expanded("orders") + _reduce_round("gw"), "SELECT * FROM round"),
    "block_round": _sql(_expanded("orders") + _block_round("gw"), "SELECT * FROM round"),
    "block_merge": BLOCK_MERGE,
    "block_fixpoint": BLOCK_MERGE,
    "block_rounds": _block_rounds(LAYERED),
    "gateway_reach": _sql(
        _expanded("orders") + _reach("gw"),
        "SELECT model_id, node, kind, t AS activity, 'forward' AS direction FROM fwd WHERE t_kind = 'ACT'"
        " UNION ALL SELECT model_id, node, kind, t, 'backward' FROM bwd WHERE t_kind = 'ACT'",
        recursive=True,
    ),
    "precise_labels": _sql(
        _expanded("lineitem") + _labelled("gw"), "SELECT * FROM precise", recursive=True
    ),
    # No complete block is left after the series rounds on these tables, so the
    # series fixpoint is the result; a block would show up as a mismatch.
    "reduced_gateways": _sql(_reduced("lineitem"), "SELECT * FROM gw_end"),
    "hybrid_model": _sql(_model("lineitem"), "SELECT * FROM model", recursive=True),
    "hybrid_model_segments": _sql(_model("orders"), "SELECT * FROM model", recursive=True),
    "model_text_lines": _sql(_model("events_day"), MODEL_LINES, recursive=True),
    "replicated_discovery": _sql(
        _kept("conversations", **PARAMS["conversations"]["2f"]),
        f"SELECT model_id, {A}, {B}, {COPIES} * prefix_hit AS hit, {COPIES} * (touched - prefix_hit) AS miss,"
        " prefix_hit / touched AS ratio FROM kept",
    ),
}
