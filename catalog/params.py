"""Thresholds of the registered queries: they split each log's candidates."""

PARAMS = {
    "events_day": {
        "0f": {"gamma": 0.08},
        "1f": {"gamma": 0.08, "beta": 0.15},
        "2f": {"gamma": 0.08, "beta": 0.15, "alpha": 0.35},
    },
    "conversations": {
        "0f": {"gamma": 0.10},
        "1f": {"gamma": 0.10, "beta": 0.3},
        "2f": {"gamma": 0.10, "beta": 0.3, "alpha": 0.3},
    },
    "orders": {
        "0f": {"gamma": 0.03},
        "1f": {"gamma": 0.03, "beta": 0.1},
        "2f": {"gamma": 0.03, "beta": 0.1, "alpha": 0.2},
    },
    "lineitem": {
        "0f": {"gamma": 0.08},
        "1f": {"gamma": 0.08, "beta": 0.174},
        "2f": {"gamma": 0.08, "beta": 0.174, "alpha": 0.3},
    },
}

#: Smallest min/max ratio that counts as similar.
DELTA = 0.5

#: Copies made by log replication.
COPIES = 3

#: Thresholds (alpha, beta, gamma) that one pass answers together.
GRID = [
    (alpha, beta, gamma) for alpha in (None, 0.2, 0.35) for beta in (None, 0.15, 0.2) for gamma in (0.04, 0.08, 0.12)
]
