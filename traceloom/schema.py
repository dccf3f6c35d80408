"""Table layouts. `model_id` tells the models of one run apart."""

ALL = "all"

CASE = ["model_id", "case_id"]
ARC = ["model_id", "src", "dst"]
PLACE = ["model_id", "a_set", "b_set"]
EDGE = ["model_id", "src", "src_kind", "dst", "dst_kind"]

# Node kinds of the gateway graph.
ACT, AND, XOR = "ACT", "AND", "XOR"

EVENTS = "model_id STRING, case_id STRING, pos BIGINT, activity STRING"
TRACES = "model_id STRING, case_id STRING, activities ARRAY<STRING>"
DFG = "model_id STRING, src STRING, dst STRING, n BIGINT"
PLACES = "model_id STRING, a_set ARRAY<STRING>, b_set ARRAY<STRING>"
EDGES = "model_id STRING, src STRING, src_kind STRING, dst STRING, dst_kind STRING"
MODEL = EDGES + ", layer STRING, n BIGINT"
