"""The command lines, end to end on a small text log."""

from jobs import amplify, dfg, discover
from traceloom.session import new_path
from traceloom.sources import text


def write_log(spark, lines):
    path = new_path(spark, "log")
    spark.createDataFrame([(f"{i},{','.join(t)}",) for i, t in enumerate(lines)], "value STRING").coalesce(1).write.text(path)
    return path


def test_log_to_model(spark):
    log = write_log(spark, ["sabe", "sbae", "sabe", "sxe"])
    larger, graph, model, table = (new_path(spark, "job") for _ in range(4))
    amplify.main(["--log", log, "--out", larger, "--copies", "2"])
    copies = {int(r.case_id): "".join(r.activities) for r in text.read_traces(spark, larger).collect()}
    assert [copies[i] for i in range(8)] == [r.value.replace(",", "")[1:] for r in spark.read.text(log).collect()] * 2
    dfg.main(["--log", larger, "--out", graph])
    arcs = {(r.src, r.dst): r.n for r in text.read_dfg(spark, graph).collect()}
    assert arcs[("s", "a")] == 4 and arcs[("a", "b")] == 4 and arcs[("x", "e")] == 2
    thresholds = ["--alpha", "0.5", "--beta", "0.9", "--gamma", "0.9"]
    discover.main(["--log", larger, "--dfg", graph, "--out", model, *thresholds])
    lines = [r.value for r in spark.read.text(model + "/model_id=all").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}"
    assert any("color=purple" in line for line in lines) and any("color=black" in line for line in lines)
    # the same from the log alone, as a table
    discover.main(["--log", log, "--out", table, "--format", "parquet", *thresholds])
    rows = spark.read.parquet(table).collect()
    assert len(rows) == sum("->" in line for line in lines)
