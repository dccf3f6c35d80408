"""Text log to directly-follows graph."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from traceloom.operators.compaction import dfg_of_traces  # noqa: E402
from traceloom.sources import text  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--log", required=True, help="text log, one trace per line")
    parser.add_argument("--out", required=True, help="folder to write the graph to")
    parser.add_argument("--format", choices=["text", "parquet"], default="text", help="form of the graph")
    parser.add_argument("--partitions", type=int, help="read the log with at least this many partitions")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("dfg").getOrCreate()
    graph = dfg_of_traces(text.read_traces(spark, args.log, args.partitions))
    if args.format == "text":
        text.write_dfg(graph, args.out)
    else:
        graph.write.parquet(args.out)


if __name__ == "__main__":
    main()
