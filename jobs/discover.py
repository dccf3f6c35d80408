"""Text log (and its graph, if already counted) to hybrid model."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from traceloom import hybrid_model, log_from_traces  # noqa: E402
from traceloom.operators.candidates import MAX_SET_SIZE  # noqa: E402
from traceloom.session import materialize  # noqa: E402
from traceloom.sources import text  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--log", required=True, help="text log, one trace per line")
    parser.add_argument("--dfg", help="text graph of the log; counted from the log if left out")
    parser.add_argument("--out", required=True, help="folder to write the model to")
    parser.add_argument("--format", choices=["text", "parquet"], default="text", help="form of the model")
    parser.add_argument("--partitions", type=int, help="read the log with this many partitions")
    parser.add_argument("--alpha", type=float, help="largest gap over the whole log")
    parser.add_argument("--beta", type=float, help="smallest ratio at trace level")
    parser.add_argument("--gamma", type=float, required=True, help="smallest ratio at prefix level")
    parser.add_argument("--max-set-size", type=int, default=MAX_SET_SIZE)
    parser.add_argument("--strict", action="store_true", help="strict conditions of the block rules")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("discover").getOrCreate()
    log = log_from_traces(text.read_traces(spark, args.log, args.partitions))
    graph = text.read_dfg(spark, args.dfg) if args.dfg else None
    model = hybrid_model(log, args.gamma, args.beta, args.alpha, args.max_set_size, args.strict, graph)
    if args.format == "text":
        text.write_model(materialize(model, "model"), args.out)
    else:
        model.write.parquet(args.out)


if __name__ == "__main__":
    main()
