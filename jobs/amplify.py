"""Repeat a text log with new trace ids."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from traceloom.sources import text  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--log", required=True, help="text log, one trace per line")
    parser.add_argument("--out", required=True, help="folder to write the larger log to")
    parser.add_argument("--copies", type=int, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("amplify").getOrCreate()
    traces = text.read_traces(spark, args.log, line_order=True)
    copies = text.replicate_log(traces, args.copies, text.LINE_ORDER)
    print("traces read:", traces.count())
    text.write_traces(copies, args.out)
    print("traces written:", spark.read.text(args.out).count())


if __name__ == "__main__":
    main()
