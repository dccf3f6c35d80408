"""Run the headline queries and print one JSON line.

Every figure is the median of `RUNS` runs. `calibration` is a fixed piece of work
without any code of this repository: it tells a busy machine from slower code.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    runs of each query (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalog.logs import LOGS  # noqa: E402
from catalog.params import PARAMS  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402
from traceloom import discover, log_from_traces  # noqa: E402
from traceloom.operators import ordering  # noqa: E402
from traceloom.session import materialize  # noqa: E402
from traceloom.sources import text  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "dfg",
    "dfg_lineitem",
    "candidates_all",
    "trace_level_check",
    "prefix_level_check",
    "trace_level_check_events",
    "prefix_level_check_events",
    "discover_0f",
    "discover_1f",
    "discover_2f",
    "discover_segments",
    "reduced_gateways",
    "precise_labels",
    "hybrid_model",
]


def discover_amplified(spark: SparkSession, traces, compress: bool):
    """Discovery on the line item log repeated ten times."""
    log = log_from_traces(text.replicate_log(traces, 10), compress=compress)
    return discover(log, **PARAMS["lineitem"]["0f"]).kept


def calibration(spark: SparkSession):
    """Hashing, a shuffle and an aggregate of made-up numbers."""
    return spark.range(20_000_000).groupBy((F.xxhash64("id") % 100_000).alias("k")).agg(F.sum("id"))


def once(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed(run) -> float:
    return round(statistics.median(once(run) for _ in range(RUNS)), 3)


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(shared)


def run(shared: str) -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", shared))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Class loading and code generation are not part of any query.
    once(lambda: QUERIES["dfg_lineitem"](spark, SF_DIR))
    seconds = {name: timed(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    traces = materialize(ordering.traces(LOGS["lineitem"](spark, SF_DIR)), "traces")
    for name, compress in [("discover_x10_variants", True), ("discover_x10_traces", False)]:
        seconds[name] = timed(lambda compress=compress: discover_amplified(spark, traces, compress))
    work = timed(lambda: calibration(spark))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "calibration": work,
                "runs": RUNS,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
