"""Durable intermediate tables.

Everything that is reused, or that must not be recomputed differently after an
executor is lost, is written as Parquet below the shared checkpoint folder and
read back. Reading it back also gives Catalyst the true size of the table, so
whether a join side is broadcast is decided by Spark's own size threshold.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Most bytes we ask Spark to broadcast by hint: counted rows times their width.
BROADCAST_BYTES = 20_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (`spark.checkpoint.dir`).

    A folder of our own is chosen only on a local master, where every task can
    read the driver's disk; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="traceloom-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and go on from the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small table whose rows cost much work each.

    A table that already has enough partitions is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
