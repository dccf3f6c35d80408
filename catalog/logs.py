"""Event logs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import event_log


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per user and day."""
    day = F.to_date("ts").cast("string")
    return event_log(
        _table(spark, sf_dir, "events"),
        case=F.concat(F.col("user_id").cast("string"), F.lit("@"), day),
        order=["ts", "event_id"],
        activity="event_type",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per conversation, activities are the roles."""
    return event_log(_table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per customer, one model per market segment."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    table = _table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return event_log(table, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", "c_mktsegment")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per order, activities are return flag and line status."""
    return event_log(
        _table(spark, sf_dir, "lineitem"),
        "l_orderkey",
        ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"],
        F.concat("l_returnflag", "l_linestatus"),
    )


LOGS = {
    "events_day": events_day,
    "conversations": conversations,
    "orders": orders,
    "lineitem": lineitem,
}
