"""From raw documents to packed training sequences.

Each stage takes the documents its predecessor kept, as written to Parquet, and
returns documents of the same columns; the last returns packed pieces. Missing
texts pass every filter and are packed as empty ones. Columns beyond `doc_id`,
`text` and `n_chars` pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.decontamination import leaks
from traceloom.llm.line_windows import drop_repeated_windows
from traceloom.llm.minhash import near_duplicates, text_hash
from traceloom.llm.packing import pack_documents, public_bpe
from traceloom.llm.toxicity import fit, held_out, score
from traceloom.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return docs.where(score(model) < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without three-line windows that also occur earlier."""
    cut = drop_repeated_windows(docs)
    columns = {c: F.col(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*columns.values())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    return docs.join(gone, (docs["doc_id"] == gone["d"]) & (text_hash() == gone["h"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("d")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["d"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(docs, public_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the search and the packing are no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
