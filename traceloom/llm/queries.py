"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from traceloom.llm.decontamination import leaks
from traceloom.llm.hard_negatives import hard_negatives
from traceloom.llm.host_rules import judge
from traceloom.llm.licenses import scan
from traceloom.llm.line_windows import drop_repeated_windows
from traceloom.llm.minhash import near_duplicates
from traceloom.llm.packing import pack_documents, public_bpe
from traceloom.llm.personal_data import personal_data
from traceloom.llm.spelling import spelling_variants
from traceloom.llm.substrings import drop_repeated
from traceloom.llm.toxicity import classify
from traceloom.llm.url_filter import filter_urls, labelled_urls
from traceloom.llm.warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), size=4, threshold=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_bpe())


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), labelled_urls(spark))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_host_rules": op3_host_rules,
    "op4_decontamination": op4_decontamination,
    "op5_line_windows": op5_line_windows,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_substrings": op8_substrings,
    "op9_licenses": op9_licenses,
    "op10_url_filter": op10_url_filter,
    "op11_personal_data": op11_personal_data,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
