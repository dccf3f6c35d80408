import os

import duckdb

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from traceloom.llm.oracle import ORACLE
from traceloom.llm.queries import QUERIES
from traceloom.session import materialize

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in QUERIES} and "pipeline" in QUERIES


def test_sql(spark):
    duck = duckdb.connect()
    for name in ["documents", "pages", "embeddings"]:
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name, sql in ORACLE.items():
        out = QUERIES[name](spark, SF_DIR)
        columns = sorted(out.columns)
        got = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
        assert got == sorted(duck.sql(sql).select(*columns).fetchall(), key=repr), name


def test_stages_keep_columns(spark, odd):
    docs = odd.withColumnRenamed("n_lines", "n_chars")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF_DIR), name)
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
        docs = out
        counts.append(docs.count())
    # Copies go, the rows without an id or words stay.
    assert counts[1] == counts[2] == 17 and counts[3] == counts[4] == 12


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 100 and out.where("offset + length > 2048").count() == 0
