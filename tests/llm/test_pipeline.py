from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronogrid.llm import queries
from tools.check_oracle import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    result = duck.sql(queries.ORACLES[name])
    columns, expected = result.columns, result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, expected)


def test_stages_keep_columns_and_take_effect(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows + [(40, "Completely other words stand here, on their own, for once and ever.")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == make_docs([]).columns, name
        assert docs.count() <= before
    ids = [r["doc_id"] for r in docs.collect()]
    assert 1 in ids and 40 in ids and 2 not in ids and 3 not in ids and 10 not in ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in last.collect()} == set(ids)


def test_stages_on_an_empty_table(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_run_packs_what_the_stages_kept(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    per_doc = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert per_doc.where("n <> `all`").count() == 0
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 0 < per_doc.count() < documents.count()
