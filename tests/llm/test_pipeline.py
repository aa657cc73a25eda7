"""The pipeline's stages in turn, and the registered queries' contracts."""

import pytest
from compare import compare
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import quality, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, con, small, name):
    ok, message = compare(spark, con, small, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message


def test_pipeline_rows_follow_from_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = corpus_pipeline.run(spark, small)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    posterior = {r["doc_id"]: r["posterior"] for r in quality.score(docs, labels).collect()}
    assert rows and all(posterior[r["doc_id"]] >= quality.KEEP for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(r["doc_id"])
    assert all(len(ids) == 1 for ids in by_text.values())  # no exact copies under other ids
    assert max(F_count(rows).values()) <= 3


def F_count(rows):
    out = {}
    for r in rows:
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + 1
    return out


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
