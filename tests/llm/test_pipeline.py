"""The stages in order over a small table, and the registered queries against SQL."""

import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from retailmart.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = queries.stored(stage(spark, docs, SF_DIR), name)
        assert after.columns == corpus_pipeline.COLUMNS and 0 < after.count() <= docs.count()
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_rows_without_an_id_have_their_own_verdict(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    bare = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    for _, stage in corpus_pipeline.STAGES[:2]:
        with_id, without = ({(r["text"], r["lang"]) for r in stage(spark, d, SF_DIR).collect()} for d in (docs, bare))
        assert len(with_id) > 100 and len(with_id ^ without) <= 0.04 * len(with_id)
    sampled = corpus_pipeline.mix_sources(spark, bare, SF_DIR).count()
    assert 0.6 * docs.count() < sampled < docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    frame = queries.queries()[name](spark, SF_DIR)
    assert spark_rows(frame) == duck_rows(connect(SF_DIR), queries.oracle_sql()[name])
