"""The registered queries: against SQL where there is some, against labels kept apart elsewhere."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsync.llm import queries
from docsync.session import cut_lineage

SF = "/root/testdata/sf0.01"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    relation = duck.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())


def test_one_query_per_operator():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.95), ("op5_quality_classifier", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id")
    right, n = found.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*")).first()
    assert n > 50 and right >= least


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op6_language_id(spark, SF).where("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert len(corpus_pipeline.STAGES) == 5
    assert before > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert corpus_pipeline.run(spark, SF).count() == sizes[4]
