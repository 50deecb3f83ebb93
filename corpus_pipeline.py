"""The corpus pipeline: documents from raw to mixed, one operator per stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Between two
stages the rows are written as Parquet to the shared folder and read again, so a lost executor
costs no more than the current stage. All stages but the last return the columns of documents, and
the last has them too: a document stands there as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.llm import contamination, jaccard, mixing, quality, secret_scan
from docsync.llm.common import fold, without
from docsync.session import scratch, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among ``docs``
    outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels, lambda doc_id: fold(doc_id, 4) != 2))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark covers a twentieth go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.contaminated(docs, benchmark).where("contaminated")
    return without(docs, found.select(F.col("doc_id").alias("key_id"), F.col("copy").alias("key_hash")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are replaced by a mark."""
    return secret_scan.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]
# The stages learn models and compare sets of shingles, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage writes on its way goes once its rows are
    written; those of the last stage, which nothing has written yet, stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, "pipeline")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
