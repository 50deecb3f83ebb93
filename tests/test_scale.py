"""One key holding a third of all rows: results stay whole, and the hot part is split or shrunk."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from docsync.operators import changes, content, store

N = 30_000

# Small thresholds make a test table as skewed, to Spark, as a large one at the default thresholds.
SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings(spark, values):
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in values:
            spark.conf.unset(key)


def final_plan(df):
    """The plan after AQE has run the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def numbered(spark):
    """Row ids, of which a third share one key."""
    ids = spark.range(0, N, 1, 8).withColumn("noise", F.md5(F.col("id").cast("string")))
    return ids.withColumn("key", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))


def test_hot_shared_string(spark):
    cells = numbered(spark).select(
        F.lit("w").alias("workbook_id"), F.col("id").alias("pos"), F.lit(True).alias("is_shared"),
        F.col("key").cast("string").alias("raw"))
    strings = spark.range(N).select(
        F.lit("w").alias("workbook_id"), F.col("id").alias("idx"), F.concat(F.lit("s"), "id").alias("text"))
    with settings(spark, SKEWED):
        ok, errors = content.resolve_shared_strings(cells, strings)
        assert "skew=true" in final_plan(ok)
        assert ok.count() == N and errors.count() == 0
        assert ok.filter("text = 's0'").count() == N // 3


@pytest.mark.parametrize("operator", ["deleted", "removed", "upsert"])
def test_hot_folder_or_identity(spark, operator):
    docs = numbered(spark).select(
        F.concat(F.lit("/d"), "key").alias("dir"), F.concat(F.lit("/d"), "key").alias("path"), "id", "noise")
    hot = spark.createDataFrame([("/d0", "/d0")], "dir string, path string")
    with settings(spark, SKEWED):
        if operator == "deleted":
            df, expected = changes.deleted_files(docs, hot, ["path"]), N - N // 3
        elif operator == "removed":
            df, expected = changes.removed_subtree(docs, hot.select("dir")), N // 3
        else:
            df, expected = store.delete_docs(docs, hot, ["path"]), N - N // 3
        assert "skew=true" in final_plan(df)
        assert df.count() == expected


def test_a_hot_identity_shrinks_to_one_row_per_task(spark):
    docs = numbered(spark).select("key", F.col("id").alias("version"), "noise")
    latest = store.latest_per_identity(docs, ["key"], "version", "noise")
    assert "WindowGroupLimit" in final_plan(latest)
    assert latest.count() == N - N // 3 + 1
    assert latest.filter("key = 0").first().version == N - 3


def test_copies_of_one_identity_are_combined_before_the_shuffle(spark):
    listing = numbered(spark).select(
        F.col("key").alias("path"), F.lit(1).alias("version"), F.lit(True).alias("eligible"))
    got = changes.classify_changes(listing, listing, ["path"])
    assert got.count() == N - N // 3 + 1
    assert got.filter("action <> 'unchanged'").isEmpty()


def test_one_very_long_document(spark):
    parts = numbered(spark).select(
        F.when(F.col("key") == 0, "long").otherwise(F.col("id").cast("string")).alias("doc_key"),
        F.col("id").alias("pos"), F.lit("x").alias("text"))
    got = content.assemble_text(parts)
    assert got.filter("doc_key = 'long'").first().content == " ".join("x" * (N // 3))
    assert got.count() == N - N // 3 + 1
