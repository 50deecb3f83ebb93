"""Keyed upserts and deletes on the document table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_identity(
    docs: DataFrame, keys: Sequence[str], version: str, tiebreak: str | None = None
) -> DataFrame:
    """The last version of each identity in one batch. Of equal versions the higher ``tiebreak``
    counts; without one, the higher hash of the whole row, so that every run keeps the same row.

    Spark limits every map task to one row per key before the shuffle (WindowGroupLimit), so a key
    that holds a large share of the batch arrives as one row per task.
    """
    tie = F.col(tiebreak) if tiebreak else F.xxhash64(*docs.columns)
    last_first = Window.partitionBy(*keys).orderBy(F.desc(version), tie.desc())
    return (
        docs.withColumn("_rank", F.row_number().over(last_first))
        .filter("_rank = 1")
        .drop("_rank")
    )


def delete_docs(docs: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents whose identity does not occur in ``keys_df``; unknown identities are a no-op.

    Only the key columns of ``keys_df`` move. When they are small they are broadcast and the
    documents stay where they are.
    """
    return docs.join(keys_df.select(*keys), list(keys), "left_anti")


def exists_docs(candidates: DataFrame, docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose identity is already indexed."""
    return candidates.join(docs.select(*keys), list(keys), "left_semi")


def upsert_docs(docs: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete everything that shares an identity with ``incoming``, then add ``incoming``.

    ``incoming`` holds one row per identity; see ``latest_per_identity``.
    """
    return delete_docs(docs, incoming, keys).unionByName(incoming, allowMissingColumns=True)


def apply_changes(
    docs: DataFrame, changes: DataFrame, mapped: DataFrame, keys: Sequence[str],
    version: str = "version_ticks", tiebreak: str | None = None,
) -> DataFrame:
    """The next document table.

    ``changes`` has the identity and an ``action``; ``mapped`` has the documents extracted for the
    created and changed ones. Deleted documents leave, mapped documents replace or join, all others
    stay. A created or changed item without a mapped document (its mapping failed) leaves the table
    as it was. Both kinds of leaving are one anti-join over the documents. Of documents with one
    identity the last by ``version`` counts (ties: see ``latest_per_identity``).
    """
    keys = list(keys)
    work = changes.filter(F.col("action").isin("created", "changed"))
    incoming = latest_per_identity(exists_docs(mapped, work, keys), keys, version, tiebreak)
    leaving = changes.filter(F.col("action") == "deleted").select(*keys)
    return delete_docs(docs, leaving.unionByName(incoming.select(*keys)), keys).unionByName(
        incoming, allowMissingColumns=True
    )
