"""The index as a set of tables, and the complete user query over it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.operators import index as ix
from docsync.operators import search as se
from docsync.operators.access import visible_to
from docsync.schema import FieldSpec
from docsync.session import cut_lineage


class TextIndex(NamedTuple):
    """Documents, their postings, the statistics ranking needs, and how the fields were analysed."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    key: str
    specs: Sequence[FieldSpec] = ()
    stop_words: Sequence[str] = ()
    count: int | None = None

    @property
    def n_docs(self) -> Column | int:
        """Document count: the stored number, or a scalar subquery for use inside an expression."""
        return ix.document_count(self.docs).scalar() if self.count is None else self.count

    def terms(self, words: str | Sequence[str], fields: Sequence[str]) -> dict[str, list[str]]:
        """Terms to look for in each field, analysed as the field was; ``standard`` where the index
        does not say."""
        known = {s.field: s.analyzer for s in self.specs}
        return se.field_terms(words, {f: known.get(f, "standard") for f in fields}, self.stop_words)

    def boosts(self) -> dict[str, float]:
        return {s.field: s.boost for s in self.specs}

    def keyword(self, field: str) -> bool:
        """Whether the postings have the whole values of the field as terms."""
        return any(s.field == field and s.analyzer == "keyword" for s in self.specs)


def build_index(
    docs: DataFrame, specs: Sequence[FieldSpec], key: str, with_positions: bool = True,
    stop_words: Sequence[str] = (),
) -> TextIndex:
    """The index over a document table, not yet written. Give ``active`` and ``roles`` as keyword
    fields, and a search filters by them without reading the documents."""
    analysed = ix.analyze_fields(docs, specs, key, stop_words)
    postings = ix.build_postings(analysed, with_positions)
    return TextIndex(docs, postings, ix.term_stats(postings), key, tuple(specs), tuple(stop_words))


def index_for_words(
    docs: DataFrame, specs: Sequence[FieldSpec], key: str, words: str | Sequence[str],
    stop_words: Sequence[str] = (),
) -> TextIndex:
    """The part of the index one query needs, for document tables without a stored index.

    The documents are analysed once; the postings of the words are written to the shared folder, as
    both the statistics and the ranking read them.
    """
    index = TextIndex(docs, docs, docs, key, tuple(specs), tuple(stop_words))
    terms = {t for wanted in index.terms(words, [s.field for s in specs]).values() for t in wanted}
    analysed = ix.analyze_fields(docs, specs, key, stop_words)
    postings = cut_lineage(ix.postings_of_terms(analysed, sorted(terms)), "postings")
    # These postings hold the query's terms only, so other fields cannot be filtered by them.
    return index._replace(postings=postings, term_stats=ix.term_stats(postings))


def write_index(index: TextIndex, folder: str) -> None:
    """Write postings, statistics and the index's own description. Postings and statistics are sorted
    by (field, term) inside their files, so that a query reads only the row groups of its terms.

    The one shuffle of the postings is a rebalance: terms stay together while they are small, and
    the postings of a very frequent term are split over several tasks and files. Write to a new
    folder per snapshot version and publish that version afterwards."""
    spark, by_term = index.postings.sparkSession, ["field", "term"]
    (
        index.postings.hint("rebalance", *by_term)
        .sortWithinPartitions(*by_term, "doc_key")
        .write.parquet(f"{folder}/postings")
    )
    stored = spark.read.parquet(f"{folder}/postings")
    ix.term_stats(stored).sortWithinPartitions(*by_term).write.parquet(f"{folder}/term_stats")
    fields = [{"field": s.field, "analyzer": s.analyzer, "boost": s.boost} for s in index.specs]
    about = ix.document_count(index.docs).select(
        "n_docs", F.lit(json.dumps(fields)).alias("fields"), F.lit(json.dumps(list(index.stop_words))).alias("stop_words"))
    about.coalesce(1).write.json(f"{folder}/about")


def read_index(spark: SparkSession, folder: str, docs: DataFrame, key: str) -> TextIndex:
    """The index written to ``folder`` for the document table ``docs``, analysed as it was built."""
    about = spark.read.schema("n_docs bigint, fields string, stop_words string").json(f"{folder}/about").first()
    specs = [
        FieldSpec("", f["field"], "job", analyzer=f["analyzer"], boost=f["boost"]) for f in json.loads(about.fields)
    ]
    return TextIndex(
        docs,
        spark.read.parquet(f"{folder}/postings"),
        spark.read.parquet(f"{folder}/term_stats"),
        key, tuple(specs), tuple(json.loads(about.stop_words)), about.n_docs,
    )


def _keys_with(postings: DataFrame, field: str, values: DataFrame | Sequence[str]) -> DataFrame:
    """Keys of the documents that have one of the values in a keyword field."""
    found = postings.filter(F.col("field") == field)
    if isinstance(values, DataFrame):
        found = found.join(values.select(F.col("role").alias("term")), "term", "left_semi")
    else:
        found = found.filter(F.col("term").isin([str(v) for v in values]))
    return found.select("doc_key")


def search(
    index: TextIndex, words: str | Sequence[str], fields: Sequence[str], show: Sequence[str],
    roles: Sequence[str] | DataFrame | None = None, active: int | None = 1,
    boosts: dict[str, float] | None = None, k: int | None = 20, operator: str = "and",
    stored: bool | None = None,
) -> DataFrame:
    """The whole user query: active documents the caller may see, in which one field has all the
    words (``operator="or"``: any of them), best first, with stored fields.

    The words are analysed for each field as the field was. One aggregation over the postings of
    their terms; where the index has ``active`` and ``roles`` as keyword fields (``stored``: say so, or
    let the index's description decide for one that was read), they are postings too, and only the
    hits that are shown are read from the documents. Boosts are those of the fields, or as given.
    """
    terms = index.terms(words, fields)
    scored = se.score_terms(
        index.postings, terms, index.term_stats, index.n_docs,
        index.boosts() if boosts is None else boosts, operator=operator,
    )
    stored = index.count is not None if stored is None else stored
    allowed = None
    if active is not None:
        if stored and index.keyword("active"):
            scored = scored.join(_keys_with(index.postings, "active", [active]), "doc_key", "left_semi")
        else:
            allowed = se.term_query(index.docs, "active", active)
    if roles is not None:
        if stored and index.keyword("roles"):
            scored = scored.join(_keys_with(index.postings, "roles", roles), "doc_key", "left_semi")
        else:
            allowed = visible_to(index.docs if allowed is None else allowed, roles, index.key)
    if allowed is not None:
        scored = scored.join(allowed.select(F.col(index.key).cast("string").alias("doc_key")), "doc_key", "left_semi")
    hits = se.top_k(scored, k)
    found = se.fetch_fields(hits, index.docs, show, index.key, k)
    return found.orderBy(F.desc("score"), "doc_key")
