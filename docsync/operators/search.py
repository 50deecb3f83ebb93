"""Boolean and ranked search over postings.

Queries are short lists of terms on the driver. Their terms become a filter on the postings, which
reaches the Parquet scan when the postings are stored, and only what is left is grouped.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from docsync.schema import CLAUSES, Clause, check_clauses
from docsync.session import MAX_CONFIG_ROWS, config_frame

# Scores are rounded before they are compared, so that ties are ties on every run.
SCORE_DIGITS = 6


def term_query(docs: DataFrame, field: str, value: object) -> DataFrame:
    """Documents whose stored field equals the value: a filter the scan can use."""
    return docs.filter(F.col(field) == F.lit(value))


def _of_clauses(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """Rows of (field, term, ...) that a clause may ask for."""
    return df.filter(
        F.col("field").isin(sorted({c.field for c in clauses}))
        & F.col("term").isin(sorted({c.term for c in clauses}))
    )


def _matches(postings: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """One row per document and matched clause."""
    rows = config_frame(postings.sparkSession, check_clauses(clauses), CLAUSES)
    return _of_clauses(postings, clauses).join(rows, ["field", "term"])


def _occurs(kind: str) -> Column:
    return F.count_if(F.col("occur") == kind)


def _satisfied(clauses: Sequence[Clause]) -> Column:
    """Every must clause matches; with none, at least one should clause does."""
    n_must = sum(c.occur == "must" for c in clauses)
    return F.col("n_must") == n_must if n_must else F.col("n_should") > 0


def bool_query(postings: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """``(doc_key, n_must, n_should)`` of the documents that satisfy the clauses. An empty clause
    list matches nothing."""
    return (
        _matches(postings, clauses)
        .groupBy("doc_key")
        .agg(_occurs("must").alias("n_must"), _occurs("should").alias("n_should"))
        .filter(_satisfied(clauses) if clauses else F.lit(False))
    )


def word_clauses(
    words: Sequence[str], fields: Sequence[str], boosts: dict[str, float] | None = None
) -> list[Clause]:
    """A should clause for every field and word."""
    boosts = boosts or {}
    return [
        Clause(f"{field}:{word}", field, word, "should", boosts.get(field, 1.0))
        for field in fields
        for word in dict.fromkeys(words)
    ]


def query_words(text: str) -> list[str]:
    """Words of a user's query text, split as the tokeniser splits documents."""
    # What is left of \w without the underscore: letters and digits of any script.
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", text.lower()) if w))


def field_terms(
    words: str | Sequence[str], analyzers: Mapping[str, str], stop_words: Sequence[str] = ()
) -> dict[str, list[str]]:
    """The terms a query asks each field for: its words as that field's analyzer makes them. A
    ``keyword`` field is asked for the text (or each given word) as a whole."""
    whole = [words.strip()] if isinstance(words, str) else list(words)
    split = query_words(" ".join(whole))
    made = {
        "keyword": [w for w in dict.fromkeys(whole) if w],
        "standard": split,
        "standard_stop": [w for w in split if w not in set(stop_words)],
    }
    return {field: made[analyzer] for field, analyzer in analyzers.items()}


def _somewhere(terms: Mapping[str, Sequence[str]], operator: str) -> tuple[dict, Column]:
    """Per-field match counts, and the condition that one field has all (``and``) or any (``or``) of
    its terms. A field without terms has none."""
    if operator not in ("and", "or"):
        raise ValueError(f"operator {operator!r} is neither 'and' nor 'or'")
    counts, found = {}, F.lit(False)
    for i, (field, wanted) in enumerate(terms.items()):
        counts[f"_in_{i}"] = F.count_if(F.col("field") == field)
        least = len(set(wanted)) if operator == "and" else 1
        if wanted:
            found = found | (F.col(f"_in_{i}") >= least)
    return counts, found


def multi_field_query(
    postings: DataFrame, words: Sequence[str], fields: Sequence[str], operator: str = "and"
) -> DataFrame:
    """``(doc_key)`` of the documents in which at least one field contains all the words, or any."""
    counts, found = _somewhere({f: words for f in fields}, operator)
    if not words or not fields:
        return postings.select("doc_key").filter(F.lit(False))
    return (
        _matches(postings, word_clauses(words, fields))
        .groupBy("doc_key")
        .agg(*(c.alias(n) for n, c in counts.items()))
        .filter(found)
        .select("doc_key")
    )


def _weighed(
    postings: DataFrame, clauses: Sequence[Clause], term_stats: DataFrame, n_docs: Column | int,
    lengths: DataFrame | None,
) -> DataFrame:
    """Matches with the weight each adds to its document's score.

    sqrt(tf) * (1 + ln(N / (df + 1)))^2 * boost / sqrt(field length), the published default
    similarity without its one-byte rounding of norms.
    """
    n_docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    # At most one row per clause: (field, term) is unique here and limited to the clauses' terms.
    stats = F.broadcast(_of_clauses(term_stats, clauses).select("field", "term", "df"))
    rows = _matches(postings, clauses).join(stats, ["field", "term"])
    if lengths is not None:
        wanted = lengths.filter(F.col("field").isin(sorted({c.field for c in clauses})))
        rows = rows.drop("field_len").join(
            wanted.select("doc_key", "field", F.col("n").alias("field_len")), ["doc_key", "field"]
        )
    idf = F.lit(1.0) + F.log(n_docs / (F.col("df") + 1))
    weight = F.sqrt("tf") * F.pow(idf, 2) * F.col("boost") / F.sqrt("field_len")
    return rows.withColumn("_weight", weight)


def score(
    postings: DataFrame, clauses: Sequence[Clause], term_stats: DataFrame, n_docs: Column | int,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """``(doc_key, score)`` of the documents that satisfy the clauses.

    The sum of the matched terms' weights times matched / total clauses. ``n_docs`` is a number or
    a scalar subquery. Postings carry their field length; pass ``lengths`` where they do not.
    """
    if not clauses:
        return postings.select("doc_key", F.lit(0.0).alias("score")).filter(F.lit(False))
    return (
        _weighed(postings, clauses, term_stats, n_docs, lengths)
        .groupBy("doc_key")
        .agg(
            F.sum("_weight").alias("_sum"),
            F.count("*").alias("_matched"),
            _occurs("must").alias("n_must"),
            _occurs("should").alias("n_should"),
        )
        .filter(_satisfied(clauses))
        .select(
            "doc_key",
            F.round(F.col("_sum") * F.col("_matched") / len(clauses), SCORE_DIGITS).alias("score"),
        )
    )


def score_words(
    postings: DataFrame, words: Sequence[str], fields: Sequence[str], term_stats: DataFrame,
    n_docs: Column | int, boosts: dict[str, float] | None = None, lengths: DataFrame | None = None,
    operator: str = "and",
) -> DataFrame:
    """``(doc_key, score)`` of the documents ``multi_field_query`` finds, ranked over all their
    matched words."""
    terms = {f: words for f in fields}
    return score_terms(postings, terms, term_stats, n_docs, boosts, lengths, operator)


def score_terms(
    postings: DataFrame, terms: Mapping[str, Sequence[str]], term_stats: DataFrame,
    n_docs: Column | int, boosts: dict[str, float] | None = None, lengths: DataFrame | None = None,
    operator: str = "and",
) -> DataFrame:
    """``(doc_key, score)`` of the documents in which one field has all (or any) of its own terms,
    ranked over all their matches. Matching and ranking share one aggregation."""
    clauses = [c for f, words in terms.items() for c in word_clauses(words, [f], boosts)]
    counts, found = _somewhere(terms, operator)
    if not clauses:
        return postings.select("doc_key", F.lit(0.0).alias("score")).filter(F.lit(False))
    return (
        _weighed(postings, clauses, term_stats, n_docs, lengths)
        .groupBy("doc_key")
        .agg(
            F.sum("_weight").alias("_sum"),
            F.count("*").alias("_matched"),
            *(c.alias(n) for n, c in counts.items()),
        )
        .filter(found)
        .select(
            "doc_key",
            F.round(F.col("_sum") * F.col("_matched") / len(clauses), SCORE_DIGITS).alias("score"),
        )
    )


def top_k(scored: DataFrame, k: int | None) -> DataFrame:
    """The best ``k`` by score, ties by key; all of them, sorted, for ``k = None``."""
    ranked = scored.orderBy(F.desc("score"), "doc_key")
    return ranked if k is None else ranked.limit(k)


def total_hits(scored: DataFrame) -> DataFrame:
    """One row ``total_hits``."""
    return scored.agg(F.count("*").alias("total_hits"))


def fetch_fields(
    hits: DataFrame, docs: DataFrame, fields: Sequence[str], key: str, k: int | None = None
) -> DataFrame:
    """The hits, at most ``k`` of them, with stored fields of their documents.

    Up to ``MAX_CONFIG_ROWS`` hits are ranked by a job of their own, and their keys become a condition on
    the key column as it is stored: of a table sorted by key, only the pages that hold a hit are read.
    All hits, or more of them, are joined."""
    stored = docs.select(F.col(key).cast("string").alias("doc_key"), *fields)
    if k is not None:
        hits = hits.orderBy(F.desc("score"), "doc_key").limit(k)
    kind = docs.schema[key].dataType
    if k is None or k > MAX_CONFIG_ROWS or not isinstance(kind, (StringType, IntegralType)):
        return stored.join(hits, "doc_key")
    rows = hits.select("doc_key", "score").collect()
    keys = [F.lit(r.doc_key).cast(kind) for r in rows]
    found = docs.filter(F.col(key).isin(keys)) if keys else docs.filter(F.lit(False))
    ranked = config_frame(docs.sparkSession, [tuple(r) for r in rows], "doc_key string, score double")
    return found.select(F.col(key).cast("string").alias("doc_key"), *fields).join(ranked, "doc_key")
