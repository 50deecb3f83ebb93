"""Text index: analysed fields, postings, statistics.

A document is one row, so its terms are counted inside that row. Nothing is shuffled before the
postings are written, and a frequent term is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions.text import tokenize as tokenize_text
from docsync.operators.lists import build_lists
from docsync.schema import FieldSpec


def tokenize(
    docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = ()
) -> DataFrame:
    """``(key, pos, term)``: every term of a text column, in order."""
    return docs.select(key, F.posexplode(tokenize_text(F.col(text), stop_words)).alias("pos", "term"))


def _terms(spec: FieldSpec, dtype: str, stop_words: Sequence[str]) -> Column:
    value = F.col(spec.field)
    values = value.cast("array<string>") if dtype.startswith("array") else F.array(value.cast("string"))
    values = F.filter(values, lambda v: v.isNotNull())
    if spec.analyzer == "keyword":
        return values
    stop = stop_words if spec.analyzer == "standard_stop" else ()
    if dtype.startswith("array"):
        # Positions run on through the values of a repeated field.
        return F.flatten(F.transform(values, lambda v: tokenize_text(v, stop)))
    return F.coalesce(tokenize_text(value, stop), F.array().cast("array<string>"))


def analyze_fields(
    docs: DataFrame, specs: Sequence[FieldSpec], key: str, stop_words: Sequence[str] = ()
) -> DataFrame:
    """``(doc_key, field, terms)``: one row per document and field, analysed as the spec says.

    ``keyword`` keeps the whole value as one term, ``standard`` tokenises, ``standard_stop`` also
    drops stop words. Fields without terms give no row.
    """
    types = dict(docs.dtypes)
    rows = [
        F.struct(F.lit(s.field).alias("field"), _terms(s, types[s.field], stop_words).alias("terms"))
        for s in {s.field: s for s in reversed(specs)}.values()
        if not s.is_variable and s.field in types
    ]
    return docs.select(F.col(key).cast("string").alias("doc_key"), F.inline(F.array(*rows))).filter(
        F.size("terms") > 0
    )


def explode_terms(analysed: DataFrame) -> DataFrame:
    """``(doc_key, field, pos, term)``: one row per term occurrence."""
    return analysed.select("doc_key", "field", F.posexplode("terms").alias("pos", "term"))


def build_postings(analysed: DataFrame, with_positions: bool = True, block_bits: int | None = None) -> DataFrame:
    """``postings(field, term, doc_key, tf, field_len[, positions])``.

    Sorting a document's terms puts equal ones side by side; each run of equal terms is one
    posting. ``field_len`` travels with the posting so that ranking needs no join for it.
    With ``block_bits``, for documents whose key is a number, the postings (without positions) come as
    ``operators.lists``: one row per field, term and block of documents.
    """
    if block_bits is not None:
        return build_lists(analysed, block_bits)
    occurrences = (
        F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        if with_positions
        else F.col("terms")
    )

    def term_at(i: Column) -> Column:
        entry = F.get("_sorted", i)
        return entry["term"] if with_positions else entry

    starts = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (term_at(i) != term_at(i - 1)),
    )

    def posting(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("_starts", n + 1), F.size("_sorted"))
        fields = [term_at(start).alias("term"), (end - start).cast("bigint").alias("tf")]
        if with_positions:
            fields.append(F.slice("_sorted", start + 1, end - start)["pos"].alias("positions"))
        return F.struct(*fields)

    runs = (
        analysed.select("doc_key", "field", F.sort_array(occurrences).alias("_sorted"))
        .select("*", starts.alias("_starts"))
        .select(
            "doc_key", "field", F.size("_sorted").cast("bigint").alias("field_len"),
            F.inline(F.transform("_starts", posting)),
        )
    )
    order = ["field", "term", "doc_key", "tf", "field_len"] + ["positions"] * with_positions
    return runs.select(*order)


def postings_of_terms(analysed: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The postings (without positions) of a few given terms only: counted in the row, nothing is
    sorted. For searching a table that has no stored index."""
    wanted = F.array(*map(F.lit, dict.fromkeys(terms))).cast("array<string>")
    counted = F.transform(
        wanted,
        lambda w: F.struct(
            w.alias("term"),
            F.size(F.filter("terms", lambda t: t == w)).cast("bigint").alias("tf"),
        ),
    )
    found = F.filter(counted, lambda c: c["tf"] > 0)
    return analysed.select(
        "doc_key", "field", F.size("terms").cast("bigint").alias("field_len"), F.inline(found)
    ).select("field", "term", "doc_key", "tf", "field_len")


def term_stats(postings: DataFrame) -> DataFrame:
    """``(field, term, df)``: in how many documents a term occurs; combined before the shuffle. Postings
    may be rows or lists."""
    n = F.sum("n") if "packed" in postings.columns else F.count("*")
    return postings.groupBy("field", "term").agg(n.alias("df"))


def field_lengths(analysed: DataFrame) -> DataFrame:
    """``(doc_key, field, n)``: number of terms of each field."""
    return analysed.select("doc_key", "field", F.size("terms").cast("bigint").alias("n"))


def document_count(docs: DataFrame) -> DataFrame:
    """One row, one column ``n_docs``."""
    return docs.agg(F.count("*").alias("n_docs"))
