"""Content rows: text of repeated elements, assembled fragments, shared strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import markup
from docsync.functions.text import trim_white_space
from docsync.session import parted

# Fragments put together in the first step; a document of any length is split into such runs.
RUN_LENGTH = 1024


def node_texts(pages: DataFrame, tag: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, pos, text)``: the cleaned text of every ``tag`` element, one row each."""
    texts = markup.element_texts(F.col(html), tag)
    return pages.select(key, F.posexplode(texts).alias("pos", "text"))


def assemble_text(fragments: DataFrame, sep: str = " ", key: str = "doc_key") -> DataFrame:
    """``(key, content)``: the fragments (key, pos, text) of each document in order, joined and
    trimmed. Fragments without text (extraction failed) are skipped; a document that has none left
    gives no row.

    Runs of positions are joined first, so the fragments of one very long document are sorted in
    many tasks; the second step only joins a few finished runs per document.
    """
    run = F.floor(F.col("pos") / RUN_LENGTH).alias("_run")

    def in_order(position: str, text: str):
        rows = F.array_sort(F.collect_list(F.struct(position, text)))
        return F.array_join(F.transform(rows, lambda r: r[text]), sep)

    runs = (
        fragments.filter(F.col("text").isNotNull())
        .groupBy(key, run)
        .agg(in_order("pos", "text").alias("_text"))
    )
    return runs.groupBy(key).agg(trim_white_space(in_order("_run", "_text")).alias("content"))


def resolve_shared_strings(
    cells: DataFrame, shared_strings: DataFrame, once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(cells, errors)``. A cell marked shared holds an index into its workbook's string table;
    the others hold their own text. Cells without a value are skipped, text is trimmed, an index
    that resolves to nothing gives an error row and no cell.

    Both sides meet on (workbook, index): a workbook's dictionary is spread over all tasks, and
    literal cells have no index to be matched on, so they pass without taking part in the join's
    skew. With ``once`` the join is done one time for both results, which are written and read back.
    """
    with_value = cells.filter(F.col("raw").isNotNull())
    literal = with_value.filter(~F.col("is_shared")).select(
        "workbook_id", "pos", F.col("raw").alias("_text")
    )
    index = F.col("raw").try_cast("bigint")
    strings = shared_strings.select(
        "workbook_id", F.col("idx").cast("bigint").alias("_idx"), F.col("text").alias("_string")
    )
    shared = (
        with_value.filter("is_shared")
        .select("workbook_id", "pos", "raw", index.alias("_idx"))
        .join(strings, ["workbook_id", "_idx"], "left")
    )
    lost = F.col("_string").isNull()
    found, missing = parted(shared, lost, "shared_strings") if once else (shared.filter(~lost), shared.filter(lost))
    text = literal.union(found.select("workbook_id", "pos", "_string"))
    errors = missing.select(
        "workbook_id", "pos", F.concat(F.lit("no shared string "), F.col("raw")).alias("message")
    )
    return text.select("workbook_id", "pos", trim_white_space(F.col("_text")).alias("text")), errors
