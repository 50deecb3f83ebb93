"""Posting lists: the postings that a term has in a block of documents, as one row.

Postings outnumber every other row of an index, and as rows of their own they would carry field and term
each. Here terms are counted by sorting numbers, a few documents at a time, and lists are what is shuffled
and stored. Columns::

    field, term, block   block: the number of a document without its last bits
    n, best              number of postings, and place of the one that weighs most
    packed               last bits of the documents' numbers, ascending, then term counts, then field lengths:
                         one array, as three take half as much again when they are shuffled

A list may be parted over several rows of the same field, term and block. What goes to Python is in batches
of bounded size, and so many terms or postings are worked on at a time, however long a list is.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel to the executors by value: they need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTS = "field string, term string, block bigint, n int, best int, packed array<int>"
# Terms or postings worked on at a time, about 100 bytes each; bytes of a batch on its way to Python; rows
# of one on its way back.
AT_ONCE = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1 << 16


def build_lists(analysed: DataFrame, bits: int) -> DataFrame:
    """The posting lists of analysed fields whose ``doc_key`` is a number, in blocks of 2 to the ``bits``."""
    _small_batches(analysed.sparkSession)
    rows = analysed.select(F.col("doc_key").cast("bigint").alias("doc_no"), "field", "terms")
    return rows.mapInArrow(lambda batches: _at_once(batches, "terms", lambda held: _counted(held, bits)), LISTS)


def unpacked(lists: DataFrame) -> DataFrame:
    """Lists with ``ats``, ``tfs`` and ``lens`` as arrays of their own, and ``most``, the greatest weight."""
    n, best = F.col("n"), F.col("best")
    return lists.withColumns({
        "ats": F.slice("packed", F.lit(1), n), "tfs": F.slice("packed", n + 1, n), "lens": F.slice("packed", n * 2 + 1, n),
        "most": F.sqrt(F.get("packed", n + best)) / F.sqrt(F.get("packed", n * 2 + best))}).drop("best", "packed")


def postings_of(lists: DataFrame, *columns: str) -> DataFrame:
    """The columns, and ``at``, ``tf``, ``field_len`` of every posting in the lists."""
    return lists.select(*columns, F.inline(F.arrays_zip("ats", "tfs", "lens")).alias("at", "tf", "field_len"))


def renumber_lists(rows: DataFrame, bits: int, by_term: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lists of documents with other numbers, in order of field, term and block. ``rows`` are lists with
    ``nos``, the new numbers or null for documents to go. Lists of a term that a task meets are joined
    before ``by_term`` brings terms together, sorted by field and term."""
    _small_batches(rows.sparkSession)
    kind = rows.schema["nos"].dataType.elementType.simpleString()
    joined = rows.select("field", "term", "nos", "tfs", "lens").mapInArrow(
        lambda batches: _at_once(batches, "nos", lambda held: _renumbered(held, None)),
        f"field string, term string, nos array<{kind}>, tfs array<int>, lens array<int>")
    return by_term(joined).mapInArrow(
        lambda batches: _at_once(batches, "nos", lambda held: _renumbered(held, bits)), LISTS)


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _at_once(
    batches: Iterator[pa.RecordBatch], column: str, made: Callable[[pa.Table], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """What ``made`` gives for ``AT_ONCE`` elements of a list column at a time, or a batch more."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        found = made(pa.Table.from_batches(held).combine_chunks())
        for start in range(0, found.num_rows, BATCH_ROWS):
            yield found.slice(start, BATCH_ROWS)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column(column))).as_py() or 0
        if size >= AT_ONCE:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()
    # A worker lives on beside those of later tasks.
    held.clear()
    pa.default_memory_pool().release_unused()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin; there is at least one row."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _by_group_and_place(group: np.ndarray, groups: int, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Both, sorted by group and place: as one number where that is large enough."""
    if groups * places < 1 << 62:
        both = group * places + place
        both.sort()
        return both // places, both % places
    order = np.lexsort((place, group))
    return group[order], place[order]


def _list_array(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _in_lists(
    fields: pa.Array, field: np.ndarray, terms: pa.Array, term: np.ndarray, doc_no: np.ndarray, tf: np.ndarray, length: np.ndarray, bits: int,
) -> pa.RecordBatch:
    """Lists of postings that are sorted by field, term and number, or by field, block, term and number."""
    block = doc_no >> bits
    first = _starts(field, term, block)
    counts = np.diff(np.append(first, len(doc_no)))
    weight = np.sqrt(tf) / np.sqrt(length)
    most = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, first), counts)) if len(first) else first
    best = most[np.searchsorted(most, first)] - first if len(first) else first
    # The three parts of a list, one behind the other.
    at, size = np.arange(len(doc_no)) + 2 * np.repeat(first, counts), np.repeat(counts, counts)
    packed = np.empty(3 * len(doc_no), np.int32)
    packed[at], packed[at + size], packed[at + 2 * size] = doc_no & ((1 << bits) - 1), tf, length
    return pa.RecordBatch.from_arrays(
        [fields.take(pa.array(field[first])), terms.take(pa.array(term[first])), pa.array(block[first]), pa.array(counts.astype(np.int32)),
         pa.array(best.astype(np.int32)), _list_array(packed, 3 * first)], ["field", "term", "block", "n", "best", "packed"])


def _counted(held: pa.Table, bits: int) -> pa.RecordBatch:
    """The lists of analysed fields: equal terms of a document, sorted side by side, are one posting."""
    order = np.argsort(doc_no := _column(held, "doc_no").to_numpy(), kind="stable")
    field = _column(held, "field").dictionary_encode()
    lists = _column(held, "terms")
    length = pc.list_value_length(lists).to_numpy()
    words = lists.flatten().dictionary_encode()
    # A row is a field of a document; rows count in order of their documents' numbers.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    blocks, in_block = np.unique(doc_no >> bits, return_inverse=True)
    group = field.indices.to_numpy().astype(np.int64) * len(blocks) + in_block
    n_words = max(1, len(words.dictionary))
    group, place = _by_group_and_place(
        np.repeat(group, length) * n_words + words.indices.to_numpy(), len(field.dictionary) * len(blocks) * n_words,
        np.repeat(place, length), len(order))
    first = _starts(group, place)
    tf = np.diff(np.append(first, len(group)))
    group, row = group[first], order[place[first]]
    return _in_lists(
        field.dictionary, field.indices.to_numpy()[row], words.dictionary, group % n_words, doc_no[row], tf, length[row], bits)


def _renumbered(held: pa.Table, bits: int | None) -> pa.RecordBatch:
    """Lists joined by field and term, without documents that go; cut into blocks where ``bits`` are given."""
    lists = _column(held, "nos")
    nos, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(lists)), n)
    tf, length = _column(held, "tfs").flatten().to_numpy(), _column(held, "lens").flatten().to_numpy()
    if nos.null_count:
        stay = pc.is_valid(nos).to_numpy(zero_copy_only=False)
        nos, row, tf, length = nos.drop_null(), row[stay], tf[stay], length[stay]
    nos = nos.to_numpy()
    fields, terms = _column(held, "field").dictionary_encode(), _column(held, "term").dictionary_encode()
    # Codes in order of the words, as rows come in order of field and term.
    field, fields = _in_order(fields)
    term, terms = _in_order(terms)
    key = (field.astype(np.int64) * max(1, len(terms)) + term)[row]
    order = np.lexsort((nos, key))
    row, nos, tf, length = row[order], nos[order], tf[order], length[order]
    if bits is not None:
        return _in_lists(fields, field[row], terms, term[row], nos.astype(np.int64), tf, length, bits)
    first = _starts(key[order])
    return pa.RecordBatch.from_arrays(
        [fields.take(pa.array(field[row[first]])), terms.take(pa.array(term[row[first]])), _list_array(nos, first),
         _list_array(tf, first), _list_array(length, first)], ["field", "term", "nos", "tfs", "lens"])


def _in_order(encoded: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array]:
    """Codes and their words, with the words in order."""
    order = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[encoded.indices.to_numpy()], encoded.dictionary.take(order)
