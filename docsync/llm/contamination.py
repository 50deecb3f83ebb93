"""Benchmark decontamination: a prefix-filtered set join that ends in exact comparison.

A window (13 item words, or a whole shorter item) is a set of shingles, and it occurs in a document
only if all of them do. The prefix that such a containment needs is one shingle, so every window is
searched by its rarest one: shingles of the benchmark are counted over all documents, and each
window picks the one that is least frequent. Documents meet these prefix shingles in an ordinary
join; the words around a meeting must leave room for a window (length and positional bounds) and are
then compared word by word.

Before anything is shuffled, a bitmap of fixed size drops document shingles that are no prefix
shingle. It lets some through that are none, never the reverse, so its size bounds memory and not
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import (
    WordHashes, as_bytes, checked_broadcast, column, gram_hashes, releasing, small_batches, text_hash,
)
from docsync.session import cut_lineage

WINDOW = 13
SHINGLE = 4
BITS = 26
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
_LOWER = bytes.maketrans(
    bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII, of a UTF-8 text."""
    return text.translate(_LOWER).split()


def _item_rows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """A row per shingle of an item: its hash, place, and the item words a window may reach."""
    hashes = WordHashes()
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("item", "copy", "place", "words", "size", "token", "near", "before")}
        for i, text in enumerate(column(batch, "text").to_pylist()):
            words = words_of(text)
            if not words:
                continue
            size = min(shingle, len(words))
            tokens = gram_hashes(hashes.of(words), size).astype(np.int64).tolist()
            for place, token in enumerate(tokens):
                first = max(0, place + size - window)
                out["item"].append(i)
                out["copy"].append(xxhash.xxh3_64_intdigest(text) >> 1)
                out["place"].append(place)
                out["words"].append(len(words))
                out["size"].append(size)
                out["token"].append(token)
                out["near"].append(b" ".join(words[first:place + window]))
                out["before"].append(place - first)
        item = column(batch, "item_id").take(pa.array(out.pop("item"), pa.int64()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [item, *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["item_id", *out],
        )


def _probes(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return tokens & mask, (tokens >> np.uint64(bits)) & mask


def _bitmap(tokens: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of all tokens, by two probes each, set by Spark in words of 32 bits: at most 2**21 of
    them reach the driver, whatever the size of the benchmark."""
    mask = (1 << bits) - 1
    probes = F.array(F.expr(f"token & {mask}L"), F.expr(f"shiftrightunsigned(token, {bits}) & {mask}L"))
    words = (
        tokens.select(F.explode(probes).alias("bit"))
        .groupBy(F.shiftright("bit", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("set"))
    )
    table = words.toArrow()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[table["word"].to_numpy()] = table["set"].to_numpy().astype(np.uint32)
    return bitmap


def _marked(tokens: np.ndarray, bitmap: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of the tokens that the bitmap may hold."""
    found = np.arange(len(tokens))
    for probe in range(2):
        bit = _probes(tokens[found], bits)[probe]
        held = (bitmap[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1
        found = found[held.astype(bool)]
    return found


def _sizes(items: DataFrame, shingle: int) -> list[int]:
    """Shingle sizes that occur: the full one, and those of items shorter than it."""
    return sorted(r.size for r in items.select("size").distinct().limit(shingle).collect())


def _frequencies(texts: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """How often benchmark shingles occur in the documents, counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), bitmap.value
        for batch in batches:
            met = [np.empty(0, np.uint64)]
            for text in column(batch, "text").to_pylist():
                own = hashes.of(words_of(text))
                for size in sizes:
                    tokens = gram_hashes(own, size)
                    met.append(tokens[_marked(tokens, bits)])
            tokens, counts = np.unique(np.concatenate(met), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], names=["token", "n"])

    return texts.mapInArrow(lambda b: releasing(run(b)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_FOUND = "doc_id {kind}, copy long, n_words long, place int, token long, near binary, before int"


def _meetings(texts: DataFrame, bitmap, sizes: list[int], window: int) -> DataFrame:
    """A row per document (without place), and one per place where a prefix shingle may stand, with
    the words that a window around it may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), bitmap.value
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                words = words_of(text)
                out.append((i, len(words), None, None, None, None))
                own = hashes.of(words)
                for size in sizes:
                    tokens = gram_hashes(own, size)
                    for place in _marked(tokens, bits).tolist():
                        first = max(0, place + size - window)
                        near = b" ".join(words[first:place + window])
                        out.append((i, len(words), place, int(tokens[place].astype(np.int64)), near, place - first))
            rows, *rest = zip(*out) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(taken), column(batch, "copy").take(taken),
                 *(pa.array(v, k) for v, k in zip(rest, kinds))],
                names=["doc_id", "copy", "n_words", "place", "token", "near", "before"],
            )

    return texts.mapInArrow(lambda b: releasing(run(b)), _FOUND.format(kind=texts.schema["doc_id"].dataType.simpleString()))


def _verify(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Extends equality of words from a meeting to both sides; keeps runs that hold a window."""
    names = ["place", "near", "before", "item_near", "item_before", "item_words"]
    for batch in batches:
        rows, starts, ends = [], [], []
        for i, row in enumerate(zip(*(column(batch, n).to_pylist() for n in names))):
            place, near, before, item_near, item_before, item_words = row
            near, item_near = near.split(), item_near.split()
            a, b = before, item_before
            left = 0
            while left < min(a, b) and near[a - left - 1] == item_near[b - left - 1]:
                left += 1
            right = 0
            while a + right < len(near) and b + right < len(item_near) and near[a + right] == item_near[b + right]:
                right += 1
            if left + right >= min(window, item_words):
                rows.append(i)
                starts.append(place - left)
                ends.append(place + right)
        keep = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [column(batch, c).take(keep) for c in ("doc_id", "copy", "item_id")]
            + [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            names=["doc_id", "copy", "item_id", "start", "end"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, copy, n_words, n_hit, items, contaminated)`` of every whole document.

    ``n_hit`` counts document words inside any occurrence of a window, ``items`` lists the items with
    occurring windows as sorted strings; a document is contaminated when at least a twentieth of its
    words are hit. Null and empty texts have no words and are never contaminated; null and empty
    items have no windows. Items with a null id give hits but are not listed. Ids may be null or
    repeated: rows are told apart by id and text, and rows equal in both get the same result, each
    its own row. Either table may be empty; other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    texts = texts.withColumn("copy", text_hash(F.col("text")))
    source = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), as_bytes(F.col(f"`{item_text_col}`")).alias("text"))
    item_kind = source.schema["item_id"].dataType.simpleString()
    items = cut_lineage(source.mapInArrow(
        lambda batches: _item_rows(batches, window, shingle),
        f"item_id {item_kind}, copy long, place int, words int, size int, token long, near binary, before int",
    ).distinct(), "items")
    sizes = _sizes(items, shingle)
    ship = lambda tokens: checked_broadcast(spark, (m := _bitmap(tokens)), m.nbytes, 1 << 24)

    counts = _frequencies(texts, ship(items), sizes)
    ranked = items.join(counts, "token", "left").withColumn(
        "rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place"))
    # The rarest shingle of the window that starts at each place; an item has few places.
    item = Window.partitionBy("item_id", "copy").orderBy("place")
    rarest = F.when(F.col("words") >= window, F.min("rank").over(item.rowsBetween(0, window - shingle)))
    rarest = rarest.otherwise(F.min("rank").over(item.rowsBetween(0, Window.unboundedFollowing)))
    starts = (F.col("place") <= F.col("words") - window) | ((F.col("words") < window) & (F.col("place") == 0))
    chosen = ranked.withColumn("rarest", rarest).where(starts).select(
        "item_id", "copy", F.col("rarest.place").alias("place")).distinct()
    known = F.col("c.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("c.copy") == F.col("i.copy"))
    prefix = items.alias("i").join(chosen.alias("c"), known & (F.col("c.place") == F.col("i.place")), "left_semi")
    prefix = cut_lineage(prefix.select(
        "item_id", "token", "size", F.col("near").alias("item_near"), F.col("before").alias("item_before"),
        F.col("words").alias("item_words"), F.col("place").alias("item_place")), "prefix")

    met = cut_lineage(_meetings(texts, ship(prefix), sizes, window), "meetings")
    # Room: a full window needs that many words around the meeting, a short item all of its own.
    room = F.least("before", "item_before") + F.least(
        F.col("n_words") - F.col("place"), F.col("item_words") - F.col("item_place"))
    pairs = met.where("place is not null").join(prefix, "token").where(
        room >= F.least(F.col("item_words"), F.lit(window)))
    doc_kind = met.schema["doc_id"].dataType.simpleString()
    runs = pairs.select("doc_id", "copy", "item_id", "place", "near", "before", "item_near", "item_before", "item_words") \
        .mapInArrow(lambda batches: _verify(batches, window),
                    f"doc_id {doc_kind}, copy long, item_id {item_kind}, start int, end int")
    hits = runs.groupBy("doc_id", "copy").agg(
        F.collect_set(F.struct("start", "end")).alias("runs"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ).select(
        F.col("doc_id").alias("hit_id"), F.col("copy").alias("hit_copy"), "items",
        F.size(F.array_distinct(F.flatten(F.transform(
            "runs", lambda r: F.sequence(r["start"], r["end"] - 1))))).cast("long").alias("n_hit"),
    )
    rows = met.where("place is null").select("doc_id", "copy", "n_words").join(
        hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("copy") == F.col("hit_copy")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "copy", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE_SQL = r"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
), items as (
    select item_id, ws, least(13, len(ws)) size from (
        select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark) where len(ws) > 0
), windows as (
    select distinct item_id, size, array_to_string(ws[s:s + size - 1], ' ') words
    from (select item_id, ws, size, unnest(range(1, len(ws) - size + 2)) s from items)
), places as (
    select doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') words
    from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) p
          from docs cross join (select distinct size from items) where len(ws) >= size)
), met as (
    select doc_id, item_id, p, p.size from places p join windows w on p.words = w.words and p.size = w.size
), hit as (
    select doc_id, count(distinct word) n_hit from (select doc_id, unnest(range(p, p + size)) word from met) group by doc_id
), named as (
    select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
    from (select distinct doc_id, cast(item_id as varchar) item from met) group by doc_id
)
select d.doc_id, len(d.ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.ws) contaminated
from docs d left join hit h on d.doc_id = h.doc_id left join named n on d.doc_id = n.doc_id
"""
