"""Suffix-array deduplication with a sparse suffix array.

Only suffixes that start at content-selected minimisers are kept: of every 43 neighbouring runs of
8 words, the one with the smallest hash. Any passage of 50 words holds one, at the same place in
every copy. Suffixes whose 8 words no other document has match nothing and are dropped first: a bitmap
of fixed size tells tasks which are shared, and lets at most a needless one through. The others, each
with the words a passage of 50 around it may reach, are sorted by content over the whole cluster; each is compared with its neighbours from other documents, and the
match is extended to the left and to the right. Where three or more suffixes go on alike, the left
context of one farther off may match for longer: there the passages of 50 words that each minimiser
owns also get a fingerprint, and those are counted by document. A hot passage is sorted like all
others: ranges are cut by content, document and place, so no key has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import (
    WordHashes, as_bytes, bitmap_of, column, gram_hashes, held, scramble, ship_bitmap, shipped_bitmap, small_batches,
)
from docsync.session import cut_lineage

MIN_WORDS = 50
GRAM = 8
# Words in a context: the rest of a passage that begins, or ends, in the minimiser.
RIGHT, LEFT = MIN_WORDS, MIN_WORDS - GRAM
# Suffixes compared at a time.
CHUNK = 1 << 14
# Rows given out at a time.
GIVEN = 1 << 16
_SUFFIX = "hash long, right binary, left binary, key long, place int, least int, most int"
_FOUND = "hash long, print long, key long, start int, end int"


def owners(grams: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest (leftmost of equals) of each window; never falls from one to the next."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    # Long documents go in pieces, which bounds the memory of the comparison.
    starts = range(0, len(views), 1 << 16)
    places = [views[s:s + (1 << 16)].argmin(axis=1) + np.arange(s, min(s + (1 << 16), len(views))) for s in starts]
    return np.concatenate(places)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest (leftmost of equals) in every window."""
    return np.unique(owners(grams, window))


def _starts(batches: Iterator[pa.RecordBatch], min_words: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The hash of each suffix's first words, once per document."""
    hashes = WordHashes()
    for batch in batches:
        found, keys = [np.empty(0, np.uint64)], []
        for key, text in zip(column(batch, "key").to_pylist(), column(batch, "text").to_pylist()):
            words = text.split()
            if len(words) >= min_words:
                grams = gram_hashes(hashes.of(words), gram)
                found.append(np.unique(grams[minimisers(grams, min_words - gram + 1)]))
                keys.append(np.full(len(found[-1]), key, np.int64))
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(keys)], names=["id", "key"])


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int, gram: int, shared) -> Iterator[pa.RecordBatch]:
    """The suffixes of all documents that have ``min_words`` words, as far as others may share their
    start, words as 32 bits of their hash. ``least`` and ``most`` are the words before the minimiser in
    the passages that it owns."""
    hashes, known = WordHashes(), shipped_bitmap(shared)
    right, left = min_words, min_words - gram
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("hash", "right", "left", "key", "place", "least", "most")}
        for key, text in zip(column(batch, "key").to_pylist(), column(batch, "text").to_pylist()):
            words = text.split()
            if len(words) < min_words:
                continue
            own = hashes.of(words)
            grams = gram_hashes(own, gram)
            places, first, owned = np.unique(
                owners(grams, min_words - gram + 1), return_index=True, return_counts=True)
            met = held(known, grams[places])
            places, first, owned = places[met], first[met], owned[met]
            codes = np.maximum(own >> np.uint64(32), np.uint64(1)).astype(">u4")
            after, before = codes.tobytes(), codes[::-1].tobytes()
            n = len(words)
            out["hash"] += grams[places].view(np.int64).tolist()
            for p in places.tolist():
                out["right"].append(after[4 * p:4 * (p + right)])
                out["left"].append(before[4 * (n - p):4 * (n - p + left)])
            out["key"] += [key] * len(places)
            out["place"] += places.tolist()
            out["least"] += (places - first - owned + 1).tolist()
            out["most"] += (places - first).tolist()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.int32()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Contexts as rows of words; what a document does not have is 0."""
    rows = np.zeros((len(values), width), np.uint32)
    for i, v in enumerate(values.to_pylist()):
        rows[i, :len(v) // 4] = np.frombuffer(v, ">u4")
    return rows


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words at the start of each pair of contexts."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _prefixes(words: np.ndarray, side: int) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each context."""
    with np.errstate(over="ignore"):
        places = np.arange(words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(side)
        own = scramble(scramble((words.astype(np.uint64) << np.uint64(16)) + places + np.uint64(1)))
    sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(own, axis=1, out=sums[:, 1:])
    return sums


def _compare(batches: Iterator[pa.RecordBatch], min_words: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Matches of sorted suffixes with their neighbours from other documents, ``(key, start, end)``;
    and, with a hash and a fingerprint, the owned passages of which three or more suffixes have the
    part from the minimiser on. A passage that no neighbour has yet matched has an end.

    Of two suffixes alone with such a part, each is the other's neighbour. What lies beyond a chunk
    or a partition is taken to be alike, so its ends never hide a third."""
    names = ["hash", "right", "left", "key", "place", "least", "most"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def result(*parts: tuple) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.nulls(p[-1], k) if p[i] is None else pa.array(p[i], k) for p in parts])
                   for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "print", "key", "start", "end"])

    def neighbours(hashes, keys, places, right, left) -> tuple[np.ndarray, np.ndarray]:
        n = len(keys)
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        ends = np.append(np.flatnonzero(first)[1:], n)
        after = ends[np.cumsum(first) - 1]
        low, high = np.full(n, 1 << 31), np.full(n, -1)
        for partner in (begin - 1, after):
            i = np.flatnonzero((partner >= 0) & (partner < n))
            i = i[hashes[i] == hashes[partner[i]]]
            a, b = _common(left[i], left[partner[i]]), _common(right[i], right[partner[i]])
            long = a + b >= min_words
            i, a, b = i[long], a[long], b[long]
            low[i] = np.minimum(low[i], places[i] - a)
            high[i] = np.maximum(high[i], places[i] + b)
        return low, high

    def matches(table: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, keys = table["hash"].to_numpy(), table["key"].to_numpy()
        places, least, most = (table[c].to_numpy().astype(np.int64) for c in ("place", "least", "most"))
        right = _matrix(table["right"], min_words)
        left = _matrix(table["left"], min_words - gram)
        n = len(keys)
        low, high = neighbours(hashes, keys, places, right, left)
        # Words that each suffix and the next have in common, and with how many words two more agree.
        common = np.full(n + 3, min_words)
        common[2:n + 1] = np.where(hashes[1:] == hashes[:-1], _common(right[1:], right[:-1]), 0)
        pairs = np.minimum(common[1:], common[:-1])
        crowd = np.maximum(np.maximum(pairs[:n], pairs[1:n + 1]), pairs[2:n + 2])
        fewest = np.maximum(least, min_words - crowd)
        i = np.flatnonzero((fewest <= most) & (crowd >= gram))
        sizes = (most - fewest + 1)[i]
        row = np.repeat(np.arange(len(i)), sizes)
        before = fewest[i][row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        with np.errstate(over="ignore"):
            prints = scramble(_prefixes(left[i], 1)[row, before] + _prefixes(right[i], 0)[row, min_words - before])
        i = i[row]
        start = places[i] - before
        asked = (start < low[i]) | (start + min_words > high[i])
        ends = pa.array(start + min_words, pa.int32(), mask=~asked)
        found = high >= 0
        yield result((None, None, keys[found], low[found], high[found], int(found.sum())))
        for s in range(0, len(i), GIVEN):
            part = slice(s, s + GIVEN)
            yield result((hashes[i[part]], prints[part].view(np.int64), keys[i[part]], start[part], ends[part], len(i[part])))

    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch.select(names))
        size += batch.num_rows
        if size < CHUNK:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        yield from matches(table)
        # Later suffixes still need the last document's run and the suffix before it.
        keys = table["key"].to_numpy()
        last = np.flatnonzero(keys != keys[-1])
        start = last[-1] if len(last) else 0
        kept, size = table.slice(start).to_batches(), 0
    if kept:
        yield from matches(pa.Table.from_batches(kept).combine_chunks())


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                 gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_repeated, spans)`` of every whole text: the words (runs without space and
    the controls 9 to 13, from 0) that lie in a passage of at least ``min_words`` words which another
    document has too; ``spans`` are their ranges, ends exclusive, in order and apart.

    Null, empty and shorter texts repeat nothing. Rows equal in id and text are one document, which
    does not repeat itself; each of them gets its result. Null ids are told apart by text. An empty
    table gives an empty table; other columns are not read. Words are told apart by 32 bits of their
    hash at the ends of a passage, and by 64 bits of the hash of the passage's start.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    order = ["hash", "right", "key", "place"]
    starts = rows.select("key", "text").mapInArrow(lambda b: _starts(b, min_words, gram), "id long, key long")
    several = starts.groupBy("id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other")
    shared = ship_bitmap(docs.sparkSession, bitmap_of(several))
    # Written first: the bounds of the ranges are drawn from a sample, which would make all suffixes twice.
    suffixes = cut_lineage(
        rows.select("key", "text").mapInArrow(lambda b: _suffixes(b, min_words, gram, shared), _SUFFIX), "suffixes")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    array = suffixes.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = cut_lineage(array.mapInArrow(lambda b: _compare(b, min_words, gram), _FOUND), "repeats")
    # Passages still to be matched are looked for among all with their fingerprint.
    passages = found.where("hash is not null")
    several = passages.groupBy("hash", "print").agg(
        F.min("key").alias("one"), F.max("key").alias("other"), F.count("end").alias("asked"))
    several = several.where("one <> other and asked > 0").select("hash", "print")
    met = passages.where("end is not null").join(several, ["hash", "print"], "left_semi")
    spans = found.where("hash is null").unionByName(met).select("key", "start", "end").distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))
    running = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(running))
    islands = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_doc = islands.groupBy("key").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_repeated"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    sized = rows.select("doc_id", "key", F.coalesce(
        F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words"))
    return sized.join(by_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


ORACLE_SQL = r"""
with split as materialized (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents
), passages as materialized (
    select doc_id, p, md5(array_to_string(ws[p + 1:p + 50], ' ')) passage
    from (select doc_id, ws, unnest(range(0, len(ws) - 49)) p from split)
), shared as (
    select passage from passages group by passage having count(distinct doc_id) > 1
), met as (
    select doc_id, p from passages semi join shared using (passage)
), islands as (
    select doc_id, p, sum(apart) over (partition by doc_id order by p) island from (
        select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end apart from met)
), spans as (
    select doc_id, min(p) b, max(p) + 50 e from islands group by doc_id, island
), by_doc as (
    select doc_id, sum(e - b)::bigint n_repeated, string_agg(b || ':' || e, ',' order by b) spans from spans group by doc_id
)
select s.doc_id, len(s.ws)::bigint n_words, coalesce(n_repeated, 0)::bigint n_repeated, n_repeated is not null repeats,
       coalesce(spans, '') spans
from split s left join by_doc d on s.doc_id = d.doc_id
"""
