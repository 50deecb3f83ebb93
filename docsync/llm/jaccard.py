"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments by ranges of their hashes, so that every document
is cut into segments, one per fragment.

1. Each fragment counts in how many different sets each of its n-grams occurs. An n-gram of one set
   is in no intersection: only the others go on, and what a document shares is summed over the
   fragments. A document of which too much is its own can link with nobody and is done.
2. What is left is ordered by frequency. Two sets that link share an n-gram among the few rarest of
   both, so the sets with such an n-gram in common form a group, named by its smallest member.
3. A group is cut into bands of set size, such that only neighbouring bands can link, and a band into
   blocks of bounded size, which are compared block by block. There, again, the n-grams are cut into
   fragments; partial overlaps are counted in each and summed per pair. Pairs are never written out: a
   block gives one tree of links per connected part, and a count of links per set.

Documents with equal sets are one class throughout. Which class a document is in stands in a table of its
own, which no grouped step sees; those get the sets of the classes, each once per chunk of a task that
meets it. Components come from the trees of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import (
    WordHashes, as_bytes, by_key, column, components, gram_hashes, releasing, small_batches, text_hash, without,
)
from docsync.session import cut_lineage

NGRAM = 4
# Sets link when PERCENT of their union is in both.
PERCENT = 85
# A task gathers so many n-grams and sets before it cuts them into fragments.
CHUNK_TOKENS, CHUNK_SETS = 1 << 19, 60_000
# An n-gram of so many sets in one chunk counts as frequent everywhere; its places stay in the chunk.
FREQUENT = 16
FREQUENT_COUNT = (1 << 31) - 1
# Sets, and n-grams in them, per block of a band of a group, on average.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
# Compressed bytes of texts per fragment. The names of n-grams take two bytes less with few fragments.
FRAGMENT_BYTES, FEW_FRAGMENTS = 32 << 20, 1 << 16
# More would leave a chunk with hardly an n-gram per fragment; give ``fragments`` to have more.
MOST_FRAGMENTS = 1 << 18
# N-grams of at most so many sets of a block are counted pair by pair, the others by matrices of so
# many columns.
LIGHT, COLUMNS = 6, 2048
# Rows of a block's pairs that are worked on at once in wider numbers.
STRIPE = 128
_LOW = np.uint64((1 << 48) - 1)


def shingle_set(text: bytes, hashes: WordHashes, ngram: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text in lower case (A-Z); of a shorter text, the
    hash of all its words as one; empty without words."""
    words = text.lower().split()
    if 0 < len(words) < ngram:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    return np.unique(gram_hashes(hashes.of(words), ngram))


def _fragment(tokens: np.ndarray, fragments: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _names(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """What an n-gram goes by: its hash, the top of which the fragment stands for where those are few."""
    if fragments > FEW_FRAGMENTS:
        return tokens
    return (_fragment(tokens, fragments) << np.uint64(48)) | (tokens & _LOW)


def _pack(tokens: np.ndarray, fragments: int) -> bytes:
    """Names without their fragment, where they hold it."""
    if fragments > FEW_FRAGMENTS:
        return tokens.tobytes()
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes, fragment: int, fragments: int) -> np.ndarray:
    if fragments > FEW_FRAGMENTS:
        return np.frombuffer(packed, np.uint64)
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8") | np.uint64(fragment << 48)


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values.view(np.uint64) >> np.uint64(17)) % np.uint64(parts)).astype(np.int32)


_NAMES = ["part", "kind", "a", "b", "c", "d"]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
_SCHEMA = "part int, kind int, a binary, b binary, c binary, d binary"
SIZES, POSTINGS, FREQUENT_POSTINGS = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _dealt(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part that occurs."""
    order = np.argsort(parts, kind="stable")
    found, first = np.unique(parts[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


def _cut(sets: dict[int, np.ndarray], fragments: int) -> list[tuple]:
    """The postings of a chunk of sets, cut into fragments, and the sizes of the sets, by class."""
    classes = np.fromiter(sets, np.int64, len(sets))
    sizes = [len(s) for s in sets.values()]
    tokens = np.concatenate(list(sets.values())) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, int)
    counts = np.diff(np.append(first, len(tokens)))
    frequent = np.repeat(counts >= FREQUENT, counts)
    counted = np.array(sizes, np.int32)
    rows = [(p, SIZES, classes[at].tobytes(), counted[at].tobytes(), None, None)
            for p, at in _dealt(_parts(classes, fragments))]
    limits = np.searchsorted(_fragment(tokens, fragments), np.arange(fragments + 1))
    for f in range(fragments):
        here = slice(limits[f], limits[f + 1])
        own, often = tokens[here][~frequent[here]], np.unique(tokens[here][frequent[here]])
        if len(own) or len(often):
            held, place = np.unique(owner[here][~frequent[here]], return_inverse=True)
            rows.append((f, POSTINGS, classes[held].tobytes(), _pack(own, fragments), place.astype(np.uint16).tobytes(), _pack(often, fragments)))
    if frequent.any():
        # Already known to be shared, these are only passed on: dealt out by class, as they are needed next.
        names = _names(tokens[frequent], fragments)
        owners = classes[owner[frequent]]
        rows += [(p, FREQUENT_POSTINGS, owners[at].tobytes(), names[at].tobytes(), None, None)
                 for p, at in _dealt(_parts(owners, fragments))]
    return rows


def class_of(tokens: np.ndarray) -> int:
    """Name of the class of documents with these n-grams."""
    name = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return name - ((name >> 63) << 64)


def _membership(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    """The class of each document, null without words, and the size of its set."""
    hashes = WordHashes()
    for batch in batches:
        sets = (shingle_set(text, hashes, ngram) for text in column(batch, "text").to_pylist())
        found = [(class_of(s) if len(s) else None, len(s)) for s in sets]
        classes, sizes = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "cls", "n"])


def _shingle(batches: Iterator[pa.RecordBatch], ngram: int, fragments: int) -> Iterator[pa.RecordBatch]:
    hashes, sets, size = WordHashes(), {}, 0
    for batch in batches:
        for text in column(batch, "text").to_pylist():
            tokens = shingle_set(text, hashes, ngram)
            name = class_of(tokens)
            if len(tokens) and name not in sets:
                sets[name] = tokens
                size += len(tokens)
            if size >= CHUNK_TOKENS or len(sets) >= CHUNK_SETS:
                yield _rows(_cut(sets, fragments))
                sets, size = {}, 0
    if sets:
        yield _rows(_cut(sets, fragments))


def _count_fragment(table: pa.Table, fragments: int) -> pa.Table:
    """One fragment: keeps the postings of n-grams that several sets have, with their frequency, and
    deals them out by set."""
    rows = []
    tokens, classes, often = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    sent = []
    for kind, part, a, b, c, d in zip(*(table[n].to_pylist() for n in ("kind", "part", "a", "b", "c", "d"))):
        if kind == POSTINGS:
            tokens.append(_unpack(b, part, fragments))
            classes.append(np.frombuffer(a, np.int64)[np.frombuffer(c, np.uint16)])
            often.append(_unpack(d, part, fragments))
        elif kind == SIZES:
            rows.append((part, SIZES, a, b, None, None))
        elif kind == FREQUENT_POSTINGS:
            owners = np.frombuffer(a, np.int64)
            sent.append((owners, np.frombuffer(b, np.int64), np.full(len(owners), FREQUENT_COUNT, np.int32)))
    tokens, classes = np.concatenate(tokens), np.concatenate(classes)
    order = np.lexsort((classes, tokens))
    tokens, classes = tokens[order], classes[order]
    if len(tokens):
        distinct = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])))
        tokens, classes = tokens[distinct], classes[distinct]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        lengths = np.diff(np.append(first, len(tokens)))
        counts = np.where(np.isin(tokens[first], np.concatenate(often)), FREQUENT_COUNT, lengths)
        counts = np.repeat(counts, lengths)
        kept = counts >= 2
        sent.append((classes[kept], tokens[kept].view(np.int64), counts[kept].astype(np.int32)))
    for owners, names, counts in sent:
        part = _parts(owners, fragments)
        order = np.lexsort((names, owners, part))
        owners, names, counts, part = owners[order], names[order], counts[order], part[order]
        limits = np.searchsorted(part, np.arange(fragments + 1))
        for p in np.unique(part).tolist():
            here = slice(limits[p], limits[p + 1])
            rows.append((p, POSTINGS, owners[here].tobytes(), names[here].tobytes(), counts[here].tobytes(), None))
    return pa.Table.from_batches([_rows(rows)])


def least_overlap(n, percent: int):
    """Smallest intersection with which a set of ``n`` can link."""
    return (percent * n + 99) // 100


_SETS = "cls long, n int, tokens binary, prefix array<long>"


def _gather_sets(table: pa.Table, percent: int) -> pa.Table:
    """Sums up what each set shares over its fragments; keeps the sets that can link, with their
    shared n-grams, rarest first, and their prefix."""
    size: dict[int, int] = {}
    owners, names, counts = [], [], []
    for kind, a, b, c in zip(*(table[n].to_pylist() for n in ("kind", "a", "b", "c"))):
        if kind == SIZES:
            size.update(zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int32).tolist()))
        else:
            owners.append(np.frombuffer(a, np.int64))
            names.append(np.frombuffer(b, np.int64))
            counts.append(np.frombuffer(c, np.int32))
    out = []
    if owners:
        owners, names, counts = np.concatenate(owners), np.concatenate(names), np.concatenate(counts)
        order = np.lexsort((names, counts, owners))
        owners, names = owners[order], names[order]
        distinct = np.concatenate(([True], (owners[1:] != owners[:-1]) | (names[1:] != names[:-1])))
        owners, names = owners[distinct], names[distinct]
        first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        for start, end in zip(first.tolist(), [*first[1:].tolist(), len(owners)]):
            n, shared = size[int(owners[start])], end - start
            least = least_overlap(n, percent)
            if shared >= least:
                prefix = names[start:start + shared - least + 1]
                out.append((int(owners[start]), n, names[start:end].tobytes(), prefix.tolist()))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table({name: pa.array(c, t) for name, c, t in zip(("cls", "n", "tokens", "prefix"), columns, kinds)})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block: partial overlaps per fragment of the n-grams that
    occur, summed per pair."""
    g = len(sets)
    total = np.zeros((g, g), np.float32)
    owner = np.repeat(np.arange(g, dtype=np.int32), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(first, len(tokens)))
    light = np.repeat(counts <= LIGHT, counts)
    del first, counts
    for shift in range(1, LIGHT):
        pairs = np.flatnonzero(light[shift:] & (tokens[shift:] == tokens[:-shift]))
        one, other = owner[pairs].astype(np.int64), owner[pairs + shift]
        np.add.at(total.reshape(-1), np.minimum(one, other) * g + np.maximum(one, other), np.float32(1))
    total += total.T
    heavy = np.cumsum(np.concatenate(([True], tokens[1:] != tokens[:-1]))[~light]) - 1
    owner = owner[~light]
    fragment = np.empty((g, COLUMNS if len(heavy) else 0), np.float32)
    for start in range(0, int(heavy[-1]) + 1 if len(heavy) else 0, COLUMNS):
        here = slice(*np.searchsorted(heavy, [start, start + COLUMNS]))
        fragment.fill(0)
        fragment[owner[here], heavy[here] - start] = 1
        total += fragment @ fragment.T
    return total


def _stripes(g: int) -> list[slice]:
    return [slice(start, start + STRIPE) for start in range(0, g, STRIPE)]


def _linked(inside: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a block link, by their intersections and sizes."""
    linked = np.empty(inside.shape, bool)
    for rows in _stripes(len(n)):
        both = inside[rows].astype(np.int64)
        linked[rows] = 100 * both >= percent * (n[rows, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member that each set of a block reaches by its links."""
    labels = np.arange(len(linked))
    while True:
        near = np.concatenate([np.empty(0, int), *(
            np.where(linked[rows], labels[None, :], len(linked)).min(axis=1, initial=len(linked))
            for rows in _stripes(len(linked)))])
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """One pair of blocks of a group: a tree of links for each connected part, and links per set. A
    pair that meets in several groups is counted in the one with the smallest name."""
    order = np.argsort(table["cls"].to_numpy(), kind="stable")
    # The n-grams stay where they are; only the other columns are copied.
    held = [t.as_buffer() for t in table["tokens"]]
    table = table.drop_columns(["tokens"]).take(order)
    classes, n = table["cls"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    linked = _linked(overlaps([np.frombuffer(held[i], np.int64) for i in order.tolist()]), n, percent)
    group, block = table["leader"][0].as_py(), table["block"].to_numpy()
    if table["lo"][0].as_py() != table["hi"][0].as_py():
        linked &= block[:, None] != block[None, :]
    roots = _roots(linked)
    counted = linked.copy()
    others: dict[int, list[int]] = {}
    for i, leaders in enumerate(table["leaders"].to_pylist()):
        for other in leaders:
            if other < group:
                others.setdefault(other, []).append(i)
    for met in others.values():
        counted[np.ix_(met, met)] = False
    copies = table["copies"].to_numpy().astype(float)
    links = np.concatenate([counted[rows] @ copies for rows in _stripes(len(n))])
    return pa.table({
        "cls": classes, "root": classes[roots], "links": pa.array(links.astype(np.int64), pa.int64()),
    })


def _bytes_read(docs: DataFrame) -> int:
    """Bytes of the sources that a plan reads, as far as they are known."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
         percent: int = PERCENT, fragments: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` of every whole text.

    ``component_id`` is the smallest id that links reach from the document, ``n_links`` the number of
    documents that it links with. Null, empty and wordless texts have an empty set, link with nothing
    and name themselves. Repeated rows are documents of their own, linked by equal sets. A null id is
    never the smallest; where all ids are null, so is the component. An empty table gives an empty
    table; other columns are not read. A task holds one of the ``fragments``: by default as many as there
    are shuffle partitions, and one per ``FRAGMENT_BYTES`` of what is read at least.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not fragments:
        by_bytes = min(_bytes_read(docs) // FRAGMENT_BYTES, MOST_FRAGMENTS)
        fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, by_bytes)
    cut = rows.select("text").mapInArrow(lambda b: releasing(_shingle(b, ngram, fragments)), _SCHEMA)
    counted = cut.groupBy("part").applyInArrow(lambda t: _count_fragment(t, fragments), _SCHEMA)
    gathered = counted.groupBy("part").applyInArrow(lambda t: _gather_sets(t, percent), _SETS)
    gathered = cut_lineage(gathered, "jaccard")
    members = cut_lineage(rows.mapInArrow(
        lambda b: releasing(_membership(b, ngram)), f"doc_id {kind}, cls long, n int"), "jaccard")
    classes = members.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    sets = gathered.select("cls", "n", "tokens")

    prefix = gathered.select("cls", F.explode("prefix").alias("token"))
    met = prefix.groupBy("token").agg(F.min("cls").alias("leader"), F.count("*").alias("sets")).where("sets > 1")
    # Sets that link differ in size by less than the factor of a band.
    band = F.floor(F.log(F.col("n")) / (float(np.log(100 / percent)) * 1.0001 if percent < 100 else 1e-3)).cast("long")
    groups = prefix.join(met, "token").select("cls", "leader").distinct().join(sets.select("cls", "n"), "cls")
    groups = cut_lineage(groups.withColumn("band", band), "jaccard")
    blocks = groups.groupBy("leader", "band").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    leaders = groups.groupBy("cls").agg(F.collect_set("leader").alias("leaders"))
    pairs = groups.join(blocks, ["leader", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # Each block meets the blocks of its own band and those of the bands before and after it.
    others = blocks.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1)))).select(
        "leader", "step", (F.col("band") - F.col("step")).alias("band"), F.col("blocks").alias("others"))
    pairs = pairs.join(others, ["leader", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own = F.struct("band", "block")
    other = F.struct((F.col("band") + F.col("step")).alias("band"), F.col("other").alias("block"))
    known = sets.join(leaders, "cls").join(classes.select("cls", "copies"), "cls")
    pairs = pairs.select(
        "cls", "leader", F.xxhash64("band", "block").alias("block"),
        F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")
    ).join(known, "cls")
    found = pairs.groupBy("leader", "lo", "hi").applyInArrow(
        lambda t: _compare_blocks(t, percent), "cls long, root long, links long")
    found = cut_lineage(found, "jaccard")
    parts = components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "jaccard")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(names, "component").join(links, "cls", "left").select(
        "cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(known, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of linked documents only the one with the
    smallest id (null ids last, then by text hash). Documents that link with nothing stay. Of rows
    equal in id and text, which link with each other, one stays."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    name = F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), text_hash(text).alias("hash"))
    found = cut_lineage(join(docs.select(name.alias("doc_id"), text.alias("text")), **options), "jaccard")
    keys = [F.col("doc_id.id").alias("key_id"), F.col("doc_id.hash").alias("key_hash")]
    gone = found.where("doc_id <> component_id").select(*keys)
    many = found.where("doc_id = component_id and n_links > 0").groupBy("doc_id").count().where("count > 1")
    rest = without(docs, gone.unionByName(many.select(*keys)), id_col, text_col)
    if many.limit(1).count() == 0:
        return rest
    return rest.unionByName(by_key(docs, many.select(*keys), "left_semi", id_col, text_col).dropDuplicates([id_col, text_col]))


ORACLE_SQL = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), sets as materialized (
    select doc_id, list_distinct(case when len(ws) >= 4
        then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) s from split
), grams as materialized (
    select doc_id, len(s) n, unnest(s) gram from sets
), links as materialized (
    select a.doc_id a, b.doc_id b from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) as (
    select doc_id, doc_id from sets
    union select r.a, l.b from reach r join links l on r.b = l.a
)
select s.doc_id, len(s.s)::bigint n_shingles, (select min(r.b) from reach r where r.a = s.doc_id) component_id,
       (select count(*) from links l where l.a = s.doc_id) n_links
from sets s
"""
