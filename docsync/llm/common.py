"""Helpers that several operators share: word hashes, folds, checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.session import cut_lineage

# Words by the contract's definition: runs of anything but space and the controls 9 to 13. These
# are just the separators of bytes.split(), so UTF-8 texts are split without a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
# A worker's memo of words is emptied at this size, which bounds its memory.
MEMO = 1 << 17
BATCH_BYTES = 8 << 20
# So many pairs of id and hash, about 16 bytes each, may be broadcast.
BROADCAST_KEYS = 1 << 20
# Bits of a bitmap of ids: 8 MB, less on the way where few are set, as it travels compressed.
BITS = 26

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered for words that come again."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(values: np.ndarray) -> np.ndarray:
    """One round of mixing, so that order and low bits carry no meaning."""
    values = (values ^ (values >> np.uint64(31))) * _MULTIPLIER
    return values ^ (values >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by the hashes of the words; empty for fewer words."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    count = len(hashes) - size + 1
    value = hashes[:count].copy()
    for i in range(1, size):
        value = scramble(value) + hashes[i:i + count]
    return scramble(value)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most these bytes, so that what a task holds at once does
    not follow the length of texts. One longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task gives out; after the last batch Arrow hands back the memory it keeps, as a worker lives on
    beside those of later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def text_hash(text: Column) -> Column:
    """Hash of a text's bytes; with the id, it tells rows apart. Null and empty are alike."""
    return F.xxhash64(as_bytes(text))


def few(keys: DataFrame) -> DataFrame:
    """Few keys (counted here, so written before) are sent to the rows they are joined with; beyond that
    bound both sides are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def by_key(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A semi or anti join of ``docs`` with ``keys`` ``(key_id, key_hash)`` on id and text hash. Columns of
    ``docs`` may have any name."""
    key_id, key_hash = fresh_names(docs, "key_id", "key_hash")
    keys = keys.select("key_id", "key_hash").toDF(key_id, key_hash)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key_id)) & (text_hash(F.col(f"`{text_col}`")) == F.col(key_hash))
    return docs.join(keys, same, how)


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which id and text hash are not in ``keys`` ``(key_id, key_hash)``."""
    keys = few(cut_lineage(keys.select("key_id", "key_hash").distinct(), "keys"))
    return by_key(docs, keys, "left_anti", id_col, text_col)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def checked_broadcast(spark: SparkSession, value, size: int, limit: int):
    """Ship a value to the executors after a check of its bytes against a stated bound."""
    if size > limit:
        raise ValueError(f"{size} bytes are over the bound of {limit} for a broadcast")
    return spark.sparkContext.broadcast(value)


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """Bits of all of a table's ``id``, by two probes each, set by Spark in words of 32 bits: at most
    2**21 rows reach the driver, whatever the number of ids."""
    probes = F.array(F.expr(f"id & {(1 << BITS) - 1}L"), F.expr(f"shiftrightunsigned(id, {64 - BITS})"))
    words = ids.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("set"))
    table = words.toArrow()
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    bitmap[table["word"].to_numpy()] = table["set"].to_numpy().astype(np.uint32)
    return bitmap


def held(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each id; those that it was made of, always."""
    found = np.ones(len(ids), bool)
    for probe in (ids & np.uint64((1 << BITS) - 1), ids >> np.uint64(64 - BITS)):
        found &= ((bitmap[probe >> np.uint64(5)] >> (probe & np.uint64(31)).astype(np.uint32)) & 1).astype(bool)
    return found


def ship_bitmap(spark: SparkSession, bitmap: np.ndarray):
    packed = compress(bitmap.tobytes(), 1)
    return checked_broadcast(spark, packed, len(packed), 1 << 24)


def shipped_bitmap(packed) -> np.ndarray:
    return np.frombuffer(decompress(packed.value), np.uint32)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Smallest reachable node of each node: ``(node, component)`` for links ``(a, b)`` of longs.

    Every round, each node takes the smallest label among itself and its neighbours, and then the
    label of that label, so the reach doubles. A round is two joins over links and labels, written
    to the shared folder; nothing of their size meets in one task or the driver. Nodes with very
    many links are pre-aggregated by Spark's partial minimum before the shuffle.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = cut_lineage(both.where("node <> other").distinct(), purpose)
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"))
    labels = cut_lineage(labels, purpose)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "component"), "other")
            .groupBy("node").agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component", "left").select(
            "node", "before", F.least("component", F.coalesce("far", "component")).alias("component")
        )
        step = cut_lineage(step, purpose)
        changed = step.where("component <> before").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts to learn from: ``(text, label)`` of at most ``per_class`` ids per label, the first by a
    hash of the id among the rows where ``learn`` holds, and how many labelled rows each label has.

    Rows without an id or with another label than 0 and 1 teach nothing; of texts that occur under
    several ids one is kept, so a group of copies counts once. The ids sampled are the bounded side
    of the join.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(learn(F.col("sample_id")))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("sample_id"), "sample_id"]
    chosen = [known.where(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{text_col}`").alias("text"))
    texts = rows.join(F.broadcast(chosen), "sample_id").where("text is not null")
    return texts.groupBy("text").agg(F.min("label").alias("label")), totals


# For oracles: the 256 remainders of unsigned crc32, by rule, as a common table expression.
CRC32_TABLE_SQL = r"""crc32_table as materialized (
    select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) remainders
)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, where ``crc32_table`` is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), "
            f"lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8)))")
