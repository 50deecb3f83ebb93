"""Sharding by rendezvous hashing.

Every shard draws a seeded number for a record's key, and the record goes to the shard whose draw,
scaled by its weight, is best. A key's shard depends on the key, the shards and their weights alone:
one more shard takes records only into itself, and a shard that is taken out gives its records to the
others and moves no other record. All of it is one native expression per row, without a shuffle.

Slots number the records of a shard without a sort of the shard: records are counted in cells (shard,
one of 1,024 buckets), the cells of a shard are summed up in order, and records are numbered inside
their cell. Rows equal in all that is returned are numbered as one record with a count, so a key of any
size stays one row until the numbers are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import CRC32_TABLE_SQL, as_bytes, crc32_sql
from docsync.session import cut_lineage

SHARDS = 8
SEED = 13
BUCKETS = 1024
# At most so many shards; a row draws once for each.
MAX_SHARDS = 4096
# Numbers of one record dealt out by one row.
RUN = 1 << 16
# A draw has so many hexadecimal digits, all of which a double holds.
_DIGITS = 13
_KEY = "_sharding_key"


def _draw(key: Column, shard: int, seed: int) -> Column:
    """A number in (0, 1) by key and shard."""
    text = F.concat(F.lit(f"{seed}:{shard}:"), key)
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("double")
    return (drawn + 0.5) / float(16 ** _DIGITS)


def shard_of(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard, from 0, that a key belongs to. Shard i gets a part of the keys in proportion to
    ``weights[i]``; a weight of 0 takes a shard out. A null key is a key of its own."""
    if not 0 < len(weights) <= MAX_SHARDS or min(weights) < 0 or max(weights) <= 0:
        raise ValueError(f"1 to {MAX_SHARDS} weights, none below 0 and one above, are needed")
    key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    # The least of the exponential draws -ln(u) / weight; of equal ones the lowest shard.
    drawn = [
        F.struct((-F.ln(_draw(key, i, seed)) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    ]
    return F.array_min(F.array(*drawn))["shard"]


def place(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key_col: str = "doc_id",
          shard_name: str = "shard", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with the shard each belongs to as a further column.

    Rows of one key share a shard, whatever their texts; null keys share one as well. Empty tables
    stay empty. A column of the new name is an error, as it would be lost."""
    if shard_name in docs.columns:
        raise ValueError(f"there is a column {shard_name!r} already")
    return docs.withColumn(shard_name, shard_of(F.col(f"`{key_col}`"), weights, seed))


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float] = (1.0,) * SHARDS,
                 key_col: str = "doc_id", shard_name: str = "shard", max_rows: int = 1 << 20, seed: int = SEED) -> None:
    """Write the rows into one folder per shard, ``folder/shard=i``, files of at most ``max_rows``
    rows. Rows are dealt out by shard and a hash of the row, so no task takes a shard, or a key with many
    different rows, whole."""
    placed = place(docs, weights, key_col, shard_name, seed)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(weights))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(max(1, tasks // len(weights))))
    placed = placed.repartition(tasks, F.col(f"`{shard_name}`"), salt)
    placed.write.option("maxRecordsPerFile", max_rows).partitionBy(shard_name).parquet(folder)


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None,
           id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1), ``slot`` the number of the record in its
    shard, without gaps from 0, in order of a hash, and ``grown_shard`` the shard under the weights
    ``grown`` (by default one more shard of the last weight). Rows equal in id, size and checksum get
    neighbouring slots; a null id is one key. An empty table gives an empty table; other columns are not
    read.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    text = as_bytes(F.col(f"`{text_col}`"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    same = ["doc_id", "size", "text_crc32"]
    records = rows.groupBy(*same).agg(F.count("*").alias("copies"))
    records = records.withColumns({
        "shard": shard_of(F.col("doc_id"), weights, seed),
        "grown_shard": shard_of(F.col("doc_id"), grown, seed),
        "order": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text_crc32", "size").cast("binary")),
    })
    bucket = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * BUCKETS / (1 << 32)
    records = cut_lineage(records.withColumn("bucket", F.floor(bucket).cast("int")), "sharding")
    # At most shards times buckets rows, whatever the input.
    cells = records.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", *same).rowsBetween(Window.unboundedPreceding, -1)
    slots = records.join(F.broadcast(cells), ["shard", "bucket"]).withColumn(
        "slot", F.col("first") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return _dealt(slots).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _dealt(slots: DataFrame) -> DataFrame:
    """A row per copy of each record. Records with many copies are cut into runs first, which are
    dealt out to tasks, so that no task writes all copies of one record."""
    few = slots.where(F.col("copies") <= RUN)
    runs = slots.where(F.col("copies") > RUN).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.withColumns({
        "slot": F.col("slot") + F.col("run") * RUN,
        "copies": F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN),
    }).drop("run").hint("rebalance", "slot")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("again")
    return few.unionByName(runs).select("*", every).withColumn("slot", F.col("slot") + F.col("again"))


def _drawn_sql(shards: int) -> str:
    draw = (f"-ln((('0x' || substr(md5('{SEED}:' || s || ':' || case when doc_id is null then 'null' else '=' || doc_id end), 1, {_DIGITS}))"
            f"::bigint::double + 0.5) / {16 ** _DIGITS}::double)")
    return (f"select doc_id, arg_min(s, (d, s))::int shard from (select doc_id, s, {draw} d from ids "
            f"cross join range({shards}) r(s)) group by doc_id")


ORACLE_SQL = rf"""
with {CRC32_TABLE_SQL}, rows as (
    select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 size,
           {crc32_sql("coalesce(text, '')")}::bigint text_crc32
    from documents cross join crc32_table
), ids as (
    select distinct doc_id from documents
), eight as (
    {_drawn_sql(SHARDS)}
), nine as (
    {_drawn_sql(SHARDS + 1)}
)
select r.doc_id, r.size, r.text_crc32, 'key' law, e.shard,
       row_number() over (partition by e.shard order by md5(concat_ws(':', '{SEED}', r.doc_id, r.text_crc32, r.size)),
           r.doc_id, r.size, r.text_crc32) - 1 slot,
       n.shard grown_shard
from rows r join eight e on r.doc_id is not distinct from e.doc_id join nine n on r.doc_id is not distinct from n.doc_id
"""
