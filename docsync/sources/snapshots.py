"""The document table on disk: immutable versions that exist once their manifest row does.

Layout below one root::

    base/v=N-.../  full document table, bucketed by identity (or partitioned, where asked for)
    delta/v=N-.../ changed documents and delete marks of one batch
    manifest/...   one row per version: kind, folder, what it folds in, schema, buckets, stamps

Every attempt writes to a folder of its own and the manifest row comes last, so a failed or repeated
write is never seen. A base folds in every delta up to ``folded``; later deltas are laid over it when
reading. A folded base keeps the marks of its changes, and those of deleted documents for a while, so
that an event which arrives late never replaces a newer one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsync.operators.store import delete_docs, latest_per_identity
from docsync.session import config_frame

MANIFEST = (
    "version bigint, kind string, folder string, folded bigint, schema string, "
    "buckets int, bucketed_by array<string>, stamps array<struct<index: string, stamp: timestamp>>, "
    "partition_by array<string>"
)

# Columns a delta has besides those of the documents.
MARKS = {"is_deleted": "boolean", "changed_at": "timestamp", "change_id": "bigint"}

# How long a folded base remembers the marks of deleted documents.
HORIZON = timedelta(days=30)


def _manifest(spark: SparkSession, root: str, rows: str = "v=*") -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest/{rows}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return None
        raise


def is_published(spark: SparkSession, root: str, kind: str, version: int) -> bool:
    """True when the version's manifest row exists; looks at that row only."""
    row = _manifest(spark, root, f"v={kind}-{version}")
    return row is not None and not row.isEmpty()


def _publish(spark: SparkSession, root: str, row: Row) -> None:
    # A single small file: its rename into place is the commit.
    config_frame(spark, [tuple(row)], MANIFEST).coalesce(1).write.mode("overwrite").json(
        f"{root}/manifest/v={row.kind}-{row.version}"
    )


def _new_folder(kind: str, version: int) -> str:
    return f"{kind}/v={version}-{uuid.uuid4().hex}"


def write_snapshot(
    docs: DataFrame, root: str, version: int, folded: int = -1,
    stamps: Mapping[str, datetime] | None = None, partition_by: Sequence[str] = (),
    buckets: int | None = None, bucketed_by: Sequence[str] = ("path",),
) -> None:
    """Write a full table as base ``version`` and publish it. ``folded`` is the highest delta it
    already contains. A published version is never rewritten.

    The table is bucketed and sorted by identity, into ``buckets`` (by default as many as there are
    shuffle partitions). Upserts, deletes and deltas on a table read back from buckets then move
    only the incoming rows, and a table that came from such an upsert
    (``incoming.repartition(buckets, *keys)``) is written without a shuffle. With ``partition_by`` it
    is partitioned instead.
    """
    spark = docs.sparkSession
    if is_published(spark, root, "base", version):
        raise ValueError(f"base version {version} is already published")
    folder = _new_folder("base", version)
    if not partition_by:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if partition_by:
        docs.write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
    else:
        keys, table = list(bucketed_by), f"docsync_{uuid.uuid4().hex}"
        (
            docs.repartition(buckets, *keys)
            .write.format("parquet")
            .bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", f"{root}/{folder}")
            .saveAsTable(table)
        )
        # Only the name goes: the files of a table with a path of its own stay.
        spark.sql(f"DROP TABLE {table}")
    marks = [{"index": k, "stamp": v} for k, v in (stamps or {}).items()]
    _publish(spark, root, Row(
        version=version, kind="base", folder=folder, folded=folded, schema=docs.schema.json(),
        buckets=None if partition_by else buckets, bucketed_by=None if partition_by else list(bucketed_by),
        stamps=marks, partition_by=list(partition_by),
    ))


def write_delta(changes: DataFrame, root: str, version: int) -> bool:
    """Write changed documents with the columns of ``MARKS`` as delta ``version`` and publish it.
    Returns False, writing nothing, when that delta exists: repeating a batch is harmless."""
    spark = changes.sparkSession
    if is_published(spark, root, "delta", version):
        return False
    folder = _new_folder("delta", version)
    changes.write.parquet(f"{root}/{folder}")
    _publish(spark, root, Row(
        version=version, kind="delta", folder=folder, folded=-1, schema=changes.schema.json(),
        buckets=None, bucketed_by=None, stamps=[], partition_by=[],
    ))
    return True


def _versions(spark: SparkSession, root: str) -> tuple[Row | None, list[Row]]:
    """The newest base row and the delta rows after it; a few small rows, one per write."""
    rows = _manifest(spark, root)
    if rows is None:
        return None, []
    bases = rows.filter("kind = 'base'")
    base = bases.agg(F.max_by(F.struct(*bases.columns), "version").alias("newest")).first().newest
    since = base.folded if base else -1
    deltas = rows.filter((F.col("kind") == "delta") & (F.col("version") > since))
    return base, deltas.orderBy("version").collect()


def _read_base(spark: SparkSession, root: str, base: Row) -> DataFrame:
    schema, location = StructType.fromJson(json.loads(base.schema)), f"{root}/{base.folder}"
    if not base.buckets:
        return spark.read.schema(schema).parquet(location).select(*schema.names)
    # Metadata only: tells the session how the existing files are bucketed.
    table = f"docsync_{hashlib.md5(location.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(f"`{k}`" for k in base.bucketed_by)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {base.buckets} BUCKETS "
        f"LOCATION '{location}'"
    )
    return spark.table(table)


def read_stamps(spark: SparkSession, root: str) -> DataFrame | None:
    """Configuration stamps ``(index, stamp)`` stored with the newest base."""
    rows = _manifest(spark, root)
    if rows is None:
        return None
    newest = rows.filter("kind = 'base'").agg(F.max_by("stamps", "version").alias("stamps"))
    return newest.select(F.inline("stamps"))


def read_delta_changes(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame | None:
    """The last change of every identity over all deltas not yet folded into a base. Which change is
    last is decided by ``changed_at`` and ``change_id``, not by the order of arrival."""
    _, deltas = _versions(spark, root)
    if not deltas:
        return None
    schema = StructType()
    for delta in deltas:  # later deltas add columns to those of earlier ones, and drop none
        new = StructType.fromJson(json.loads(delta.schema))
        schema = StructType(schema.fields + [f for f in new.fields if f.name not in schema.names])
    changes = spark.read.schema(schema).parquet(*(f"{root}/{d.folder}" for d in deltas))
    return latest_per_identity(changes, keys, "changed_at", "change_id")


def _with_marks(docs: DataFrame) -> DataFrame:
    """A base with the columns of ``MARKS``; documents that no event has changed have no time."""
    missing = {n: F.lit(None).cast(t) for n, t in MARKS.items() if n not in docs.columns}
    return docs.withColumns(missing).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))


def _overlaid(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The newest base with its deltas, marks and delete marks included."""
    base, _ = _versions(spark, root)
    docs = _with_marks(_read_base(spark, root, base)) if base else None
    changes = read_delta_changes(spark, root, keys)
    if docs is None and changes is None:
        raise ValueError(f"nothing is published below {root}")
    if docs is None or changes is None:
        return docs if changes is None else changes
    # Changes older than what the base has folded in already are late and lose.
    known = docs.filter("changed_at is not null").select(
        *keys, F.struct("changed_at", "change_id").alias("_known"))
    later = F.col("_known").isNull() | (F.struct("changed_at", "change_id") > F.col("_known"))
    changes = changes.join(known, list(keys), "left").filter(later).drop("_known")
    return delete_docs(docs, changes, keys).unionByName(changes, allowMissingColumns=True)


def read_snapshot(
    spark: SparkSession, root: str, keys: Sequence[str] = ("path",), version: int | None = None
) -> DataFrame:
    """The published document table: the newest base (or base ``version`` alone) with later deltas
    laid over it. A bucketed base stays where it is; the deltas' keys move to it."""
    if version is not None:
        if not is_published(spark, root, "base", version):
            raise ValueError(f"base version {version} is not published")
        found = _with_marks(_read_base(spark, root, _manifest(spark, root, f"v=base-{version}").first()))
    else:
        found = _overlaid(spark, root, keys)
    return found.filter(~F.col("is_deleted")).drop(*MARKS)


def compact(
    spark: SparkSession, root: str, keys: Sequence[str] = ("path",), horizon: timedelta = HORIZON,
) -> int:
    """Fold all published deltas into a new base with the layout and stamps of the last one; returns
    its version. Marks of documents deleted longer than ``horizon`` before the last change go: an
    event later than that counts as new."""
    base, deltas = _versions(spark, root)
    number = (base.version if base else -1) + 1
    folded = deltas[-1].version if deltas else (base.folded if base else -1)
    layout = {"bucketed_by": list(keys)}
    if base and base.buckets:
        layout = {"buckets": base.buckets, "bucketed_by": base.bucketed_by}
    elif base:
        layout = {"partition_by": base.partition_by}
    stamps = {s["index"]: s["stamp"] for s in (base.stamps if base else None) or []}
    found = _overlaid(spark, root, keys)
    last = found.agg(F.max("changed_at").alias("last")).first().last
    if last is not None:
        found = found.filter(~F.col("is_deleted") | (F.col("changed_at") >= F.lit(last - horizon)))
    write_snapshot(found, root, number, folded, stamps, **layout)
    return number


def expire_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete what no reader can ask for once the newest ``keep`` bases are all that is kept: older bases and
    the deltas that the oldest kept one has folded in, their manifest rows first. Then the manifest, which
    every read lists, has a row per kept base and unfolded delta. Returns the folders deleted.

    Folders of writes that never were published go as well, unless they are newer than every published one.
    No writer may be at work, and readers that began on an older base have to be done."""
    if keep < 1:
        raise ValueError("the newest base is always kept")
    rows = _manifest(spark, root)
    rows = [] if rows is None else rows.collect()
    bases = sorted((r for r in rows if r.kind == "base"), key=lambda r: -r.version)
    if not bases:
        return []
    folded = min(r.folded for r in bases[:keep])
    stays = {r.folder for r in bases[:keep]} | {r.folder for r in rows if r.kind == "delta" and r.version > folded}
    newest = {k: max((r.version for r in rows if r.kind == k), default=-1) for k in ("base", "delta")}
    gone = []
    for row in rows:
        if row.folder not in stays:
            delete_folder(spark, f"{root}/manifest/v={row.kind}-{row.version}")
    for kind, last in newest.items():
        for name in names_below(spark, f"{root}/{kind}"):
            version = int(name.split("=")[1].split("-")[0])
            if f"{kind}/{name}" not in stays and version <= last:
                delete_folder(spark, f"{root}/{kind}/{name}")
                gone.append(f"{kind}/{name}")
    return sorted(gone)


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names_below(spark: SparkSession, location: str) -> list[str]:
    """Names of the version folders below one folder."""
    path, system = _path(spark, location)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def delete_folder(spark: SparkSession, location: str) -> None:
    """Delete a folder of a shared store with all below it."""
    path, system = _path(spark, location)
    system.delete(path, True)
