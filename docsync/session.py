"""Session settings, the shared scratch folder and small configuration frames."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Configuration held as Python rows may not exceed this; more belongs in a table.
MAX_CONFIG_ROWS = 10_000
MAX_CONFIG_BYTES = 8 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Hot partitions of a join are split even where that costs a further shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Partitions are cut to this size after each shuffle, whatever the partition count.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Position lists: keep hash aggregation for more groups before falling back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


# Folder that owns what is written to the shared folder meanwhile; see ``scratch``.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def build_session(
    app: str = "docsync", master: str | None = None, extra: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings this package is tuned for. On a cluster leave ``master`` out
    and set ``spark.sql.shuffle.partitions`` to two or three times the core count."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session that names no such folder gets a temporary one. Inside ``scratch`` the
    folder goes when the scope ends.
    """
    if _scope.get():
        return f"{_scope.get()}/{purpose}-{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="docsync-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope that owns every intermediate result written in it. Results that are still needed are
    written elsewhere before it ends; then its folder is deleted."""
    folder = shared_folder(spark, "scratch")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """A scope in which shuffle files go as soon as the result they were made for is written. Else they stay
    until the driver happens to collect its garbage, and those of several large results lie side by side."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back. Losing an executor
    later costs nothing that came before this point."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, second: Column, purpose: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` for which ``second`` does not hold, and those for which it does: computed in one
    pass, written once to the shared folder by outcome and read back apart, each from its own files."""
    spark, name = df.sparkSession, "_second"
    while name in df.columns:
        name = f"_{name}"
    path = shared_folder(spark, purpose)
    df.withColumn(name, F.coalesce(second, F.lit(False)).cast("int")).write.partitionBy(name).parquet(path)
    both = spark.read.schema(StructType(list(df.schema.fields)).add(name, "integer")).parquet(path)
    return both.filter(F.col(name) == 0).drop(name), both.filter(F.col(name) == 1).drop(name)


def config_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a local relation, to be joined by broadcast. Both limits are checked
    here, so the broadcast has a size bound whatever the data."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    table = pa.Table.from_arrays(arrays, schema=arrow)
    if len(rows) > MAX_CONFIG_ROWS or table.nbytes > MAX_CONFIG_BYTES:
        raise ValueError(f"{len(rows)} rows, {table.nbytes} bytes: keep them in a table instead")
    return F.broadcast(spark.createDataFrame(table, schema=struct))


def config_table(
    spark: SparkSession, rows: Sequence[tuple] | DataFrame, schema: str,
    check: Callable[[Sequence[tuple]], list[tuple]] = list,
) -> DataFrame:
    """Configuration as rows, checked and broadcast, or as a table of any size with the columns of
    ``schema``, which Spark joins as it sees fit and whose keys must be unique."""
    if isinstance(rows, DataFrame):
        return rows.select(*StructType.fromDDL(schema).names)
    return config_frame(spark, check(rows), schema)
