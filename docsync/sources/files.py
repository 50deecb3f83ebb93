"""File listings: metadata, folder exclusion, routing by extension, URLs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import paths, urls
from docsync.schema import FILE_TYPES, check_file_types
from docsync.session import config_frame, config_table, cut_lineage


# Entries handed to Spark at a time while one folder is read.
CHUNK = 10_000

ENTRIES = "uri string, path string, is_dir boolean, length bigint, modified timestamp"


def _folder_reader() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function for the tasks, nested so that it travels with the job."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Direct entries of each folder of a batch; a folder that is gone by now has none."""
        for frame in frames:
            for uri in frame["uri"]:
                system, folder = fs.FileSystem.from_uri(uri)
                # Names in a URI are escaped, those of a bare path are not.
                named = str if uri.startswith("/") else quote
                prefix = uri[: -len(named(folder))] if uri.endswith(named(folder)) else ""
                entries = [
                    e
                    for e in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                    # Linked folders would be walked twice, or for ever.
                    if e.is_file or not (system.type_name == "local" and os.path.islink(e.path))
                ]
                for start in range(0, len(entries), CHUNK):
                    part = entries[start : start + CHUNK]
                    yield pd.DataFrame(
                        {
                            "uri": [prefix + named(e.path) for e in part],
                            "path": [e.path for e in part],
                            "is_dir": [not e.is_file for e in part],
                            "length": [e.size or 0 for e in part],
                            "modified": pd.to_datetime(
                                [e.mtime_ns // 1000 for e in part], unit="us", utc=True
                            ),
                        }
                    )

    return read


# Stores that the folder reader opens by itself; Hadoop has further names for one kind of them.
_OPENED = {"file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs"}


def _resolved(spark: SparkSession, root: str) -> str:
    """Where a folder lies by Hadoop's settings: with the scheme of the default store, and below the folder
    that a mounted one stands for. Below a folder that is missing, names are kept as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path, below = system.makeQualified(path), ""
    while True:
        try:
            return system.resolvePath(path).toString() + below
        except Py4JJavaError as error:
            if path.isRoot() or "FileNotFoundException" not in error.java_exception.getClass().getName():
                raise
        path, below = path.getParent(), f"/{path.getName()}{below}"


def _listable(spark: SparkSession, root: str) -> str:
    """A root as the folder reader understands it: a URI with escaped names, or a bare path of this machine
    or of the folder that all executors share."""
    # Hadoop's names for one kind of store.
    root = re.sub(r"\As3[an]:", "s3:", re.sub(r"(?<=[^/:])/+\Z", "", root))
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root):
        if spark.sparkContext.master.startswith("local"):
            return root
        shared, found = spark.conf.get("spark.checkpoint.dir", None), _resolved(spark, root)
        if found.startswith("file:"):
            if not shared or not f"{root}/".startswith(f"{shared.rstrip('/')}/"):
                raise ValueError(f"{root!r} has no scheme; each executor would list its own disk")
            return root
        root = found
    if root.partition(":")[0] not in _OPENED:
        root = _resolved(spark, root)
    scheme, store, folder = re.fullmatch(r"(?s)([^:/]+):(//[^/]*)?(.*)", root).groups()
    return f"{scheme}:{store or '//'}{quote(folder)}"


def list_files(
    spark: SparkSession, root: str | Sequence[str], glob: str | None = None,
    excluded_dirs: Sequence[str] = (),
) -> DataFrame:
    """``files(path, name, dir, ext, length, modified)`` for every file below the root(s).

    The tree is walked level by level: the folders of a level are spread over the cluster, each task
    lists some of them, and the entries go to the shared folder, not to the driver. Excluded folders
    are not entered. Contents are never read.

    Spark's own file sources are no substitute: they leave out empty files and names that start with
    a dot or an underscore, and such files would then count as deleted.

    On a cluster a root needs a scheme, or a default store that gives one: a bare path would name every
    executor's own disk, unless it is below the folder they share. Names are taken as Spark takes them, not
    as escaped; folders mounted by Hadoop's settings are listed where they lie. One folder
    is read by one task; stores with very large folders keep inventories, and a table of
    (path, dir, ext, version) from one goes to ``sweep`` as well as a listing does.
    """
    roots = [(_listable(spark, r),) for r in ([root] if isinstance(root, str) else root)]
    tasks = spark.sparkContext.defaultParallelism
    folders = config_frame(spark, roots, "uri string")
    found: list[DataFrame] = []
    while not folders.isEmpty():
        level = cut_lineage(
            folders.repartition(tasks, "uri").mapInPandas(_folder_reader(), ENTRIES), "listing"
        )
        found.append(level.filter("not is_dir"))
        inside = level.filter("is_dir")
        if excluded_dirs:
            inside = inside.filter(~excluded(F.col("path"), excluded_dirs))
        folders = inside.select("uri")
    listed = reduce(DataFrame.union, found).select(
        "path",
        paths.name_of(F.col("path")).alias("name"),
        paths.folder_of(F.col("path")).alias("dir"),
        paths.extension_of(F.col("path")).alias("ext"),
        "length",
        "modified",
    )
    if glob is None:
        return listed
    pattern = re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".")
    return listed.filter(F.col("name").rlike(rf"(?s)\A{pattern}\z"))


def excluded(folder: Column, excluded_dirs: Sequence[str]) -> Column:
    """True for folders at or below an excluded one."""
    hit = F.lit(False)
    for top in excluded_dirs:
        hit = hit | paths.is_at_or_below(folder, top)
    return hit


def exclude_subtrees(files: DataFrame, excluded_dirs: Sequence[str] | DataFrame) -> DataFrame:
    """Files outside the excluded folders and everything below them.

    A list becomes a filter on the scan. A table (column ``dir``) is matched against the ancestors
    of the *distinct* folders, and only the folders hit are then removed from the files.
    """
    if not isinstance(excluded_dirs, DataFrame):
        return files.filter(~excluded(F.col("dir"), excluded_dirs))
    folders = files.select("dir").distinct()
    hit = (
        folders.select("dir", F.explode(paths.ancestors(F.col("dir"))).alias("ancestor"))
        .join(excluded_dirs.select(F.col("dir").alias("ancestor")), "ancestor", "left_semi")
        .select("dir")
        .distinct()
    )
    return files.join(hit, "dir", "left_anti")


def route_by_extension(
    files: DataFrame, file_types: Sequence[tuple[str, str]] | DataFrame
) -> DataFrame:
    """Attach the file type that owns each file's extension; files without an owner are dropped. A
    table of file types has lower-cased extensions without the dot."""
    owners = config_table(files.sparkSession, file_types, FILE_TYPES, check_file_types)
    return files.withColumn("ext", F.lower("ext")).join(owners, "ext")


def derive_url(files: DataFrame, base_url: str | Column, root: str | Column) -> DataFrame:
    """Attach ``url``: the path below ``root``, percent-encoded, appended to ``base_url``."""
    base_url = F.lit(base_url) if isinstance(base_url, str) else base_url
    root = F.lit(root) if isinstance(root, str) else root
    return files.withColumn("url", urls.url_below(base_url, root, F.col("path")))


def split_url(df: DataFrame, column: str = "url") -> DataFrame:
    """Attach scheme, host, path, query, fragment and authority, each prefixed ``url_``."""
    return df.withColumns({f"url_{p}": urls.url_part(F.col(column), p) for p in urls.URL_PARTS})
