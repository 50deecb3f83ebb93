"""What changed between a file listing and the document table, and who has to act on it.

``listing`` is everything on disk, one row per identity, with its ``version``. ``index`` is what the
document table holds, with the version it was indexed at. A document leaves only when its file is
gone from the *whole* listing, so the listing is compared before folders or file types are filtered
out; the ``eligible`` flag carries that filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import paths
from docsync.schema import DISPATCH, check_dispatch
from docsync.session import config_table


def deleted_files(index: DataFrame, listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Indexed documents whose file is no longer on disk."""
    return index.join(listing.select(*keys), list(keys), "left_anti")


def created_files(listing: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files with no indexed document of the same identity."""
    return listing.join(index.select(*keys), list(keys), "left_anti")


def changed_files(
    listing: DataFrame, index: DataFrame, keys: Sequence[str], force: bool | Column = False
) -> DataFrame:
    """Files that are indexed at another version; all indexed files where ``force`` holds."""
    force = F.lit(force) if isinstance(force, bool) else force
    indexed = index.select(*keys, F.col("version").alias("_indexed"))
    differs = ~F.col("version").eqNullSafe(F.col("_indexed"))
    return listing.join(indexed, list(keys)).filter(force | differs).drop("_indexed")


def classify_changes(
    listing: DataFrame, index: DataFrame, keys: Sequence[str], force: bool | str = False
) -> DataFrame:
    """``(keys, version, action)`` with action created, changed, deleted or unchanged.

    ``force`` (a flag, or the name of a boolean column of the listing) makes every eligible indexed
    file changed. ``listing`` needs ``version`` and ``eligible``. A file that is neither eligible nor indexed
    gives no row; one that is indexed, on disk and not eligible is unchanged.

    One aggregation over the union of both sides instead of a full outer join: each side is
    combined before the shuffle, repeated identities cost nothing, and there is nothing to sort.
    """
    keys = list(keys)
    on_disk = listing.select(
        *keys,
        F.col("version").cast("bigint").alias("_listed"),
        F.lit(None).cast("bigint").alias("_indexed"),
        F.lit(True).alias("_on_disk"),
        F.lit(False).alias("_in_index"),
        F.coalesce("eligible", F.lit(False)).alias("_eligible"),
        (F.col(force) if isinstance(force, str) else F.lit(force)).alias("_force"),
    )
    in_index = index.select(
        *keys,
        F.lit(None).cast("bigint").alias("_listed"),
        F.col("version").cast("bigint").alias("_indexed"),
        F.lit(False).alias("_on_disk"),
        F.lit(True).alias("_in_index"),
        F.lit(False).alias("_eligible"),
        F.lit(False).alias("_force"),
    )
    seen = (
        on_disk.unionByName(in_index)
        .groupBy(*keys)
        .agg(
            F.max("_listed").alias("_listed"),
            F.max("_indexed").alias("_indexed"),
            F.bool_or("_on_disk").alias("_on_disk"),
            F.bool_or("_in_index").alias("_in_index"),
            F.bool_or("_eligible").alias("_eligible"),
            F.bool_or("_force").alias("_force"),
        )
    )
    same = F.col("_listed").eqNullSafe(F.col("_indexed"))
    action = (
        F.when(~F.col("_on_disk"), "deleted")
        .when(~F.col("_in_index"), "created")
        .when(F.col("_eligible") & (F.col("_force") | ~same), "changed")
        .otherwise("unchanged")
    )
    return seen.filter(F.col("_in_index") | F.col("_eligible")).select(
        *keys, F.coalesce("_listed", "_indexed").alias("version"), action.alias("action")
    )


def removed_subtree(docs: DataFrame, removed_dirs: Sequence[str] | DataFrame) -> DataFrame:
    """Documents at or below a removed folder.

    A list of folders becomes a filter on the scan. A table (column ``dir``) is matched against the
    ancestors of the distinct folders first; the documents then meet only the folders hit.
    """
    if not isinstance(removed_dirs, DataFrame):
        below = [paths.is_at_or_below(F.col("dir"), top) for top in removed_dirs]
        return docs.filter(reduce(Column.__or__, below, F.lit(False)))
    hit = (
        docs.select("dir")
        .distinct()
        .select("dir", F.explode(paths.ancestors(F.col("dir"))).alias("ancestor"))
        .join(removed_dirs.select(F.col("dir").alias("ancestor")), "ancestor", "left_semi")
        .select("dir")
        .distinct()
    )
    return docs.join(hit, "dir", "left_semi")


def config_changed(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """``(index, changed)``: the configured stamp differs from the stored one, or none is stored."""
    was = stored.select("index", F.col("stamp").alias("_stored"))
    return configured.join(was, "index", "left").select(
        "index", (~F.col("stamp").eqNullSafe(F.col("_stored"))).alias("changed")
    )


def dispatch_actions(
    changes: DataFrame, dispatch: Sequence[tuple[str, str, str]] | DataFrame
) -> DataFrame:
    """Attach the handler of (file_type, action); actions nobody handles are dropped."""
    handlers = config_table(changes.sparkSession, dispatch, DISPATCH, check_dispatch)
    return changes.join(handlers, ["file_type", "action"])


def dedup_work(work: DataFrame) -> DataFrame:
    """One work item per handler, web and path; combined before the shuffle."""
    return work.dropDuplicates(["handler", "web", "path"])
