"""Change events: reading, routing, folding.

Everything here works on a batch; ``route_events`` works on a stream as well, and
``debounce_stream`` is the streaming form of ``debounce_events``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import paths, urls
from docsync.functions.paths import ancestors
from docsync.operators.changes import dispatch_actions
from docsync.operators.store import latest_per_identity
from docsync.schema import CHANGE_EVENTS, FILE_TYPES, check_file_types
from docsync.session import config_table

# The change kinds that are subscribed to.
EVENT_KINDS = ("Created", "Changed", "Deleted")

WEBS = "web string, root string, base_url string, filter string"


def read_change_events(
    spark: SparkSession, folder: str, source_format: str = "parquet", max_files: int = 1000
) -> DataFrame:
    """Stream of change notifications from a landing folder; other kinds than ``EVENT_KINDS`` are
    dropped. A micro-batch takes at most ``max_files`` new files."""
    return (
        spark.readStream.schema(CHANGE_EVENTS)
        .format(source_format)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .filter(F.col("change_type").isin(*EVENT_KINDS))
    )


def route_events(
    events: DataFrame, webs: Sequence[tuple] | DataFrame, file_types: Sequence[tuple] | DataFrame,
    dispatch: Sequence[tuple] | DataFrame,
) -> DataFrame:
    """File events somebody handles, with web, file type, action, handler and URL attached.

    ``webs`` are rows (web, root, base_url, filter). Each configuration is rows, or a table where
    there are too many. Joins against rows do not shuffle the events, which may be a stream.
    """
    spark = events.sparkSession
    web_rows = config_table(spark, webs, WEBS)
    owners = config_table(spark, file_types, FILE_TYPES, check_file_types)
    routed = (
        events.filter(~F.col("is_dir") & F.col("change_type").isin(*EVENT_KINDS))
        .join(web_rows, "web")
        .filter(F.regexp_like("path", F.col("filter")))
        .withColumn("ext", paths.extension_of(F.col("path")))
        .join(owners, "ext")
        .withColumn("action", F.lower("change_type"))
        .withColumn("url", urls.url_below(F.col("base_url"), F.col("root"), F.col("path")))
    )
    return dispatch_actions(routed, dispatch).select(
        "event_id", "ts", "web", "path", "url", "file_type", "action", "handler"
    )


def latest_event(events: DataFrame, keys: Sequence[str] = ("web", "path")) -> DataFrame:
    """Per path the last event, which alone decides the action; ties go to the higher id."""
    return latest_per_identity(events, keys, "ts", "event_id")


def folder_events(events: DataFrame, listing: DataFrame, index: DataFrame) -> DataFrame:
    """File events that follow from folder events, in the shape of the input.

    A created folder brings in the files listed below it as created; a deleted folder takes out
    every indexed document at or below it. ``listing`` and ``index`` have (path, dir).

    Folders are matched first: per folder only its last create and its last delete matter, whichever
    ancestor they come from. Files and documents then meet one row per folder and kind.
    """
    kinds = events.filter(F.col("is_dir") & F.col("change_type").isin("Created", "Deleted"))
    tops = latest_event(kinds, ["web", "path", "change_type"]).select(
        F.col("path").alias("_top"), "event_id", "ts", "web", "change_type"
    )

    def below(items: DataFrame, kind: str) -> DataFrame:
        per_dir = (
            items.select("dir")
            .distinct()
            .select("dir", F.explode(ancestors(F.col("dir"))).alias("_top"))
            .join(tops.filter(F.col("change_type") == kind), "_top")
            .drop("_top")
        )
        last = latest_event(per_dir, ["web", "dir"])
        return items.select("path", "dir").join(last, "dir")

    found = below(listing, "Created").unionByName(below(index, "Deleted"))
    return found.select(
        "event_id", "ts", "web", "path", F.lit(False).alias("is_dir"), "change_type"
    )
