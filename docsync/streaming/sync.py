"""From change events to the document table: one delta per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsync.operators.access import inherit_roles
from docsync.functions.paths import folder_of
from docsync.plans.reconcile import check_handlers, without_document
from docsync.session import MAX_CONFIG_ROWS, cut_lineage, scratch
from docsync.sources.quarantine import identity_checks, quarantine
from docsync.sources.snapshots import compact, is_published, write_delta
from docsync.streaming.events import folder_events, latest_event, route_events

# Turns items into documents: the extension point a dispatch row names.
Handler = Callable[[DataFrame], DataFrame]


def changes_of_batch(
    events: DataFrame, content: Callable[[DataFrame], DataFrame],
    handlers: Mapping[str, Handler], webs: Sequence[tuple], file_types: Sequence[tuple],
    dispatch: Sequence[tuple], checks: Mapping | None = None,
    listing: DataFrame | None = None, index: DataFrame | None = None,
    role_conf: Sequence[tuple] | DataFrame = (), root_roles: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """``(changes, errors)`` for one batch of events.

    ``content`` is called with the paths to be mapped and returns rows with ``path`` and what the
    handlers read; it may return more than was asked for, or read only the folders concerned.
    ``handlers`` maps handler names to functions from items to documents (identity ``path``); an event
    for a handler that is not supplied is an error. Items carry the ``roles`` that their folder
    inherits from ``root_roles`` by ``role_conf``. Changes are documents with the marks a delta needs;
    a created or changed item whose path is no longer in ``content`` counts as deleted. Documents that
    fail a check, and items without a document, go to ``errors`` and leave the table as it was.
    """
    if listing is not None and index is not None:
        # The folder events of one batch; the files below come from the listing and the table.
        events = events.unionByName(folder_events(events, listing, index))
    routed = route_events(events, webs, file_types, dispatch)
    work = cut_lineage(latest_event(routed, ["path"]), "work")
    check_handlers(work, handlers)
    to_map = work.filter("action <> 'deleted'")
    wanted = to_map.select("path", "url", "web", "file_type", "handler", folder_of(F.col("path")).alias("_dir"))
    roles = inherit_roles(wanted.select(F.col("_dir").alias("dir")), role_conf, root_roles)
    wanted = wanted.join(roles.withColumnRenamed("dir", "_dir"), "_dir").drop("_dir")
    # Read once: every handler and the check for missing files start from here.
    items = cut_lineage(content(wanted.select("path")).join(wanted, "path"), "items")
    mapped = [
        handler(items.filter(F.col("handler") == name)) for name, handler in handlers.items()
    ]
    docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mapped)
    docs = cut_lineage(docs, "mapped")
    ok, errors = quarantine(docs, {**identity_checks(["path"]), **(checks or {})})
    errors = errors.unionByName(without_document(items.select("path", F.lit("mapped").alias("action")), docs))
    gone = (
        work.filter("action = 'deleted'")
        .select("path")
        .union(to_map.select("path").join(items.select("path"), "path", "left_anti"))
        .distinct()
    )
    changes = ok.withColumn("is_deleted", F.lit(False)).unionByName(
        gone.withColumn("is_deleted", F.lit(True)), allowMissingColumns=True
    )
    when = work.select("path", F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"))
    return changes.join(when, "path"), errors


def content_by_folder(table: DataFrame, folder: str = "dir") -> Callable[[DataFrame], DataFrame]:
    """A ``content`` function over a table partitioned by the folder of its files: a batch reads the
    folders of its own paths. Up to ``MAX_CONFIG_ROWS`` folders are named in the plan, so that other
    partitions are not even listed; more are found by a join, which prunes as it runs."""

    def content(wanted: DataFrame) -> DataFrame:
        folders = wanted.select(folder_of(F.col("path")).alias(folder)).distinct()
        named = [r[folder] for r in folders.limit(MAX_CONFIG_ROWS + 1).collect()]
        if len(named) <= MAX_CONFIG_ROWS:
            return table.filter(F.col(folder).isin(named)) if named else table.filter(F.lit(False))
        return table.join(folders, folder, "left_semi")

    return content


def sync_stream(
    events: DataFrame, root: str, checkpoint: str, content: Callable[[DataFrame], DataFrame],
    handlers: Mapping[str, Handler], webs: Sequence[tuple], file_types: Sequence[tuple],
    dispatch: Sequence[tuple], checks: Mapping | None = None,
    folders: Callable[[], tuple[DataFrame, DataFrame]] | None = None, trigger: Mapping | None = None,
    role_conf: Sequence[tuple] | DataFrame = (), root_roles: Sequence[str] = (),
    compact_every: int | None = 100,
) -> StreamingQuery:
    """Keep the snapshot below ``root`` in step with an event stream.

    Each micro-batch becomes delta ``v = batch id``. A batch that is repeated after a failure finds
    its delta published and does nothing. ``content`` is called per batch (see
    ``changes_of_batch``); so is ``folders``, which returns the current listing and indexed
    documents as (path, dir) and is needed only where folder events occur. Intermediate results of a
    batch go once its delta is published; every ``compact_every`` batches the deltas are folded.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if is_published(batch.sparkSession, root, "delta", batch_id):
            return
        with scratch(batch.sparkSession):
            changes, errors = changes_of_batch(
                batch, content, handlers, webs, file_types, dispatch, checks,
                *(folders() if folders else (None, None)), role_conf, root_roles,
            )
            errors.write.mode("overwrite").parquet(f"{root}/errors/v={batch_id}")
            write_delta(changes, root, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, root)

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
