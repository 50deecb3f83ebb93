"""The sweep: compare what is on disk with the document table, in one plan for all folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions.paths import is_at_or_below
from docsync.operators.access import inherit_roles
from docsync.operators.changes import classify_changes, config_changed, dispatch_actions
from docsync.operators.store import apply_changes
from docsync.schema import check_file_types
from docsync.session import cut_lineage
from docsync.sources.files import derive_url, excluded
from docsync.sources.quarantine import identity_checks, quarantine


def with_eligible(
    listing: DataFrame, excluded_dirs: Sequence[str],
    file_types: Sequence[tuple[str, str]] | DataFrame,
) -> DataFrame:
    """Attach ``file_type`` (null when no type owns the extension) and ``eligible``: owned, and not
    in an excluded folder. Nothing is dropped."""
    eligible = F.col("file_type").isNotNull() & ~excluded(F.col("dir"), excluded_dirs)
    if isinstance(file_types, DataFrame):
        owners = file_types.select("file_type", F.col("ext").alias("_ext"))
        typed = listing.join(owners, F.lower("ext") == F.col("_ext"), "left").drop("_ext")
        return typed.withColumn("eligible", eligible)
    owners = check_file_types(file_types)
    file_type = F.lit(None).cast("string")
    for name, ext in owners:
        file_type = F.when(F.lower("ext") == ext, name).otherwise(file_type)
    return listing.withColumn("file_type", file_type).withColumn("eligible", eligible)


def sweep(
    listing: DataFrame, index: DataFrame, web: tuple, excluded_dirs: Sequence[str],
    file_types: Sequence[tuple[str, str]], dispatch: Sequence[tuple[str, str, str]],
    role_conf: Sequence[tuple] | DataFrame, root_roles: Sequence[str], force: bool | str = False,
) -> DataFrame:
    """Work items ``(path, version, action, file_type, handler, web, url, roles)`` of one web.

    ``listing`` and ``index`` have (path, dir, ext, version), one row per path; ``web`` is
    (web, root, base_url, filter). Both are limited to the web's root first: an index may hold several
    webs, and what lies elsewhere is not gone because this listing lacks it. Unchanged files are dropped before anything is attached, and
    what depends on the path alone is computed from it again instead of being carried through the
    comparison.
    """
    name, root, base_url, _ = web
    listing, index = (t.filter(is_at_or_below(F.col("dir"), root)) for t in (listing, index))
    listing = with_eligible(listing, excluded_dirs, file_types)
    changed = classify_changes(listing, index, ["path"], force).filter("action <> 'unchanged'")
    located = changed.withColumns(
        {
            "dir": F.regexp_replace("path", r"/[^/]*\z", ""),
            "ext": F.nullif(F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)), F.lit("")),
            "web": F.lit(name),
        }
    )
    typed = with_eligible(located, excluded_dirs, file_types).drop("eligible")
    # One row per path, and so per handler, web and path: there is nothing left to deduplicate.
    work = dispatch_actions(typed, dispatch)
    roles = inherit_roles(
        listing.select("dir").union(index.select("dir")), role_conf, root_roles
    )
    return derive_url(work, base_url, root).join(roles, "dir", "left").select(
        "path", "version", "action", "file_type", "handler", "web", "url", "roles"
    )


def configured_sweep(
    listing: DataFrame, index: DataFrame, web: tuple, name: str, configured: DataFrame,
    stored: DataFrame | None, *settings,
) -> DataFrame:
    """A ``sweep`` (``settings`` are its further arguments) in which every eligible indexed file counts
    as changed when the configuration of index ``name`` has another stamp than the stored one, or
    none is stored. Publish the new table with the stamps of ``configured`` (``write_snapshot(...,
    stamps=...)``), and the next sweep orders nothing."""
    changed = configured.filter(F.col("index") == name)
    if stored is None:
        stored = configured.limit(0)
    changed = config_changed(changed, stored).select(F.bool_or("changed").alias("changed"))
    force = F.coalesce(changed.scalar(), F.lit(False))
    return sweep(listing.withColumn("_forced", force), index, web, *settings, force="_forced")


def check_handlers(work: DataFrame, handlers: Mapping[str, Callable]) -> None:
    """Raise when a row to be mapped names a handler that is not supplied. Rows that only delete need
    none; there are as many names as the dispatch table has."""
    named = work.filter(F.col("action") != "deleted").select("handler").distinct()
    missing = named.filter(~F.coalesce("handler", F.lit("")).isin(list(handlers)))
    unknown = sorted(str(r.handler) for r in missing.limit(20).collect())
    if unknown:
        raise ValueError(f"no handler supplied for {', '.join(unknown)}")


def without_document(work: DataFrame, mapped: DataFrame) -> DataFrame:
    """Error rows for the items to be mapped that gave no document."""
    wanted = work.filter(F.col("action") != "deleted").select("path")
    lost = wanted.join(mapped.select("path"), "path", "left_anti")
    return lost.select("path", F.lit("mapping").alias("stage"), F.lit("no document").alias("message"))


def reconcile(
    docs: DataFrame, work: DataFrame, content: DataFrame,
    handlers: Mapping[str, Callable[[DataFrame], DataFrame]], checks: Mapping | None = None,
    version: str = "version_ticks", tiebreak: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(next documents, errors)``: map the created and changed items of a sweep with the handlers
    its rows name, and apply all of its changes to the document table (identity ``path``).

    Rows that name a handler which is not supplied are an error before anything is mapped; items that
    are missing in ``content``, or for which a handler returns no document, go to ``errors``.

    The work list and the mapped documents are written once to the shared folder: both are read
    several times, and extraction is the expensive part."""
    work = cut_lineage(work, "work")
    check_handlers(work, handlers)
    items = content.join(
        work.filter("action <> 'deleted'").select("path", "url", "roles", "file_type", "handler"),
        "path",
    )
    mapped = None
    for name, handler in handlers.items():
        part = handler(items.filter(F.col("handler") == name))
        mapped = part if mapped is None else mapped.unionByName(part, allowMissingColumns=True)
    mapped = cut_lineage(mapped, "mapped")
    ok, errors = quarantine(mapped, {**identity_checks(["path"]), **(checks or {})})
    errors = errors.unionByName(without_document(work, mapped))
    return apply_changes(docs, work.select("path", "action"), ok, ["path"], version, tiebreak), errors
