"""Columns over slash-separated folder paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ancestors(folder: Column) -> Column:
    """The folder itself and everything above it, root first: ``/a/b`` -> ``[/, /a, /a/b]``."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def folder_of(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(path, r"/[^/]*\z", "")


def name_of(path: Column) -> Column:
    """Everything after the last slash."""
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """Lower-cased extension without the dot; null when the name has none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)), F.lit(""))


def is_at_or_below(folder: Column, top: str) -> Column:
    """True when ``folder`` is ``top`` or lies below it."""
    top = top.rstrip("/")
    if not top:
        return F.lit(True)
    return (folder == top) | folder.startswith(top + "/")
