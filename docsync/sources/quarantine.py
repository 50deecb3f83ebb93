"""Rows that cannot be mapped go to an error table, never to the document table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.session import parted


def _failures(checks: Mapping[str, tuple[Column, str]]) -> Column:
    """Array of (stage, message) for every check that holds."""
    found = [
        F.when(failed, F.struct(F.lit(stage).alias("stage"), F.lit(message).alias("message")))
        for stage, (failed, message) in checks.items()
    ]
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def quarantine(
    df: DataFrame, checks: Mapping[str, tuple[Column, str]], key: str = "path", once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(ok, errors)``. ``checks`` maps a stage to (condition that means failure, message).

    ``ok`` has the input's columns and the rows no check holds for; ``errors`` has one row
    (key, stage, message) per failed check. Both are filters over the same input, which is computed for
    each; with ``once`` it is computed and written one time, apart by outcome, and both are read back.
    """
    any_failed = F.lit(False)
    for failed, _ in checks.values():
        any_failed = any_failed | F.coalesce(failed, F.lit(False))
    ok, failed = parted(df, any_failed, "quarantine") if once else (df.filter(~any_failed), df.filter(any_failed))
    errors = (
        failed.select(F.col(key), F.explode(_failures(checks)).alias("failure"))
        .select(F.col(key), "failure.stage", "failure.message")
    )
    return ok, errors


def identity_checks(keys: list[str]) -> dict[str, tuple[Column, str]]:
    """Checks that every identity column has a value."""
    return {f"identity:{k}": (F.col(k).isNull(), f"{k} has no value") for k in keys}
