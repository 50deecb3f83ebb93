"""Who may see what: roles inherited down the folder tree, file rights, visibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import rights as masks
from docsync.functions.paths import ancestors
from docsync.schema import ROLE_CONF, check_role_conf
from docsync.session import config_frame


def _split_roles(roles: Column) -> Column:
    """Split on commas, keeping blanks around names and empty names as they are."""
    return F.split(roles, ",", -1)


def inherit_roles(
    dirs: DataFrame, role_conf: Sequence[tuple] | DataFrame, root_roles: Sequence[str]
) -> DataFrame:
    """``(dir, roles)`` for each distinct folder.

    From the root down: a folder without a rule keeps its parent's roles; an allow list replaces
    them; a deny list then removes members. ``role_conf(dir, allow, deny)`` has one row per folder.

    Only folders are shuffled, never files, and a group holds one row per rule on the way down.
    """
    if not isinstance(role_conf, DataFrame):
        role_conf = config_frame(dirs.sparkSession, check_role_conf(role_conf), ROLE_CONF)
    rules = role_conf.select(F.col("dir").alias("_ancestor"), "allow", "deny")
    steps = (
        dirs.select("dir")
        .distinct()
        .select("dir", F.posexplode(ancestors(F.col("dir"))).alias("_depth", "_ancestor"))
        .join(rules, "_ancestor", "left")
        .groupBy("dir")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("allow").isNotNull() | F.col("deny").isNotNull(),
                        F.struct("_depth", "allow", "deny"),
                    )
                )
            ).alias("_rules")
        )
    )

    def step(roles: Column, rule: Column) -> Column:
        granted = F.coalesce(_split_roles(rule["allow"]), roles)
        denied = F.coalesce(_split_roles(rule["deny"]), F.array().cast("array<string>"))
        # Not array_except: that would also drop repeated roles.
        return F.filter(granted, lambda r: ~F.array_contains(denied, r))

    start = F.array(*map(F.lit, root_roles)).cast("array<string>")
    return steps.select("dir", F.aggregate("_rules", start, step).alias("roles"))


def read_rights(acl: DataFrame, deny_aware: bool = True) -> DataFrame:
    """``(path, account, can_read)`` from access entries (path, account, rights, entry_type).

    A denied account has no read right. With ``deny_aware=False`` an entry counts as a grant
    whatever its type.
    """
    read = masks.grants_read_data(F.col("rights"))
    granted = F.bool_or((F.col("entry_type") == "allow") & read)
    denied = F.bool_or((F.col("entry_type") == "deny") & read)
    can_read = granted & ~denied if deny_aware else F.bool_or(read)
    return acl.groupBy("path", "account").agg(can_read.alias("can_read"))


def has_read_permission(acl: DataFrame) -> DataFrame:
    """Attach ``can_read``: the mask, generic rights expanded, holds a right that implies reading."""
    return acl.withColumn("can_read", masks.grants_any_read(F.col("rights")))


def authorized_groups(
    acl: DataFrame, groups: str | Sequence[str], split: str = ";", deny_aware: bool = True
) -> DataFrame:
    """``(path, groups)``: the configured groups that can read the file, sorted. The list of a path
    is never longer than the configured list."""
    wanted = groups.split(split) if isinstance(groups, str) else list(groups)
    return (
        read_rights(acl.filter(F.col("account").isin(wanted)), deny_aware)
        .filter("can_read")
        .groupBy("path")
        .agg(F.array_sort(F.collect_set("account")).alias("groups"))
    )


def visible_to(
    docs: DataFrame, caller_roles: Sequence[str] | DataFrame, key: str = "path"
) -> DataFrame:
    """Documents that share a role with the caller.

    A list of roles filters the scan. With a table of roles (column ``role``), document keys are
    matched by role and the documents by key; Spark broadcasts the roles while they are few.
    """
    if isinstance(caller_roles, DataFrame):
        keys = (
            docs.select(key, F.explode("roles").alias("role"))
            .join(caller_roles.select("role"), "role", "left_semi")
            .select(key)
            .distinct()
        )
        return docs.join(keys, key, "left_semi")
    wanted = F.array(*map(F.lit, caller_roles)).cast("array<string>")
    return docs.filter(F.arrays_overlap("roles", wanted))
