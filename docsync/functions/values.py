"""Small value rules: version numbers, conditional values, joined lists, info members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 100-ns ticks between 0001-01-01 and 1970-01-01.
EPOCH_TICKS = 621355968000000000


def version_ticks(modified: Column) -> Column:
    """Modification time (TIMESTAMP) as 100-ns ticks since 0001-01-01, to the microsecond."""
    return F.unix_micros(modified) * 10 + F.lit(EPOCH_TICKS)


def condition_met(operand: Column, condition: str, test: str | None) -> Column:
    """``operand`` against ``test``; a null operand meets nothing but ``is_null``.

    Conditions are this engine's own list: eq, ne, contains, matches, is_null.
    """
    if condition == "is_null":
        return operand.isNull()
    met = {
        "eq": lambda: operand == F.lit(test),
        "ne": lambda: operand != F.lit(test),
        "contains": lambda: operand.contains(F.lit(test)),
        "matches": lambda: operand.rlike(test),
    }[condition]()
    return F.coalesce(met, F.lit(False))


def conditional_value(
    value: Column, operand: Column, condition: str, test: str | None, then: Column,
    otherwise: Column | None = None,
) -> Column:
    """``then`` where the condition holds, else ``otherwise`` (default: the value unchanged)."""
    other = value if otherwise is None else otherwise
    return F.when(condition_met(operand, condition, test), then).otherwise(other)


def join_values(values: Column, sep: str = ", ") -> Column:
    """Non-null members joined to one string; null when there is none."""
    present = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.array_join(present, sep))


def info_member(props: Column, member: str) -> Column:
    """Member of a JSON property map, read as text; null when the map lacks it."""
    return F.try_element_at(F.from_json(props, "map<string,string>"), F.lit(member))
