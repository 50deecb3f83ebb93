"""File-right bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public access-mask bits of file rights.
READ_DATA = 0x1
WRITE_DATA = 0x2
APPEND_DATA = 0x4
READ_EXTENDED_ATTRIBUTES = 0x8
WRITE_EXTENDED_ATTRIBUTES = 0x10
EXECUTE_FILE = 0x20
DELETE_SUBDIRECTORIES_AND_FILES = 0x40
READ_ATTRIBUTES = 0x80
WRITE_ATTRIBUTES = 0x100
DELETE = 0x10000
READ_PERMISSIONS = 0x20000
CHANGE_PERMISSIONS = 0x40000
TAKE_OWNERSHIP = 0x80000
SYNCHRONIZE = 0x100000
READ = 0x20089
READ_AND_EXECUTE = 0x200A9
MODIFY = 0x301BF
FULL_CONTROL = 0x1F01FF
GENERIC_ALL = 0x10000000
GENERIC_EXECUTE = 0x20000000
GENERIC_WRITE = 0x40000000
GENERIC_READ = 0x80000000

# Each generic right stands for these specific ones.
GENERIC_MEANING = {
    GENERIC_EXECUTE: EXECUTE_FILE | READ_PERMISSIONS | READ_ATTRIBUTES | SYNCHRONIZE,
    GENERIC_READ: (
        READ_ATTRIBUTES | READ_DATA | READ_EXTENDED_ATTRIBUTES | READ_PERMISSIONS | SYNCHRONIZE
    ),
    GENERIC_WRITE: (
        APPEND_DATA | WRITE_ATTRIBUTES | WRITE_DATA | WRITE_EXTENDED_ATTRIBUTES
        | READ_PERMISSIONS | SYNCHRONIZE
    ),
    GENERIC_ALL: FULL_CONTROL,
}

# Holding any of these in full counts as being able to read.
READABLE = (
    READ_DATA, READ, MODIFY, READ_AND_EXECUTE, READ_EXTENDED_ATTRIBUTES, TAKE_OWNERSHIP,
    CHANGE_PERMISSIONS, FULL_CONTROL, DELETE_SUBDIRECTORIES_AND_FILES, DELETE,
)


def _holds(rights: Column, mask: int) -> Column:
    wanted = F.lit(mask).cast("bigint")
    return rights.bitwiseAND(wanted) == wanted


def grants_read_data(rights: Column) -> Column:
    """True when the mask contains the read-data bit."""
    return _holds(rights, READ_DATA)


def specific_rights(rights: Column) -> Column:
    """Generic rights replaced by the specific rights they stand for. A mask that names at least
    one generic right keeps only what those stand for; any other mask is returned unchanged."""
    expanded = F.lit(0).cast("bigint")
    for generic, meaning in GENERIC_MEANING.items():
        part = F.when(_holds(rights, generic), F.lit(meaning)).otherwise(F.lit(0)).cast("bigint")
        expanded = expanded.bitwiseOR(part)
    any_generic = rights.bitwiseAND(F.lit(sum(GENERIC_MEANING)).cast("bigint")) != 0
    return F.when(any_generic, expanded).otherwise(rights)


def grants_any_read(rights: Column) -> Column:
    """True when, after expansion, at least one of ``READABLE`` is held in full."""
    specific = specific_rights(rights)
    granted = F.lit(False)
    for mask in READABLE:
        granted = granted | _holds(specific, mask)
    return granted
