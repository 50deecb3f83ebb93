"""Row types of the configuration tables and the checks made before any job runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple

SOURCES = (
    "job", "file", "url", "doc_info", "doc_content", "file_content", "page_content",
)
ANALYZERS = ("keyword", "standard", "standard_stop")
CONDITIONS = ("eq", "ne", "contains", "matches", "is_null")
ACTIONS = ("set", "replace", "clear")
CHANGE_KINDS = ("created", "changed", "deleted")

FILES = "path string, name string, dir string, ext string, length bigint, modified timestamp"
FILE_TYPES = "file_type string, ext string"
DISPATCH = "file_type string, action string, handler string"
ROLE_CONF = "dir string, allow string, deny string"
CHANGE_EVENTS = (
    "event_id bigint, ts timestamp, web string, path string, is_dir boolean, change_type string"
)
CLAUSES = "clause_id string, field string, term string, occur string, boost double"


class Task(NamedTuple):
    """Change a value when an operand meets a condition.

    ``operand_source`` is ``job`` (an input column) or ``variable`` (an earlier variable field).
    """

    operand_source: str
    operand: str
    condition: str
    test: str | None = None
    action: str = "set"
    value: str | None = None


class FieldSpec(NamedTuple):
    """One field of the documents of one file type."""

    file_type: str
    field: str
    source: str
    member: str | None = None
    tag: str | None = None
    identity: bool = False
    is_variable: bool = False
    analyzer: str = "standard"
    boost: float = 1.0
    multi: bool = False
    # One task, or several that apply one after the other.
    task: Task | Sequence[Task] | None = None
    # Attribute test (name, value) for sources that read elements of a page.
    where: tuple[str, str] | None = None

    @property
    def tasks(self) -> list[Task]:
        if self.task is None:
            return []
        return [self.task] if isinstance(self.task, Task) else list(self.task)


class Clause(NamedTuple):
    """One term of a boolean query. ``occur`` is ``must`` or ``should``."""

    clause_id: str
    field: str
    term: str
    occur: str = "must"
    boost: float = 1.0


def _one_of(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} {value!r} is not one of {', '.join(allowed)}")


def _unique(keys: Iterable[object], what: str) -> None:
    twice = [key for key, n in Counter(keys).items() if n > 1]
    if twice:
        raise ValueError(f"{what} must be unique, repeated: {twice}")


def check_specs(specs: Sequence[FieldSpec]) -> list[FieldSpec]:
    """Field specs of one file type, checked: known words, a usable identity. Several specs may feed
    one stored field, which then has several values; variables and identities have one spec."""
    single = {s.field for s in specs if s.identity or s.is_variable}
    _unique([s.field for s in specs if s.field in single], "field name")
    known: set[str] = set()
    for stage in (("job",), ("file",), ("url",), SOURCES[3:]):
        for spec in (s for s in specs if s.source in stage):
            for task in spec.tasks:
                if task.operand_source == "variable" and task.operand not in known:
                    raise ValueError(f"{spec.field}: variable {task.operand!r} is not set yet")
            if spec.is_variable:
                known.add(spec.field)
    for spec in specs:
        _one_of(spec.source, SOURCES, "source")
        _one_of(spec.analyzer, ANALYZERS, "analyzer")
        for task in spec.tasks:
            _one_of(task.operand_source, ("job", "variable"), "operand source")
            _one_of(task.condition, CONDITIONS, "condition")
            _one_of(task.action, ACTIONS, "action")
        if spec.where and spec.source not in ("file_content", "page_content"):
            raise ValueError(f"{spec.field}: only elements of a page have attributes to test")
        if spec.identity and (spec.is_variable or spec.multi):
            raise ValueError(f"{spec.field}: an identity field is stored and has one value")
    if not any(s.identity for s in specs):
        raise ValueError("at least one field must be marked identity")
    return list(specs)


def check_file_types(rows: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(file_type, ext) rows with one owner per lower-cased extension."""
    rows = [(file_type, ext.lower().lstrip(".")) for file_type, ext in rows]
    _unique([ext for _, ext in rows], "extension")
    return rows


def check_dispatch(rows: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(file_type, action, handler) rows with one handler per file type and action."""
    _unique([(file_type, action) for file_type, action, _ in rows], "file type and action")
    for _, action, _ in rows:
        _one_of(action, CHANGE_KINDS, "action")
    return list(rows)


def check_role_conf(rows: Sequence[tuple]) -> list[tuple]:
    """(dir, allow, deny) rows, one per folder."""
    _unique([row[0] for row in rows], "folder")
    return list(rows)


def check_clauses(clauses: Sequence[Clause]) -> list[Clause]:
    """Clauses with unique ids and known occurrence words."""
    _unique([c.clause_id for c in clauses], "clause id")
    for clause in clauses:
        _one_of(clause.occur, ("must", "should"), "occur")
    return list(clauses)
