"""Declarative mapping of items to documents: field specs become one projection.

The specs of a file type are read on the driver once; what reaches the executors is a single select
of native expressions. Field stages run in the order job, file, url, content, and a variable set in
one stage can steer the tasks of later fields.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import markup, urls
from docsync.functions.values import conditional_value, info_member
from docsync.schema import FieldSpec, Task, check_specs

# Input columns each kind of source reads.
PROPS, HTML, TEXT, URL = "props", "html", "text", "url"

# The page without comments and scripts: computed once, however many fields are taken from it.
READABLE = "_readable"

# Shape of the values of one document before they become rows.
ROWS = "array<struct<field:string,pos:int,value:string,boost:double>>"

STAGES = (
    ("job",), ("file",), ("url",),
    ("doc_info", "doc_content", "file_content", "page_content"),
)


def job_fields(
    files: DataFrame, doc_type: str | Column, roles: Column, searchable: bool = True
) -> DataFrame:
    """Attach what the run itself knows: document type, searchable flag, folder roles."""
    doc_type = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    return files.withColumns(
        {"doc_type": doc_type, "searchable": F.lit(searchable), "roles": roles}
    )


def _source_value(spec: FieldSpec) -> Column:
    if spec.source in ("job", "file"):
        return F.col(spec.member)
    if spec.source == "url":
        return urls.url_part(F.col(URL), spec.member)
    if spec.source == "doc_info":
        return info_member(F.col(PROPS), spec.member)
    if spec.source == "doc_content":
        return F.col(TEXT)
    if spec.source == "file_content":
        return markup.first_attribute(*_page(spec), spec.member, spec.where, _is_readable(spec))
    if spec.tag.lower() == "html" and not spec.multi:
        return markup.visible_text(F.col(READABLE), is_readable=True)
    if spec.tag.lower() == "body" and not spec.multi and not spec.where:
        return markup.body_text(F.col(READABLE), is_readable=True)
    texts = markup.element_texts(*_page(spec), is_readable=_is_readable(spec), where=spec.where)
    return texts if spec.multi else F.get(texts, F.lit(0))


def _is_readable(spec: FieldSpec) -> bool:
    """Scripts and styles themselves are read from the page as it is."""
    return spec.tag.lower() not in ("script", "style")


def _page(spec: FieldSpec) -> tuple[Column, str]:
    return F.col(READABLE if _is_readable(spec) else HTML), spec.tag


def _prepared(items: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    if any(s.source in ("file_content", "page_content") for s in specs):
        return items.withColumn(READABLE, markup.readable(F.col(HTML)))
    return items


def apply_task(value: Column, task: Task, operand: Column) -> Column:
    """The value after its task: set it, replace what matches the test in it, or clear it."""
    then = {
        "set": lambda: F.lit(task.value),
        "replace": lambda: F.regexp_replace(value, task.test or "", task.value or ""),
        "clear": lambda: F.lit(None),
    }[task.action]()
    return conditional_value(value, operand, task.condition, task.test, then)


def field_columns(specs: Sequence[FieldSpec]) -> tuple[dict[str, Column], dict[str, Column]]:
    """``(fields, variables)``: one Column per name, variables kept apart. A name that several specs
    feed is an array of all their values, in the order of the specs' stages."""
    fields: dict[str, Column] = {}
    fed = Counter(s.field for s in specs)
    variables: dict[str, Column] = {}
    for stage in STAGES:
        for spec in (s for s in specs if s.source in stage):
            value = _source_value(spec)
            for task in spec.tasks:
                operand = (
                    variables[task.operand]
                    if task.operand_source == "variable"
                    else F.col(task.operand)
                )
                if spec.multi:
                    value = F.transform(value, lambda v: apply_task(v, task, operand))
                else:
                    value = apply_task(value, task, operand)
            if fed[spec.field] > 1:
                values = value if spec.multi else F.array(value.cast("string"))
                before = fields.get(spec.field, F.array().cast("array<string>"))
                value = F.filter(F.concat(before, F.coalesce(values, F.array().cast("array<string>"))),
                                 lambda v: v.isNotNull())
            (variables if spec.is_variable else fields)[spec.field] = value
    return fields, variables


def map_fields(items: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """Documents of one file type: one column per stored field, variables dropped, null where a
    field is absent."""
    fields, _ = field_columns(check_specs(specs))
    return _prepared(items, specs).select(*(v.alias(name) for name, v in fields.items()))


def with_variables(items: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """The items with every field *and* variable attached, for inspection of a mapping; drop the
    variables with ``drop_variables`` before storing."""
    fields, variables = field_columns(check_specs(specs))
    return _prepared(items, specs).withColumns({**variables, **fields}).drop(READABLE)


def drop_variables(docs: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """The documents without the columns of variable fields."""
    return docs.drop(*(s.field for s in specs if s.is_variable))


def info_fields(
    docs: DataFrame, members: Mapping[str, str], props: str = PROPS
) -> DataFrame:
    """Attach document-info members (output name -> member name); missing members are null."""
    return docs.withColumns({name: info_member(F.col(props), m) for name, m in members.items()})


def identity_columns(specs: Sequence[FieldSpec]) -> list[str]:
    """Names of the fields that together identify a document, in spec order."""
    return [s.field for s in check_specs(specs) if s.identity]


def identity_key(docs: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """The identity columns of the documents that have all of them; joins use the column list, so
    every identity field must match. Documents lacking one belong in quarantine."""
    keys = identity_columns(specs)
    return docs.select(*keys).dropna(subset=keys)


def to_field_rows(docs: DataFrame, specs: Sequence[FieldSpec], key: str) -> DataFrame:
    """``(doc_key, field, pos, value, boost)``: one row per stored value. Null fields give no row,
    the values of a repeated field are numbered from 0. Boosts come from the specs as literals, so
    there is nothing to join."""

    def row(field: str, pos: Column, value: Column, boost: float) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            pos.cast("int").alias("pos"),
            value.cast("string").alias("value"),
            F.lit(float(boost)).alias("boost"),
        )

    def numbered(spec: FieldSpec):
        return lambda value, i: row(spec.field, i, value, spec.boost)

    types = dict(docs.dtypes)
    groups = []
    for spec in {s.field: s for s in reversed(specs)}.values():
        if spec.is_variable or spec.field not in types:
            continue
        value = F.col(spec.field)
        if types[spec.field].startswith("array"):
            # Positions count stored values only, so nulls go first.
            stored = F.filter(value, lambda v: v.isNotNull())
            rows = F.transform(stored, numbered(spec))
        else:
            rows = F.array(row(spec.field, F.lit(0), value, spec.boost))
        groups.append(F.coalesce(rows, F.array().cast(ROWS)))
    stored = F.filter(F.flatten(F.array(*groups)), lambda r: r["value"].isNotNull())
    return docs.select(F.col(key).cast("string").alias("doc_key"), F.inline(stored))
