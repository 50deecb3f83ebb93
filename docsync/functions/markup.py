"""Extraction from HTML with regular expressions, and a fold over tags where elements nest.

Selectors are single tag names, not XPath. An element ends at its own closing tag, also where elements of
its name lie inside it; paragraphs cannot nest and end at the first closing tag. An element that is
never closed is left out where elements of its name nest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsync.functions.text import decode_entities, normalise_lines

# Parts of a page whose text is never shown.
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = r"(?is)<(?:script(?:\s[^>]*)?>.*?</script|style(?:\s[^>]*)?>.*?</style)\s*>"
ANY_TAG = r"(?s)<[^>]*>"
# Fixed value: an opening tag of these ends an open element of the same name.
NEVER_NESTED = ("p",)


def _tag_name(tag: str) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", tag):
        raise ValueError(f"not a tag name: {tag!r}")
    return tag


def readable(html: Column) -> Column:
    """Markup without comments, scripts and styles, whose text could be mistaken for elements.

    Attach it once where several values are taken from the same page, and pass ``is_readable``.
    """
    return F.regexp_replace(F.regexp_replace(html, COMMENT, ""), HIDDEN, "")


def _markup_for(html: Column, tag: str, is_readable: bool) -> Column:
    if is_readable:
        return html
    if tag.lower() in ("script", "style"):
        return F.regexp_replace(html, COMMENT, "")
    return readable(html)


def strip_tags(html: Column) -> Column:
    """Text between the tags, with nothing put in their place."""
    return F.regexp_replace(html, ANY_TAG, "")


def attribute_of(open_tag: Column, attr: str) -> Column:
    """Raw value of an attribute in one opening tag; null when absent or empty."""
    head = rf"(?is)\s{re.escape(attr)}\s*=\s*"
    return F.coalesce(
        F.nullif(F.regexp_extract(open_tag, head + r'"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(open_tag, head + r"'([^']*)'", 1), F.lit("")),
        F.nullif(F.regexp_extract(open_tag, head + r"""([^\s"'>]+)""", 1), F.lit("")),
    )


def first_attribute(
    html: Column, tag: str, attr: str, where: tuple[str, str] | None = None,
    is_readable: bool = False,
) -> Column:
    """Decoded attribute of the first ``tag`` element, or of the first one whose attribute
    ``where[0]`` equals ``where[1]``. Null when there is no such element or attribute."""
    pattern = rf"(?is)<{_tag_name(tag)}(?:\s[^>]*)?>"
    markup = _markup_for(html, tag, is_readable)
    if where is None:
        open_tag = F.regexp_extract(markup, pattern, 0)
    else:
        tags = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
        open_tag = F.get(
            F.filter(tags, lambda t: decode_entities(attribute_of(t, where[0])) == where[1]), F.lit(0))
    return decode_entities(attribute_of(open_tag, attr))


def _nested(markup: Column, tag: str) -> Column:
    """Array ``(opening, inner)`` of every ``tag`` element in order of the opening tags, each up to its own
    closing tag.

    The markup is cut at the tags of that name; a fold over them keeps the open ones on a stack, and a
    closing tag closes the innermost. Empty tags (``<tag/>``) are elements without inside."""
    pattern = rf"(?is)</?{tag}(?:\s[^>]*)?/?>"
    state = "struct<i:int,open:array<int>,closed:array<struct<first:int,last:int>>>"
    start = F.from_json(F.lit('{"i":0,"open":[],"closed":[]}'), state)

    def step(s: Column, t: Column) -> Column:
        closing, empty = F.startswith(t, F.lit("</")), F.endswith(t, F.lit("/>"))
        innermost = F.get(s["open"], F.size(s["open"]) - 1)
        ended = F.when(empty & ~closing, F.struct(s["i"].alias("first"), s["i"].alias("last")))
        ended = ended.when(closing & innermost.isNotNull(), F.struct(innermost.alias("first"), s["i"].alias("last")))
        left = F.when(empty & ~closing, s["open"]).when(~closing, F.concat(s["open"], F.array(s["i"])))
        left = left.otherwise(F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))))
        closed = F.when(ended.isNotNull(), F.concat(s["closed"], F.array(ended))).otherwise(s["closed"])
        return F.struct((s["i"] + 1).alias("i"), left.alias("open"), closed.alias("closed"))

    tags = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
    between = F.split(markup, pattern, -1)
    found = F.array_sort(F.aggregate(tags, start, step)["closed"])

    def element(e: Column) -> Column:
        # Text, tag, text, ...: what lies between the two tags, tags of the same name included.
        n = e["last"] - e["first"]
        inner = F.zip_with(
            F.slice(between, e["first"] + 2, n), F.concat(F.slice(tags, e["first"] + 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(""))),
            lambda text, t: F.concat(text, F.coalesce(t, F.lit(""))))
        return F.struct(F.get(tags, e["first"]).alias("opening"), F.array_join(inner, "").alias("inner"))

    return F.transform(found, element)


def element_texts(
    html: Column, tag: str, is_readable: bool = False, where: tuple[str, str] | None = None,
) -> Column:
    """Array with the cleaned text of every ``tag`` element, in page order; with ``where`` only of
    those whose attribute ``where[0]`` equals ``where[1]``."""
    tag = _tag_name(tag)
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    markup = _markup_for(html, tag, is_readable)
    opening = lambda x: F.regexp_extract(x, r"(?s)\A<[^>]*>", 0)
    chosen = lambda x: decode_entities(attribute_of(x, where[0])) == where[1]
    if where is None:
        inner = F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))
    else:
        found = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
        inner = F.filter(found, lambda x: chosen(opening(x)))
    if tag.lower() not in NEVER_NESTED:
        # Another opening tag before the closing one: only then are the tags folded.
        nests = F.rlike(markup, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(?:(?!</{tag}\s*>).)*<{tag}(?:\s[^>]*)?>"))
        nested = _nested(markup, tag)
        nested = nested if where is None else F.filter(nested, lambda e: chosen(e["opening"]))
        inner = F.when(nests, F.transform(nested, lambda e: e["inner"])).otherwise(inner)
    return F.transform(inner, lambda x: decode_entities(normalise_lines(strip_tags(x))))


def body_text(html: Column, is_readable: bool = False) -> Column:
    """Text of the body element, up to the last closing tag or the end; null without a body."""
    markup = html if is_readable else readable(html)
    opening = r"(?is)\A.*?<body(?:\s[^>]*)?>"
    inner = F.regexp_replace(F.regexp_replace(markup, opening, ""), r"(?is)</body\s*>(?!.*</body\s*>).*\z", "")
    return F.when(F.rlike(markup, F.lit(r"(?is)<body(?:\s[^>]*)?>")), decode_entities(normalise_lines(strip_tags(inner))))


def visible_text(html: Column, is_readable: bool = False) -> Column:
    """Text of a whole page without scripts, styles and comments."""
    return decode_entities(normalise_lines(strip_tags(html if is_readable else readable(html))))
