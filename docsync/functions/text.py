"""Text clean-up and tokenising."""

from __future__ import annotations

import html.entities
import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a line is trimmed.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Named entities, from the table of the HTML standard that comes with Python; names end in ";".
NAMED = {name: char for name, char in html.entities.html5.items() if name.endswith(";")}
# Names are looked up in one of so many short lists, chosen by a checksum of the name.
NAME_LISTS = 1024

# Fixed value: terms are maximal runs of letters and digits.
TERM_BREAK = r"[^\p{L}\p{N}]+"


def trim_white_space(value: Column) -> Column:
    """Strip Unicode white space at both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalise_lines(value: Column) -> Column:
    """Remove CR, trim every line, drop blank lines, join the rest with LF."""
    lines = F.split(F.replace(value, F.lit("\r"), F.lit("")), "\n")
    return F.array_join(F.filter(F.transform(lines, trim_white_space), lambda l: l != ""), "\n")


def _numbered(digits: Column, base: int) -> Column:
    """The character of a code point given in decimal or hexadecimal digits; null when there is none."""
    code = F.conv(digits, base, 10).cast("decimal(20,0)")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    packed = F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0"))
    return F.when(valid, F.decode(F.when(valid, packed), "UTF-32"))


def decode_entities(value: Column) -> Column:
    """Decode every numeric HTML entity and every named one that ends in a semicolon, each once
    (``&amp;lt;`` gives ``&lt;``), with native expressions. Unknown entities stay as they are.

    The text is cut at ``&``, so only texts and parts that have one are worked on.
    """
    listed = [""] * NAME_LISTS
    for name, char in NAMED.items():
        listed[zlib.crc32(name[:-1].encode()) % NAME_LISTS] += f"\x02{name[:-1]}\x03{char:\x04<2}"
    # A literal text that Spark cuts into an array once, before the query runs.
    lists = F.split(F.lit("\x01".join(listed)), "\x01", -1)

    def named(entity: Column) -> Column:
        """The one or two characters that stand behind a name in its list."""
        names = F.get(lists, (F.crc32(entity.cast("binary")) % NAME_LISTS).cast("int"))
        at = F.instr(names, F.concat(F.lit("\x02"), entity, F.lit("\x03")))
        return F.when(at > 0, F.replace(F.substr(names, at + F.length(entity) + 2, F.lit(2)), F.lit("\x04"), F.lit("")))

    # Each step is a pass of its own, as what a pass makes is not made again by the next.
    def cut(p: Column, i: Column) -> Column:
        entity = F.regexp_extract(p, r"\A(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.struct(F.when(i > 0, entity).otherwise("").alias("entity"), p.alias("part"), (i == 0).alias("first"))

    def char_of(c: Column) -> Column:
        entity = c["entity"]
        char = (
            F.when(entity == "", F.lit(None).cast("string"))
            .when(~F.startswith(entity, F.lit("#")), named(entity))
            .when(F.startswith(F.lower(entity), F.lit("#x")), _numbered(F.substr(entity, F.lit(3)), 16))
            .otherwise(_numbered(F.substr(entity, F.lit(2)), 10))
        )
        return F.struct(char.alias("char"), F.length(entity).alias("n"), c["part"].alias("part"), c["first"].alias("first"))

    def joined(c: Column) -> Column:
        decoded = F.concat(c["char"], F.substr(c["part"], c["n"] + 2))
        return F.when(c["first"], c["part"]).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), c["part"])))

    parts = F.transform(F.transform(F.split(value, "&", -1), cut), char_of)
    decoded = F.array_join(F.transform(parts, joined), "")
    return F.when(F.contains(value, F.lit("&")), decoded).otherwise(value)


def tokenize(value: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased terms of a text in order, without stop words (none by default).

    The tokeniser is this engine's own definition: letters and digits make terms, everything
    else separates them, no stemming.
    """
    terms = F.split(F.lower(value), TERM_BREAK)
    if stop_words:
        return F.filter(terms, lambda t: (t != "") & ~t.isin(list(stop_words)))
    return F.filter(terms, lambda t: t != "")
