"""Columns that build and take apart URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output column -> part name of Spark's parse_url.
URL_PARTS = {
    "scheme": "PROTOCOL",
    "host": "HOST",
    "path": "PATH",
    "query": "QUERY",
    "fragment": "REF",
    "authority": "AUTHORITY",
}


def url_part(url: Column, part: str) -> Column:
    """One part of a URL; null for a missing part and for text that is no URL."""
    return F.try_parse_url(url, F.lit(URL_PARTS[part]))


def percent_encode(path: Column) -> Column:
    """Percent-encode the UTF-8 bytes of a path, keeping slashes and the unreserved characters.

    ``url_encode`` is form encoding; the replacements turn its output into path encoding.
    """
    encoded = F.url_encode(path)
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(percent))
    return encoded


def url_below(base_url: Column, root: Column, path: Column) -> Column:
    """URL of a file: the path below ``root``, percent-encoded, appended to ``base_url``; null for a
    path that is not below it."""
    root = F.regexp_replace(root, r"/+\z", "")
    relative = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))
    return F.concat(F.regexp_replace(base_url, r"/+\z", ""), F.lit("/"), percent_encode(relative))
