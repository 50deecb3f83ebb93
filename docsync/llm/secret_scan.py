"""Secret scans: three plain patterns, and sliding-window entropy over candidate strings.

A candidate is a long run of key characters that mixes letters and digits. Each of its character
classes has a window length and an entropy limit; the window slides one character at a time, and
its entropy comes from counts that change by one character in and one out. Windows at or above the
limit are joined to spans. An allow list takes back what is known to be harmless: identifiers in
the common dashed form, checksums and fingerprints that say so, published example keys.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import column, small_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']}}}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Class of a candidate: its characters, the window, and the bits per character that are suspicious.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f-]+\Z"), 20, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 20, 3.9),
)
# Allow list: dashed identifiers, published example keys, checksums announced just before.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z|.*EXAMPLE", re.DOTALL
)
ANNOUNCED = re.compile(
    r"(sha-?\d*|md5|checksum|digest|fingerprint|commit|revision|uuid|guid)\W{0,4}\Z", re.IGNORECASE
)
_REPLACED = "[secret]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the three patterns, leftmost and non-overlapping per kind; the
    failing matches are dropped after matching, so they still use up their text."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _LONG_HEX.search(text):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def suspicious(candidate: str, window: int, limit: float) -> list[tuple[int, int]]:
    """Joined windows whose Shannon entropy, kept up by incremental counts, reaches the limit."""
    weighted = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        total += weighted[n + 1] - weighted[n]
        counts[c] = n + 1
        start = i - window + 1
        if start < 0:
            continue
        if math.log2(window) - total / window >= limit - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
        gone = candidate[start]
        n = counts[gone]
        total += weighted[n - 1] - weighted[n]
        counts[gone] = n - 1
    return spans


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of high entropy in candidates that mix letters and digits and are not allowed."""
    found = []
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        digits = sum(c.isdigit() for c in candidate)
        if not digits or not any(c.isalpha() for c in candidate):
            continue
        if ALLOWED.match(candidate) or ANNOUNCED.search(text[max(0, m.start() - 20):m.start()]):
            continue
        _, _, window, limit = next(k for k in CLASSES if k[1].match(candidate))
        found += [("entropy", m.start() + a, m.start() + b) for a, b in suspicious(candidate, window, limit)]
    return found


def covered(span: tuple[str, int, int], base: list[tuple[str, int, int]]) -> bool:
    """Whether base spans, which come in order, cover every character of a span."""
    done = span[1]
    for _, start, end in base:
        if start <= done:
            done = max(done, end)
    return done >= span[2]


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones stay, entropy ones are added whole unless base spans cover
    all of them, so the rest of a token that a base span covers in part is found too."""
    base = base_spans(text)
    added = [s for s in entropy_spans(text) if not covered(s, base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = _REPLACED) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    parts, done = [], 0
    i = 0
    while i < len(spans):
        start, end = spans[i][1:]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[done:start], mark]
        done = end
    return "".join([*parts, text[done:]])


_FOUND = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)`` of every whole text.

    Positions are code points, ends exclusive. Null and empty texts have no spans: counts 0, empty
    ``spans``, the hash of the empty string. Every row is scanned by itself in its own task, so
    null or repeated ids and skew do not matter; an empty table gives an empty table, and other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in column(batch, "text").to_pylist():
                base, spans = scan_text(text)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every secret in the text replaced by a mark; null texts stay null.
    All rows and all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = [t and redacted(t, scan_text(t)[1]) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``redact`` for documents, whose column of text lengths, if there is one, follows the text."""
    done = redact(docs, text_col)
    if chars_col in docs.columns:
        length = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast(docs.schema[chars_col].dataType)
        done = done.withColumn(chars_col, length)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
