"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces as the vocabulary's library cuts it, and the symbols of a piece are
merged: a heap gives the adjacent pair of lowest rank (leftmost first), a linked list of symbols
lets a merge touch its two neighbours only. A piece counts as its initial symbols (bytes) minus its
merges; no identifiers are made. Pieces that come again are counted from a bounded memo.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import as_bytes, checked_broadcast, column, small_batches

LIMIT = 1024
# Pieces are dear to count, so their memo is larger than that of words.
MEMO = 1 << 19
# A vocabulary file with more merges than this is not a vocabulary.
MAX_MERGES = 1_000_000
# Fixed value: the published pattern that cuts a text before the merges of this vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same cuts at white space alone: each such run can be cut and counted by itself.
RUNS = r" ?\S+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The letter by which the vocabulary file writes each byte: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of the merges, and the special strings, of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
    return {pair: i for i, pair in enumerate(merges)}, [t["content"] for t in stored["added_tokens"]]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when no adjacent pair can be merged any more."""
    n = len(symbols)
    token: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(token, token[1:])) if pair in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if token[i] != left or j >= n or token[j] != right:
            continue  # one of the two has merged meanwhile
        token[i], token[j] = left + right, None
        after[i] = following = after[j]
        merges += 1
        if following < n:
            before[following] = i
            if (rank := ranks.get((token[i], token[following]))) is not None:
                heapq.heappush(heap, (rank, i, token[i], token[following]))
        if (previous := before[i]) >= 0 and (rank := ranks.get((token[previous], token[i]))) is not None:
            heapq.heappush(heap, (rank, previous, token[previous], token[i]))
    return n - merges


class Counter:
    """Counts the tokens of texts by one vocabulary."""

    def __init__(self, ranks: dict[tuple[str, str], int], special: list[str]):
        self.ranks, self.symbols = ranks, byte_symbols()
        self.pieces, self.runs = regex.compile(PIECES), regex.compile(RUNS)
        longest_first = sorted(filter(None, special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.known: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        return merged_length([self.symbols[b] for b in piece.encode()], self.ranks)

    def run(self, run: str) -> int:
        count = sum(map(self.piece, self.pieces.findall(run)))
        if len(run) <= 64:
            self.known[run] = count
        return count

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for run in self.runs.findall(text):
            count = known.get(run)
            total += self.run(run) if count is None else count
        return total

    def text(self, text: str) -> int:
        """A special string inside a text is one token; what lies between is cut by itself."""
        if len(self.known) > MEMO:
            self.known.clear()
        if not self.special:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeated: each row is counted
    by itself, in its own task, with no shuffle. An empty table gives an empty table. Other columns
    are not read. ``vocabulary`` is the path of a byte-level vocabulary file, read on the driver;
    its merges (checked against a fixed bound) are the only thing broadcast.
    """
    small_batches(docs.sparkSession)
    ranks, special = read_vocabulary(vocabulary)
    shared = checked_broadcast(docs.sparkSession, (ranks, special), len(ranks), MAX_MERGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            counts = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"),
        F.octet_length(as_bytes(F.col(f"`{text_col}`"))).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
