"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1, drawn from its code point. The vector of three
adjacent letters binds (multiplies) the letters' vectors, each permuted (rotated) by its place. A
text bundles (adds) the vectors of its letter triples, word ends included; a language bundles its
learning texts. A text gets the language whose bundle has the largest cosine to its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import column, small_batches

DIMENSIONS = 512
SEED = 6
UNKNOWN = "und"
# Cosine differences are small; this turns them into a score by softmax.
SHARPNESS = 40.0
# A worker keeps the vectors of this many triples (512 floats each); others are made when met.
MAX_TRIPLES = 16_384
MAX_LANGUAGES = 4_096
_SPACE = 0x20


class Encoder:
    """Bundles texts, from vectors that depend on seed and code points only."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        vector = self.letters.get(code)
        if vector is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions)
            vector = (2 * bits - 1).astype(np.float32)
            if len(self.letters) < MAX_TRIPLES:
                self.letters[code] = vector
        return vector

    def triple(self, key: int) -> np.ndarray:
        first, second, third = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)

    def triples(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Packed letter triples of a text and their counts; everything that is not a letter is
        one space, and a triple of which the middle is a space says nothing and is left out."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes = np.where(_letters(codes), codes, _SPACE)
        codes = np.concatenate(([_SPACE], codes, [_SPACE]))
        codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
        if len(codes) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        return np.unique(keys[codes[1:-1] != _SPACE], return_counts=True)

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of the triple vectors of a text; whole numbers, exact in any order. None without letters."""
        keys, counts = self.triples(text)
        if not len(keys):
            return None
        total = np.zeros(self.dimensions)
        known, weights = [], []
        for key, count in zip(keys.tolist(), counts.tolist()):
            row = self.rows.get(key)
            if row is None:
                if len(self.rows) >= MAX_TRIPLES:
                    total += count * self.triple(key)
                    continue
                row = self.rows[key] = len(self.rows)
                if row >= len(self.vectors):
                    more = np.empty((max(1024, row), self.dimensions), np.float32)
                    self.vectors = np.concatenate((self.vectors, more))
                self.vectors[row] = self.triple(key)
            known.append(row)
            weights.append(count)
        # Whole numbers below 2**24 are exact in single precision; longer sums are cut into parts.
        weights = np.array(weights, np.float32)
        if weights.sum() < 1 << 24:
            return total + weights @ self.vectors[known]
        return total + weights.astype(float) @ self.vectors[known].astype(float)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters. Common scripts by ranges of the standard, others by asking."""
    found = ((codes >= 97) & (codes <= 122)) | (
        (codes >= 0xC0) & (codes <= 0x24F) & (codes != 0xD7) & (codes != 0xF7))
    rest = codes >= 0x250
    for i in (0xAA, 0xB5, 0xBA):
        found |= codes == i
    if rest.any():
        distinct, place = np.unique(codes[rest], return_inverse=True)
        found[rest] = np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in distinct])[place]
    return found


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Language bundles from all rows of ``(text, lang)``: each task bundles its own texts and emits
    one vector per language, Spark adds the vectors, and the driver gets one vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist()):
                bundle = encoder.bundle(text)
                if bundle is not None:
                    sums[lang] = sums.get(lang, 0) + bundle
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"],
        )

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, bundle array<double>")
    total = (
        parts.select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("bundle"))
        .select("lang", F.col("bundle.value").alias("bundle"))
    )
    found = sorted((r.lang, r.bundle) for r in total.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [lang for lang, _ in found], np.array([v for _, v in found]).reshape(-1, dimensions)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text, learned from the rows where ``learn``
    holds and text and language are not null.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when no
    language was learned. Equal cosines go to the first language by name. Ids may be null or
    repeated: each row is judged by itself. An empty table gives an empty table. Other columns are
    not read. Broadcast: one vector per language, at most ``MAX_LANGUAGES``.
    """
    small_batches(docs.sparkSession)
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    learning = docs.where(learn & text.isNotNull() & lang.isNotNull()).select(text.alias("text"), lang.alias("lang"))
    names, bundles = fit(learning, dimensions, seed)
    lengths = np.linalg.norm(bundles, axis=1, keepdims=True)
    profiles = np.divide(bundles, lengths, out=np.zeros_like(bundles), where=lengths > 0).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions, seed)
        for batch in batches:
            best, scores = [], []
            for t in column(batch, "text").to_pylist():
                bundle = encoder.bundle(t) if t and names else None
                length = 0.0 if bundle is None else np.linalg.norm(bundle)
                if not length:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = bundle @ profiles / length
                i = int(np.argmax(cosines))
                best.append(names[i])
                scores.append(float(1 / np.exp(SHARPNESS * (cosines - cosines[i])).sum()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
