"""Quality classifier: supervised subword embeddings.

A document is the sum of three averages of learned vectors, all from one hashed table: of its words
(each the average of its own vector and those of its character n-grams), of its word pairs, and of
pairs of repetition marks, which say for each word how long ago the document had it last. A softmax
over that vector gives the score. Table and softmax are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import (
    as_bytes, checked_broadcast, column, labelled_sample, releasing, scramble, small_batches,
)

BUCKETS_LOG2 = 15
DIMENSIONS = 16
GRAMS = (3, 4)
# Labelled rows to learn from, per label.
PER_CLASS = 2_000
# Documents seen in training; a small sample is gone through more often.
STEPS = 40_000
RATE = 0.1
SEED = 5
# Words scored together, and new words whose vectors are made together; they bound a task's memory.
PART, NEW_WORDS = 1 << 16, 1 << 13
# Words, and bytes of words, that a task remembers.
KNOWN_WORDS, KNOWN_BYTES = 1 << 17, 1 << 21
THRESHOLD = 0.7
_MASK = np.uint64((1 << BUCKETS_LOG2) - 1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, starts, hashes)``: for each word, from its start on, the buckets of the word itself
    and of its character n-grams, with marks for its ends; and the hash of each word."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, buckets = [np.arange(len(words))], [hashes & _MASK]
    for n in GRAMS:
        # An n-gram belongs to the word in which it begins and ends.
        begin = np.flatnonzero(np.arange(len(text)) + n <= ends[owner])
        code = np.full(len(begin), n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | text[begin + i]
        owners.append(owner[begin])
        buckets.append(scramble(scramble(code)) & _MASK)
    owners, buckets = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(words))), hashes


def pair_features(hashes: np.ndarray) -> np.ndarray:
    return (scramble(scramble(hashes[:-1]) + hashes[1:]) & _MASK).astype(np.int64)


def repetition_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of pairs of marks. The mark of a word is 0 when it is new to the document, else one
    more than the number of binary digits of the distance to its last place."""
    order = np.argsort(hashes, kind="stable")
    back = np.zeros(len(hashes), np.int64)
    again = hashes[order[1:]] == hashes[order[:-1]]
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    marks = np.where(back > 0, 2 + np.log2(np.maximum(back, 1)).astype(np.int64), 0)
    pairs = marks[:-1] * 64 + marks[1:] if len(marks) > 1 else marks
    return (scramble(pairs.astype(np.uint64) + np.uint64(1 << 40)) & _MASK).astype(np.int64)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their weights, so that a vector is their weighted sum."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    place: dict[bytes, int] = {}
    rows = np.array([place.setdefault(w, len(place)) for w in words])
    buckets, starts, hashes = word_features(list(place))
    sizes = np.diff(np.append(starts, len(buckets)))
    shares = np.bincount(rows) / sizes / len(words)
    total = np.bincount(buckets, np.repeat(shares, sizes), minlength=1 << BUCKETS_LOG2)
    hashes = hashes[rows]
    for group in (pair_features(hashes), repetition_features(hashes)):
        if len(group):
            total += np.bincount(group, minlength=len(total)) / len(group)
    used = np.flatnonzero(total)
    return used, total[used]


class Model:
    """The hashed table and the softmax weights."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.table, self.weights, self.bias = table, weights, bias

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain arrays: what travels in a broadcast may not need this package to be read."""
        return self.table, self.weights, self.bias

    def score(self, vector: np.ndarray) -> float:
        """Probability of label 1."""
        logits = vector @ self.weights + self.bias
        return float(1 / (1 + np.exp(min(max(logits[0] - logits[1], -50.0), 50.0))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], totals: dict[int, int]) -> Model:
    """Stochastic gradient descent, one document at a time. The sample has other shares of the labels
    than the labelled rows; the bias takes that difference back. Without examples of both labels the
    model knows the shares only."""
    random = np.random.default_rng(SEED)
    table = random.uniform(-1, 1, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    counts = np.bincount([e[2] for e in examples], minlength=2)
    epochs = max(1, STEPS // len(examples)) if counts.all() else 0
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            used, shares, label = examples[i]
            rate = RATE * (1 - done / steps)
            done += 1
            shares = shares.astype(np.float32)
            vector = shares @ table[used]
            logits = vector @ weights + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            # Both labels weigh alike, whatever their number in the sample.
            error *= rate * len(examples) / (2 * counts[label])
            table[used] -= shares[:, None] * (weights @ error)
            weights -= np.outer(vector, error)
            bias -= error
    shares = np.array([totals.get(0, 0) + 1, totals.get(1, 0) + 1], float)
    return Model(table, weights, bias + np.log(shares / shares.sum()).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], label: str = "quality",
        per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``per_class`` rows of each label, by ``learn`` of their ids. Tasks make the
    features; the driver gets at most ``2 * per_class`` sparse rows of at most one entry per bucket."""
    small_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, learn, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_features(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u.astype(np.uint16).tobytes() for u, _ in found], pa.binary()),
                 pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary()),
                 column(batch, "label"), column(batch, "key")], names=["used", "shares", "label", "key"],
            )

    rows = sample.select(as_bytes(F.col("text")).alias("text"), "label", F.xxhash64("text").alias("key"))
    table = rows.mapInArrow(run, "used binary, shares binary, label int, key long").toArrow().sort_by("key")
    examples = [
        (np.frombuffer(u, np.uint16).astype(np.int64), np.frombuffer(s, np.float32), label)
        for u, s, label in zip(*(table[c].to_pylist() for c in ("used", "shares", "label")))
    ]
    return train(examples, totals)


class Scorer:
    """Scores texts by one model; words that come again are looked up as whole vectors."""

    def __init__(self, model: Model):
        self.model, self.rows, self.bytes = model, {}, 0
        self.vectors = np.empty((1024, DIMENSIONS), np.float32)
        self.hashes = np.empty(1024, np.uint64)

    def learn(self, words: list[bytes]) -> None:
        """Vectors of new words, many at a time."""
        first, need = len(self.rows), len(self.rows) + len(words)
        if need > len(self.vectors):
            more = max(need, 2 * len(self.vectors)) - len(self.vectors)
            self.vectors = np.concatenate((self.vectors, np.empty((more, DIMENSIONS), np.float32)))
            self.hashes = np.concatenate((self.hashes, np.empty(more, np.uint64)))
        buckets, starts, self.hashes[first:need] = word_features(words)
        sizes = np.diff(np.append(starts, len(buckets)))
        self.vectors[first:need] = np.add.reduceat(self.model.table[buckets], starts) / sizes[:, None]
        self.rows.update(zip(words, range(first, need)))
        self.bytes += sum(map(len, words))

    def scores(self, texts: list[bytes]) -> list[float]:
        """Scores of texts, taken together in parts of bounded size."""
        found, part, size = [], [], 0
        for text in texts:
            part.append(text.split())
            size += len(part[-1])
            if size >= PART:
                found += self._scores(part)
                part, size = [], 0
        return found + self._scores(part)

    def _scores(self, texts: list[list[bytes]]) -> list[float]:
        if len(self.rows) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self.rows.clear()
            self.bytes = 0
        new = list(set().union(*texts).difference(self.rows))
        for start in range(0, len(new), NEW_WORDS):
            self.learn(new[start:start + NEW_WORDS])
        return [self._score(words) for words in texts]

    def _score(self, words: list[bytes]) -> float:
        if not words:
            return self.model.score(np.zeros(DIMENSIONS, np.float32))
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        hashes, table = self.hashes[rows], self.model.table
        vector = self.vectors[rows].mean(axis=0, dtype=float)
        for group in (pair_features(hashes), repetition_features(hashes)):
            if len(group):
                vector += table[group].mean(axis=0, dtype=float)
        return self.model.score(vector)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text: the probability of label 1.

    Null and empty texts get the score of a text without words, which follows from the shares of the
    labels. Each row is scored by itself: repeated rows get equal scores, null ids and skew do not
    matter, an empty table gives an empty table, and other columns are not read. Broadcast: the
    model, of fixed size.
    """
    shared = checked_broadcast(docs.sparkSession, model.parts(), model.table.nbytes, 1 << 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            scores = scorer.scores(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(lambda b: releasing(run(b)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    shared = checked_broadcast(docs.sparkSession, model.parts(), model.table.nbytes, 1 << 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            texts = column(batch, text_col).cast(pa.binary()).to_pylist()
            scores = scorer.scores([t or b"" for t in texts])
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(lambda b: releasing(run(b)), docs.schema)
