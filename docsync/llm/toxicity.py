"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexical transducer: insults by a learned tree of word stems with weights,
threats, targets, negations and words of reporting by the lists below. Small transducers over those
symbols, composed into one machine, rewrite a clause: an insult becomes negated, reported or
targeted, a threat counts where it meets a target. Each clause yields the weights of its rewritten
insults and threats; a logistic model over these sums, not over isolated words, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import MEMO, checked_broadcast, column, labelled_sample, small_batches

# Word lists of the grammar, in four languages: a choice of this operator, not taken from anywhere.
THREATS = """kill hurt destroy beat punch stab shoot töten schlagen vernichten tuer frapper détruire
matar golpear destruir""".split()
TARGETS = """you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre ti
usted ustedes vosotros""".split()
NEGATIONS = """not no never nobody none neither nor nicht kein keine niemals ne pas jamais aucun nunca
ningún ninguna jamás""".split()
REPORTS = """said says say told claimed claims called wrote asked sagte sagt behauptet schrieb dit
disait affirme écrit dijo dice afirma escribió""".split()

# Labelled rows to learn from, per label; prefixes of words that may be stems; stems kept.
PER_CLASS = 4_000
STEMS = (4, 5, 6, 7, 8)
MAX_STEMS = 5_000
# A stem's share of toxic texts is pulled towards a half by so many texts; weights below the least
# one are dropped.
PULL, LEAST_WEIGHT = 6.0, 1.5
# Words between a negation and its insult, between a target and its insult or threat.
REACH = 3
KINDS = ("plain", "negated", "reported", "targeted", "threat")
# Where the logistic fit starts, and what it is pulled to: bias, then one weight per kind.
PRIOR = np.array([-3.0, 1.2, 0.6, 0.6, 1.4, 1.0])

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"""[^\W\d_]+|[.!?;:,|\n]|["“”„«»]""")


class Transducer:
    """A finite-state machine that reads symbols and writes one symbol for each. ``arcs`` has the
    next state and the written symbol by state and read symbol; a missing arc copies the symbol and
    leads to ``other(state)``."""

    def __init__(self, start, arcs: dict, other: Callable = lambda state: state):
        self.start, self.arcs, self.other = start, arcs, other

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (self.other(state), symbol)

    def compose(self, after: "Transducer", symbols: set[str]) -> "Transducer":
        """The machine that feeds this one's output into ``after``, as one table over ``symbols``."""
        start = (self.start, after.start)
        arcs, open_states = {}, [start]
        seen = {start}
        while open_states:
            state = open_states.pop()
            for symbol in symbols:
                first, written = self.step(state[0], symbol)
                second, written = after.step(state[1], written)
                arcs[state, symbol] = ((first, second), written)
                if (first, second) not in seen:
                    seen.add((first, second))
                    open_states.append((first, second))
        return Transducer(start, arcs)


def grammar() -> Transducer:
    """Symbols read: I insult, V threat, T target, N negation, R report, Q quote, O other word, and
    ``#``, the end of a clause. Written in addition: n, r, t for a negated, reported and targeted
    insult, v for a threat to a target."""
    fades = lambda state: max(0, state - 1)
    read = {"I", "V", "T", "N", "R", "Q", "O", "#"}
    near = range(REACH + 1)
    negation = Transducer(0, {
        **{(s, "N"): (REACH, "N") for s in near}, **{(s, "#"): (0, "#") for s in near},
        **{(s, "I"): (0, "n") for s in near if s},
    }, fades)
    # States: 0 outside, 1 after a report in this clause, 2 inside quotes.
    reported = Transducer(0, {
        (0, "R"): (1, "R"), (1, "#"): (0, "#"), (0, "Q"): (2, "Q"), (1, "Q"): (2, "Q"), (2, "Q"): (0, "Q"),
        **{(s, i): (s, "r") for s in (1, 2) for i in ("I", "n")},
    })
    target = Transducer(0, {
        **{(s, "T"): (REACH, "T") for s in near}, **{(s, "#"): (0, "#") for s in near},
        **{(s, "I"): (s - 1, "t") for s in near if s},
    }, fades)
    threat = Transducer(0, {
        **{(s, "V"): (REACH, "V") for s in near}, **{(s, "#"): (0, "#") for s in near},
        **{(s, "T"): (0, "v") for s in near if s},
    }, fades)
    written = read | {"n", "r", "t", "v"}
    machine = negation.compose(reported, read)
    machine = machine.compose(target, written)
    return machine.compose(threat, written)


def stems_of(word: str) -> list[str]:
    """Candidate stems of a word: its prefixes, and the whole word with an end mark."""
    return [word + "$"] + [word[:n] for n in STEMS if len(word) > n]


class Scorer:
    """Clause weights of texts, by a learned tree of stems."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.machine = weights, grammar()
        self.lists = {w: s for s, words in (("V", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
        self.known: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Largest weight on the word's path through the tree of stems, 0 when there is none."""
        weight = max((self.weights.get(s, 0.0) for s in stems_of(word)), default=0.0)
        if len(word) <= 64:
            self.known[word] = weight
        return weight

    def symbol(self, token: str) -> tuple[str, float]:
        if token in '"“”„«»':
            return "Q", 0.0
        if not token[0].isalpha():
            return "#", 0.0
        weight = self.insult(token)
        return ("I", weight) if weight else (self.lists.get(token, "O"), 0.0)

    def clauses(self, text: str) -> np.ndarray:
        """Damped sums over the clauses of a text, by kind of match."""
        if len(self.known) > MEMO:
            self.known.clear()
        sums, known = np.zeros(len(KINDS)), self.known
        lowered = text.lower()
        for word in (words := _WORD.findall(lowered)):
            if known[word] if word in known else self.insult(word):
                break
        else:
            if not any(w in words for w in THREATS):
                return sums
        state, kinds = self.machine.start, {"I": 0, "n": 1, "r": 2, "t": 3, "v": 4}
        for token in _TOKEN.findall(lowered):
            symbol, weight = self.symbol(token)
            state, written = self.machine.step(state, symbol)
            if written in kinds:
                sums[kinds[written]] += weight or 1.0
        return np.log1p(sums)


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Weights of stems: log odds of toxic against other texts that have the stem, both labels
    weighing alike and pulled towards even odds. Texts are counted once per stem, first in each
    batch; the driver gets at most ``MAX_STEMS`` stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
                words = set(_WORD.findall(text.lower()))
                counts.update((s, label) for s in {s for w in words if len(w) <= 64 for s in stems_of(w)})
            stems, labels = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["stem", "label", "n"],
            )

    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return {}
    n = [F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)) for v in (0, 1)]
    # Other texts count as if there were as many of them as toxic ones.
    found = sample.mapInArrow(run, "stem string, label int, n long").groupBy("stem").agg(
        (n[0] * (totals[1] / totals[0])).alias("other"), n[1].alias("toxic"))
    weight = F.log((F.col("toxic") + PULL / 2) / (F.col("other") + PULL / 2))
    kept = found.withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    rows = kept.orderBy(F.desc("weight"), "stem").limit(MAX_STEMS).collect()
    return {r.stem: r.weight for r in rows}


def fit_logistic(features: np.ndarray, labels: np.ndarray, totals: dict[int, int], rounds: int = 30) -> np.ndarray:
    """Newton steps for a logistic model pulled to ``PRIOR``. The rows are weighed back to the shares
    that the labels have among all labelled rows."""
    x = np.hstack((np.ones((len(features), 1)), features))
    beta = PRIOR.copy()
    counts = np.bincount(labels, minlength=2)
    if not counts.all():
        return beta
    share = np.array([totals.get(0, 1), totals.get(1, 1)]) / max(1, sum(totals.values()))
    weight = (share / counts * len(labels))[labels]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (labels - p)) - (beta - PRIOR)
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta = beta + np.linalg.solve(curvature, gradient)
    return beta


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], label: str = "toxic",
        per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Stem weights and logistic weights, from at most ``per_class`` rows of each label."""
    small_batches(docs.sparkSession)
    sample, totals = labelled_sample(docs, labels, label, learn, per_class, id_col, text_col)
    weights = learn_stems(sample)
    shared = checked_broadcast(docs.sparkSession, weights, len(weights), MAX_STEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            sums = [scorer.clauses(t).tolist() for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.list_(pa.float64())), column(batch, "label")], names=["sums", "label"])

    rows = sorted(sample.mapInArrow(run, "sums array<double>, label int").collect())
    features = np.array([r.sums for r in rows]).reshape(-1, len(KINDS))
    return weights, fit_logistic(features, np.array([r.label for r in rows], np.int64), totals)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text: the probability of the label toxic.

    Null and empty texts have no clause and get the score of the bias. Each row is scored by itself:
    repeated rows get equal scores, null ids and skew do not matter, an empty table gives an empty
    table, and other columns are not read. Broadcast: at most ``MAX_STEMS`` stems.
    """
    weights, beta = model
    shared = checked_broadcast(docs.sparkSession, weights, len(weights), MAX_STEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            sums = np.array([scorer.clauses(t) for t in column(batch, "text").to_pylist()]).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-np.clip(beta[0] + sums @ beta[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
