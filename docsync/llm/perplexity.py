"""Quality rules by n-gram perplexity.

Texts are read as UTF-16 code units, all scripts, letters, digits and marks apart, and runs of four units,
which fill 64 bits, are counted over all documents: in each task first, then by Spark. From these counts
come, as tables, the shorter runs, their continuation counts and the three discounts per order of a
modified Kneser-Ney model. Its last table has, for every run of four, its count, the count of its context,
the context's spare mass and the probability of the shorter run.

The model grows with the corpus. It is cut into ranges of bounded size, each kept in arrays sorted by hash;
texts are scored in one pass per range, and the sums of the passes are added up. A text is not judged by
itself: its own counts of a run and of its context are taken off before the probability is made. A
document is rejected when its perplexity lies outside the band of its language, whose limits come from
the perplexities of all documents of that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import checked_broadcast, column, small_batches
from docsync.session import cut_lineage

ORDER = 4
# Bits of a unit; a run of ORDER units is one number. The margin before a text is unit 0.
BITS = 16
# Symbols counted at a time, and distinct runs a task gathers before it gives them out.
COUNTED, GATHERED = 1 << 20, 1 << 21
# Bytes of a range of the model, and of one run in it.
RANGE_BYTES, RUN_BYTES = 64 << 20, 32
# Width of a band: so many times the middle half of the log perplexities, beyond its ends.
REACH = 3.0
# Log perplexities are ranked in steps of one over this.
STEPS = 1000
# A language's quartiles are drawn towards those of all documents as if by so many of these.
DRAWN = 30
SYMBOL_MARKS = "#*$%&|<>"
_WORDS = regex.compile(r"[^\x20\x09-\x0D]+")


def symbols_of(text: str) -> np.ndarray:
    """Units of a text, after one margin for each place of a context."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return np.concatenate((np.zeros(ORDER - 1, np.uint64), units.astype(np.uint64)))


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """Packed runs: each symbol with those before it, the last in the low bits."""
    count = len(symbols) - ORDER + 1
    packed = np.zeros(max(0, count), np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(BITS)) | symbols[i:i + count]
    return packed


def spread(runs: np.ndarray) -> np.ndarray:
    """Hash of packed runs, one to one; the hash arrays are sorted by it."""
    with np.errstate(over="ignore"):
        value = runs * np.uint64(0x9E3779B97F4A7C15)
        return (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _added(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs with the sums of their counts."""
    order = np.argsort(runs)
    runs, counts = runs[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1]))) if len(runs) else np.empty(0, int)
    return runs[first], np.add.reduceat(counts, first) if len(first) else counts


def count_runs(texts: DataFrame) -> DataFrame:
    """``(run, n)`` over all texts; every task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.empty(0, np.uint64), np.empty(0, np.int64)
        packed, size = [], 0

        def add():
            runs, counts = np.unique(np.concatenate(packed), return_counts=True)
            return _added(np.concatenate((total[0], runs)), np.concatenate((total[1], counts)))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1])], names=["run", "n"])

        for batch in batches:
            for text in column(batch, "text"):
                packed.append(runs_of(symbols_of(text.as_py())))
                size += len(packed[-1])
                if size >= COUNTED:
                    total, packed, size = add(), [], 0
                    if len(total[0]) > GATHERED:
                        yield given()
                        total = np.empty(0, np.uint64), np.empty(0, np.int64)
        if packed:
            total = add()
        yield given()

    return texts.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, by the published estimate; one half of the count
    where a count of counts is missing or the estimate would leave nothing, or all, to lower orders."""
    n = [of_counts.get(i, 0) for i in range(5)]
    if not all(n[1:5]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    estimate = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
    return np.array([0.0, *(d if 0 < d < i else i / 2 for i, d in enumerate(estimate, 1))])


class Model(NamedTuple):
    """``table``: ``(run, n, total, spare, below)`` of every run of the highest order; its discounts; and
    the number of ranges that bound what a task holds at a time."""

    table: DataFrame
    off: np.ndarray
    ranges: int


def estimate(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Interpolated modified Kneser-Ney over the counts ``(run, n)``, as joins of the levels, lowest order
    first; the lowest is interpolated with the uniform distribution over the symbols that occur."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        # Continuation counts: in how many longer runs a shorter one ends.
        suffix = F.col("run").bitwiseAND((1 << BITS * order) - 1).alias("run")
        levels[order] = cut_lineage(levels[order + 1].groupBy(suffix).agg(F.count("*").alias("n")), "perplexity")
    of_counts = reduce(DataFrame.unionByName, [df.where("n <= 4").withColumn("order", F.lit(o)) for o, df in levels.items()])
    found: dict[int, dict[int, int]] = {}
    for row in of_counts.groupBy("order", "n").agg(F.count("*").alias("runs")).collect():
        found.setdefault(row.order, {})[row.n] = row.runs
    symbols = max(1, levels[1].count())
    lower = None
    for order in range(1, ORDER + 1):
        off = discounts(found.get(order, {}))
        rows = levels[order].withColumns({
            "off": F.when(F.col("n") == 1, float(off[1])).when(F.col("n") == 2, float(off[2])).otherwise(float(off[3])),
            "context": F.expr(f"shiftrightunsigned(run, {BITS})")})
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("spare"))
        rows = rows.join(contexts, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / symbols))
        else:
            rows = rows.withColumn("suffix", F.col("run").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(lower, "suffix")
        if order == ORDER:
            return cut_lineage(rows.select("run", "n", "total", "spare", "below"), "perplexity"), off
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("spare") * F.col("below")
        lower = cut_lineage(rows.select(F.col("run").alias("suffix"), p.alias("below")), "perplexity")


def fit(texts: DataFrame) -> Model:
    """The model of all texts. It stays a table; nothing of its size reaches the driver."""
    table, off = estimate(cut_lineage(count_runs(texts), "perplexity"))
    return Model(table, off, max(1, -(-table.count() * RUN_BYTES // RANGE_BYTES)))


class HashArrays:
    """A range of the model, sorted by hash."""

    def __init__(self, hashes, n, total, spare, below, off):
        self.hashes, self.n, self.total, self.spare, self.below, self.off = hashes, n, total, spare, below, off

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.hashes, self.n, self.total, self.spare, self.below, self.off

    @staticmethod
    def of(model: Model, part: int) -> HashArrays:
        """Range ``part`` of the model, brought to the driver: ``RANGE_BYTES`` on average."""
        rows = model.table.where(F.pmod(F.xxhash64("run"), F.lit(model.ranges)) == part).toArrow()
        run, n, total, spare, below = (rows[c].to_numpy() for c in ("run", "n", "total", "spare", "below"))
        hashes = spread(run.view(np.uint64))
        order = np.argsort(hashes)
        return HashArrays(hashes[order], n[order], total[order], spare[order].astype(np.float32),
                          below[order].astype(np.float32), model.off)

    def log_probability(self, text: str) -> float:
        """Sum of the log probabilities of a text's runs that are in this range, by the counts of all other
        texts: its own counts are taken off runs and contexts."""
        own, times = np.unique(runs_of(symbols_of(text)), return_counts=True)
        if not len(own) or not len(self.hashes):
            return 0.0
        # Runs of one context lie side by side.
        context = own >> np.uint64(BITS)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        sizes = np.diff(np.append(first, len(own)))
        of_context = np.repeat(np.add.reduceat(times, first), sizes)
        wanted = spread(own)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        held = self.hashes[at] == wanted
        at, times, of_context = at[held], times[held], of_context[held]
        n, total = self.n[at] - times, self.total[at] - of_context
        rest = np.where(total > 0, self.spare[at], 1.0) * self.below[at].astype(float)
        p = (n - self.off[np.minimum(n, 3)]) / np.maximum(total, 1) + rest
        return float(times @ np.log(p))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = _WORDS.findall(text)
    n = len(words)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeated = np.zeros(n, bool)
    if n >= 4:
        # Two steps, so that the packed windows fit whatever the number of distinct words.
        _, pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)
        _, place, counts = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[place] > 1
        for i in range(3):
            repeated[i:n - 2 + i] |= again
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif _WORDS.search(line):
            seen.add(line)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOL_MARKS)), dup_lines, int(repeated.sum())


_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _passed(rows: DataFrame, model: Model, part: int) -> DataFrame:
    """``(key, log_p)`` of every text by one range; with the first range also the base counts, the number
    of runs and what else the row has."""
    arrays = HashArrays.of(model, part).parts()
    # Ranges are even but for chance; twice the bound is far off.
    shared = checked_broadcast(rows.sparkSession, arrays, sum(p.nbytes for p in arrays), 2 * RANGE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = HashArrays(*shared.value)
        for batch in batches:
            texts = [t.as_py() for t in column(batch, "text")]
            log_p = pa.array([own.log_probability(t) for t in texts], pa.float64())
            if part:
                yield pa.RecordBatch.from_arrays([column(batch, "key"), log_p], names=["key", "log_p"])
                continue
            found = list(zip(*[(*base_counts(t), len(symbols_of(t)) - ORDER + 1) for t in texts])) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), log_p, column(batch, "doc_id"), column(batch, "lang"), *(pa.array(c, pa.int64()) for c in found)],
                names=["key", "log_p", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "runs"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    first = f"key long, log_p double, doc_id {kind}, lang string, {_RULES}, runs long"
    return rows.select("key", "doc_id", "text", "lang").mapInArrow(run, "key long, log_p double" if part else first)


def measure(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of ``(doc_id, text, lang)`` with the base counts and the log perplexity for the text."""
    rows = rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    found = _passed(rows, model, 0)
    if model.ranges > 1:
        found = cut_lineage(found, "passes")
        # Rows equal in id and text have equal sums. Each pass is done before the next range is loaded.
        passes = [cut_lineage(_passed(rows, model, part), "passes") for part in range(1, model.ranges)]
        more = reduce(DataFrame.unionByName, [p.groupBy("key").agg(F.max("log_p").alias("more")) for p in passes])
        more = more.groupBy("key").agg(F.sum("more").alias("more"))
        found = found.join(more, "key").withColumn("log_p", F.col("log_p") + F.col("more"))
    log_perplexity = F.when(F.col("runs") > 0, -F.col("log_p") / F.col("runs")).alias("log_perplexity")
    return found.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", log_perplexity)


def bands(measured: DataFrame) -> DataFrame:
    """``(lang, low, high)`` of log perplexity from exact ranks: documents are counted by language and
    step, and the counts are summed up in order. The quartiles of n documents count n to ``DRAWN``
    against those of all documents, so rare languages have bands of their own and no size is a switch."""
    step = F.floor(F.col("log_perplexity") * STEPS)
    known = measured.where("log_perplexity is not null").select("lang", step.alias("step"))
    counts = known.groupBy("lang", "step").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("lang").isNull().alias("other"), "lang", "step", "n").unionByName(
        counts.groupBy("step").agg(F.sum("n").alias("n")).select(
            F.lit(None).cast("boolean").alias("other"), F.lit(None).cast("string").alias("lang"), "step", "n"))
    key = ["other", "lang"]
    upto = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    quarter = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("step"))) / STEPS for q in (1, 3)]
    found = ranked.groupBy(*key).agg(quarter[0].alias("lower"), quarter[1].alias("upper"), F.max("total").alias("total"))
    found = cut_lineage(found, "perplexity")
    overall = found.where("other is null").select("lower", "upper").limit(1).collect()
    all_lower, all_upper = overall[0] if overall else (0.0, 0.0)
    weight = F.col("total") / (F.col("total") + DRAWN)
    drawn = found.where("other is not null").select(
        "lang", (weight * F.col("lower") + (1 - weight) * all_lower).alias("lower"),
        (weight * F.col("upper") + (1 - weight) * all_upper).alias("upper"))
    width = F.greatest(F.col("upper") - F.col("lower"), F.lit(0.05)) * REACH
    return drawn.select("lang", (F.col("lower") - width).alias("low"), (F.col("upper") + width).alias("high"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    log_perplexity, kept)`` of every whole text.

    Null and empty texts have counts 0 and no perplexity; they fail the base rule of 50 words. Rows
    without language are a language of their own. The band of a language lies the nearer to that of
    all documents the fewer texts it has. Null or repeated ids do not matter: a row is judged by its own
    text and the corpus. An empty table gives an empty table; other columns are not read.
    Broadcast: one range of the model at a time, of bounded size.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    )
    model = fit(rows.select("text"))
    measured = cut_lineage(measure(rows, model), "perplexity")
    limits = cut_lineage(bands(measured), "perplexity")
    own = limits.select(F.col("lang").alias("band_lang"), "low", "high")
    judged = measured.join(own, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return judged.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "log_perplexity", (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
