"""Phrase collocation mining by dynamic itemset counting.

Texts are turned into word hashes once and dealt into shards, which are then scanned in a cycle. A scan
counts single words, in the first cycle, and every longer phrase of which both parts, all words but the
last and all but the first, have reached the least count by then. So lengths are interleaved: a phrase
becomes active at the first scan after its parts are frequent, and stays so for one full cycle, after
which its count is exact. The scans end when no phrase is left that has not completed its cycle.

A phrase counts as frequent as soon as what the last cycle of scans has counted of it reaches the least
count. One of those scans must have found a fair part of that, so only phrases with such a part are
summed up. Tasks learn what is frequent from bitmaps of a fixed size, which may take a phrase too many
for active, never one too few; such a phrase is counted in vain, and once per shard all the same.

Phrases go by 61 bits of hash and their length. Their words come back from a table of distinct words,
which the first pass writes beside the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import (
    BITS, WordHashes, as_bytes, bitmap_of, column, few, held, scramble, ship_bitmap, shipped_bitmap, small_batches,
)
from docsync.session import cut_lineage, shared_folder

MIN_COUNT = 100
MAX_WORDS = 5
SHARDS = 3
TOP = 2000
# Counts that a task gathers before it gives them out.
GATHERED = 1 << 21
# Bytes of words a task remembers as given out.
MEMO_BYTES = 1 << 24
# Ranks are cut to the top in so many parts of a language first.
PARTS = 64
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_LENGTH = np.uint64(7)
_STOP = np.uint64(xxhash.xxh3_64_intdigest(b"."))
# Tasks that give out the parts of a phrase, where they meet it.
TELLERS = 4
TOKENS, WORDS, TOTALS = 0, 1, 2


def pieces(text: bytes) -> list[bytes]:
    """Words of a text in lower case (A-Z), with a full stop wherever a piece ends."""
    return text.lower().translate(_BREAKS).replace(b".", b" . ").split()


class LanguageWords:
    """Word ids of one language, and which of them are new to this task's memo."""

    def __init__(self, lang: str):
        # Not the hash that words have: a word of one language and that language's name would go by one id
        # with their likes swapped (Spanish "de", German "es").
        self.lang, self.seed = lang, np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))
        self.hashes, self.known = WordHashes(), set()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids, the low bits of which are the length 1; 0 for a full stop."""
        hashes = self.hashes.of(words)
        with np.errstate(over="ignore"):
            found = (scramble(hashes + self.seed) & ~_LENGTH) | np.uint64(1)
        found[hashes == _STOP] = 0
        return found


def _deal(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A row of word ids per text, dealt round to the shards; rows of words as they are met first; and
    the number of words per batch and language."""
    languages: dict[str, LanguageWords] = {}
    size, turn = 0, 0
    for batch in batches:
        rows: list[tuple] = []
        totals: dict[str, int] = {}
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
            own = languages.setdefault(lang, LanguageWords(lang))
            words = pieces(text)
            ids = own.ids(words)
            n = int(np.count_nonzero(ids))
            if not n:
                continue
            turn += 1
            totals[lang] = totals.get(lang, 0) + n
            rows.append((turn % shards, TOKENS, None, None, None, ids.tobytes()))
            new = set(words).difference(own.known)
            new.discard(b".")
            size += sum(map(len, new))
            if size > MEMO_BYTES:
                size = sum(map(len, new))
                for other in languages.values():
                    other.known.clear()
            own.known |= new
            new = list(new)
            rows += [(shards, WORDS, lang, i, w, None) for w, i in zip(new, own.ids(new).view(np.int64).tolist())]
        rows += [(shards, TOTALS, lang, n, None, None) for lang, n in totals.items()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "kind", "lang", "id", "word", "ids"])


_DEALT = "shard int, kind int, lang string, id long, word binary, ids binary"


def _phrases(ids: np.ndarray, frequent: np.ndarray, max_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length from 2, the phrases of which both parts are frequent: ids, ids of the part without
    the last word and of the part without the first, and the places of those parts among the phrases
    given before."""
    part, at = ids, np.flatnonzero((ids != 0) & held(frequent, ids))
    part = ids[at]
    for length in range(2, max_words + 1):
        follow = np.flatnonzero(np.diff(at) == 1)
        first, last = part[follow], part[follow + 1]
        at = at[follow]
        with np.errstate(over="ignore"):
            phrase = scramble(scramble(first) + ids[at + length - 1])
        phrase = (phrase & ~_LENGTH) | np.uint64(length)
        yield phrase, first, last
        kept = held(frequent, phrase)
        part, at = phrase[kept], at[kept]


def _counted(ids: list[np.ndarray]) -> pa.RecordBatch:
    found, counts = np.unique(np.concatenate(ids) if ids else np.empty(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["id", "n"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The word ids of a batch of texts, with a 0 between texts."""
    for batch in batches:
        if batch.num_rows:
            ended = [part for t in column(batch, "ids").to_pylist() for part in (t, b"\0" * 8)]
            yield np.frombuffer(b"".join(ended), np.uint64)


def _scan(batches: Iterator[pa.RecordBatch], words: bool, frequent, fresh, max_words: int) -> Iterator[pa.RecordBatch]:
    """Counts of the active phrases (and of all words): both parts are frequent, one of them since the
    last cycle."""
    known, lately = shipped_bitmap(frequent), shipped_bitmap(fresh)
    gathered, size = [], 0
    for ids in _texts(batches):
        met = [ids[ids != 0]] if words else []
        for phrase, first, last in _phrases(ids, known, max_words):
            met.append(phrase[held(lately, first) | held(lately, last)])
        gathered += met
        size += sum(map(len, met))
        if size > GATHERED:
            yield _counted(gathered)
            gathered, size = [], 0
    yield _counted(gathered)


def _resolve(batches: Iterator[pa.RecordBatch], frequent, wanted, part: int, parts: int, max_words: int) -> Iterator[pa.RecordBatch]:
    """The parts of the phrases that are wanted and fall to this task by their id, each phrase once per
    gathering."""
    known, asked = shipped_bitmap(frequent), shipped_bitmap(wanted)
    met: dict[int, tuple[int, int]] = {}

    def given() -> pa.RecordBatch:
        rows = [(i, *p) for i, p in met.items()]
        columns = np.array(rows, np.int64).reshape(-1, 3).T
        met.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "first", "last"])

    for ids in _texts(batches):
        for phrase, first, last in _phrases(ids, known, max_words):
            at = np.flatnonzero((phrase >> np.uint64(3)) % np.uint64(parts) == np.uint64(part % parts))
            at = at[held(asked, phrase[at])]
            _, once = np.unique(phrase[at], return_index=True)
            at = at[once]
            phrase, first, last = (v[at].view(np.int64).tolist() for v in (phrase, first, last))
            met.update(zip(phrase, zip(first, last)))
        if len(met) > GATHERED // 16:
            yield given()
    yield given()


def _parts(spark, dealt: str, totals: DataFrame, bits: np.ndarray, max_words: int, shards: int) -> DataFrame:
    """``(id, a, first, last)`` of the frequent phrases. Every phrase is asked of a few tasks over the first
    shard, whatever their number; of those that these do not meet, all tasks over all shards are asked."""
    known, left, found = ship_bitmap(spark, bits), totals.where("id & 7 > 1"), []
    for folders, all_tasks in (([0], False), (range(shards), True)):
        if left.isEmpty():
            break
        wanted = ship_bitmap(spark, bitmap_of(left))
        texts = spark.read.schema("ids binary").parquet(*(f"{dealt}/shard={s}" for s in folders))
        parts = 1 if all_tasks else max(1, texts.rdd.getNumPartitions() // TELLERS)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted, parts=parts) -> Iterator[pa.RecordBatch]:
            return _resolve(batches, known, wanted, TaskContext.get().partitionId(), parts, max_words)

        told = texts.mapInArrow(run, "id long, first long, last long")
        told = told.groupBy("id").agg(F.min(F.struct("first", "last")).alias("parts"))
        found.append(cut_lineage(told.join(left, "id").select("id", "a", "parts.*"), "phrases"))
        left = cut_lineage(left.join(found[-1], "id", "left_anti"), "left")
    return reduce(DataFrame.unionByName, found) if found else totals.where("false").selectExpr("id", "a", "id first", "id last")


def _frequent(dealt: str, spark, min_count: int, max_words: int, shards: int) -> tuple[DataFrame, np.ndarray]:
    """All scans: ``(id, a)`` of the frequent words and phrases, a being the exact count, and their
    bitmap."""
    schema = "id long, n long"
    folder = shared_folder(spark, "scans")
    # What a phrase must have in one scan at least, if a cycle of them finds it frequent.
    fair = -(-min_count // shards)
    bits = np.zeros(1 << (BITS - 5), np.uint32)
    lately: list[np.ndarray] = []
    step, last_active = 0, -1

    def table(name: str, steps, columns: str) -> DataFrame:
        paths = [f"{folder}/{name}/step={s}" for s in steps]
        return spark.read.schema(f"{columns}, step int").option("basePath", f"{folder}/{name}").parquet(*paths)

    while step < shards or step <= last_active + shards:
        fresh = reduce(np.bitwise_or, lately[-shards:], np.zeros_like(bits))
        known, new = ship_bitmap(spark, bits), ship_bitmap(spark, fresh)
        words = step < shards
        texts = spark.read.schema("ids binary").parquet(f"{dealt}/shard={step % shards}")
        found = texts.mapInArrow(lambda b: _scan(b, words, known, new, max_words), schema)
        # The few counts that make a phrase hopeful lie apart, so that they are read without the others.
        found = found.groupBy("id").agg(F.sum("n").alias("n")).withColumn("fair", (F.col("n") >= fair).cast("int"))
        found.write.partitionBy("fair").parquet(f"{folder}/counts/step={step}")
        window = table("counts", range(max(0, step - shards + 1), step + 1), f"{schema}, fair int")
        hopeful = window.where("fair = 1").select("id").distinct()
        if step:
            hopeful = hopeful.join(table("reached", range(step), "id long").select("id"), "id", "left_anti")
        sums = window.join(few(cut_lineage(hopeful, "hopeful")), "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
        sums.where(F.col("n") >= min_count).select("id").write.parquet(f"{folder}/reached/step={step}")
        now = table("reached", [step], "id long")
        lately.append(bitmap_of(now))
        bits = bits | lately[-1]
        if not now.where(F.expr(f"id & 7 < {max_words}")).isEmpty():
            last_active = step
        known.destroy()
        new.destroy()
        step += 1

    keys = few(table("reached", range(step), "id long").select("id"))
    counts = [table("counts", range(s, step, shards), f"{schema}, fair int").select("id", "n", F.lit(s).alias("shard"))
              for s in range(min(shards, step))]
    # A phrase taken for active too early may have been counted twice in a shard: alike both times.
    totals = reduce(DataFrame.unionByName, counts).join(keys, "id", "left_semi").groupBy("id", "shard").agg(
        F.max("n").alias("n")).groupBy("id").agg(F.sum("n").alias("a"))
    return cut_lineage(totals, "totals"), bits


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
         max_words: int = MAX_WORDS, top: int | None = TOP, shards: int = SHARDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of 2 to ``max_words`` (at
    most 7) words that occur ``min_count`` times or more, whole texts counted.

    Texts are lower-cased (A-Z) and split at full stops, commas, semicolons, colons, exclamation and
    question marks and line ends; words are what lies between spaces and tabs. ``a`` is the count of the
    phrase, ``l`` and ``r`` those of its two parts at the cut with the least score, ``n`` all words of the
    language, ``score`` the whole part of 1000 a n / (l r), exact. A phrase that a longer one contains as
    often as it occurs is left out. Best first: score, then count, then the phrase in byte order; ``top``
    None gives all. Null, empty and wordless texts add nothing; a null language is ``und``. Repeated rows
    count as often as they occur. An empty table gives an empty table; other columns are not read.
    """
    if not 2 <= max_words <= 7 or min_count < 2 or shards < 1:
        raise ValueError("phrases of 2 to 7 words, twice or more, and a shard are needed")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        as_bytes(F.col(f"`{text_col}`")).alias("text"))
    dealt = shared_folder(spark, "dealt")
    rows.mapInArrow(lambda b: _deal(b, shards), _DEALT).write.partitionBy("shard").option(
        "compression", "zstd").parquet(dealt)
    made = spark.read.schema(_DEALT).parquet(dealt)
    for shard in range(shards):
        # A shard that no text fell into is an empty folder, as is the whole of an empty table.
        spark.createDataFrame([], "ids binary").write.mode("append").parquet(f"{dealt}/shard={shard}")
    totals, bits = _frequent(dealt, spark, min_count, max_words, shards)

    phrases = _parts(spark, dealt, totals, bits, max_words, shards)
    sizes = made.where(F.col("kind") == TOTALS).groupBy("lang").agg(F.sum("id").alias("n"))
    # Every task that met a word has given it out.
    words = made.where(F.col("kind") == WORDS).groupBy("id").agg(
        F.min("lang").alias("lang"), F.min(F.col("word").cast("string")).alias("phrase"))
    none = F.array().cast("array<long>")
    level = cut_lineage(words.join(totals.where("id & 7 = 1"), "id").select(
        "id", "lang", "phrase", "a", F.col("phrase").alias("end"), none.alias("heads"), none.alias("tails")), "level")
    levels = []
    for length in range(2, max_words + 1):
        left = level.select(F.col("id").alias("first"), "lang", "phrase", F.concat("heads", F.array("a")).alias("heads"))
        right = level.select(F.col("id").alias("last"), "end", F.concat(F.array("a"), "tails").alias("tails"))
        level = phrases.where(F.expr(f"id & 7 = {length}")).join(left, "first").join(right, "last").select(
            "id", "lang", F.concat_ws(" ", "phrase", "end").alias("phrase"), "a", "end", "heads", "tails")
        level = cut_lineage(level, "level")
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)

    # A longer phrase around one is at least as rare, so one that is as frequent passes through a phrase of
    # just one word more.
    longer = phrases.select(F.col("first").alias("id"), "a").unionByName(phrases.select(F.col("last").alias("id"), "a"))
    longer = longer.groupBy("id").agg(F.max("a").alias("around"))
    found = found.join(longer, "id", "left").where("around is null or around < a").join(sizes, "lang")
    return _ranked(found, top)


def _ranked(found: DataFrame, top: int | None) -> DataFrame:
    """The lowest-scoring cut of each phrase, and the best phrases of each language."""
    cut = F.transform(F.arrays_zip("heads", "tails"), lambda c, k: F.struct(
        c["heads"].alias("l"), c["tails"].alias("r"), k.alias("k")))
    rows = found.select("lang", "phrase", "a", "n", F.inline(cut)).select(
        "lang", "phrase", "a", "n", "l", "r", "k",
        # Up to 38 digits; the quotient is at most 1000 n and fits 64 bits.
        F.expr("(cast(a * 1000 as decimal(19,0)) * cast(n as decimal(18,0))) div "
               "(cast(l as decimal(19,0)) * cast(r as decimal(18,0)))").alias("score"))
    least = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = least.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = scored.withColumn("rank", rank.cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (
    select doc_id, coalesce(lang, 'und') lang, regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') p
    from documents
), split as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from (select lang, unnest(p) piece from pieces)
), grams as (
    select lang, size, array_to_string(ws[s:s + size - 1], ' ') phrase, ws[s:s + size - 1] ws
    from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) s
          from split cross join (select unnest(range(1, 6)) size) where len(ws) >= size)
), counted as (
    select lang, size, phrase, any_value(ws) ws, count(*) a from grams group by lang, size, phrase
), sizes as (
    select lang, sum(a)::bigint n from counted where size = 1 group by lang
), frequent as (
    select * from counted where a >= 100
), cuts as (
    select f.lang, f.phrase, f.size, f.a, s.n, k, l.a l, r.a r,
           ((1000::hugeint * f.a * s.n) // (l.a::hugeint * r.a))::bigint score
    from (select *, unnest(range(1, size)) k from frequent where size > 1) f
    join frequent l on l.lang = f.lang and l.phrase = array_to_string(f.ws[1:k], ' ')
    join frequent r on r.lang = f.lang and r.phrase = array_to_string(f.ws[k + 1:], ' ')
    join sizes s on s.lang = f.lang
), best as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
    select distinct c.lang, c.phrase from (
        select lang, a, array_to_string(ws[s:s + z - 1], ' ') phrase
        from (select *, unnest(range(1, size - z + 2)) s
              from frequent cross join (select unnest(range(2, 5)) z) where z < size)) p
    join frequent c on c.lang = p.lang and c.phrase = p.phrase and 100 * p.a >= 100 * c.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as "rank", phrase, a, l, r, n, score
from best b where not exists (select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase)
qualify "rank" <= 2000
"""
