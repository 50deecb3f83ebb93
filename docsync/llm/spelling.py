"""Spelling variant grouping with a trie over letter-group counts.

A word's vector counts its letters in 16 groups. Words are arranged in a trie of these counts, one group
per level. One edit changes the vector by at most one letter too many in one group and one too few in
another, so the words near a given one lie on the paths that leave its own with a surplus of one and a
deficit of one. A depth-first search spends that budget and compares the words of the leaves it reaches.
Each pair is looked for from one side only: the first group in which two vectors differ must be a
surplus, and of words with equal vectors the smaller one looks.

The trie is cut below its first levels. Every subtree is a task's group: its own words, and the words
of other subtrees that their budget lets in, with what is left of it. The number of levels is the least
at which no subtree has more than ``SUBTREE`` words; where even whole vectors are shared by more, the
words of a subtree are dealt into blocks that all its searchers visit. Tasks give one row per word, with
the number of near words and the best of them, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import CRC32_TABLE_SQL, as_bytes, column, crc32_sql, few, small_batches
from docsync.session import cut_lineage

MIN_LENGTH, MIN_COUNT = 5, 3
DROP_EVERY = 97
RUN = re.compile("[a-zÀ-ÿ]+")
# Groups of letters by the low four bits of the code point, those of frequent letters first: counts of
# frequent letters differ most, so the first levels cut most.
LEVELS = np.array([5, 1, 9, 15, 14, 4, 3, 2, 8, 12, 7, 6, 0, 13, 11, 10])
# Counts above are taken for equal; their words are told apart at the leaves.
MOST = 30
SUBTREE = 1 << 13
# Words counted by a task before it gives them out, in characters.
GATHERED = 1 << 23
# Searchers in a piece of the search, and word pairs compared at a time.
PIECE, PAIRS = 1 << 16, 1 << 17
# A node of so few words is a leaf, whatever its level.
LEAF = 4
# Words of up to so many letters are compared many at a time.
SHORT = 48


def variant(run: str, salt: int) -> str:
    """A lower-cased run as it counts: one of its letters is left out where the checksum says so."""
    h = zlib.crc32(run.encode(), salt)
    if h % DROP_EVERY:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def _count(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    size = 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for name, text in zip(column(batch, "name").to_pylist(), column(batch, "text").to_pylist()):
            salt = zlib.crc32(name)
            runs = Counter(RUN.findall(text.lower().decode()))
            for run, n in runs.items():
                word = variant(run, salt)
                if len(word) >= min_length:
                    known = counts.get(word)
                    if known is None:
                        size += len(word) + 8
                        counts[word] = n
                    else:
                        counts[word] = known + n
            if size > GATHERED:
                yield given()
                counts.clear()
                size = 0
    yield given()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: words of ``min_length`` letters or more that occur ``min_count`` times or more."""
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":")).cast("binary")
    rows = docs.select(name.alias("name"), as_bytes(F.col(f"`{text_col}`")).alias("text"))
    counted = rows.mapInArrow(lambda b: _count(b, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letters per group, in the order of the levels, of words in Latin-1."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    found = np.bincount(owner * 16 + (joined & 15), minlength=16 * len(words)).reshape(-1, 16)
    return np.minimum(found[:, LEVELS], MOST).astype(np.uint8)


# What a row is in its subtree: one of its words, or a searcher with a surplus or a deficit left or not.
OWN, BOTH, SPENT, DEFICIT = 0, 1, 2, 3
_ROUTED = "node binary, role int, word string, n long"


def _route(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Each word in its own subtree, and as a searcher in those its budget leads to: one with a surplus
    in an early group, and then perhaps a deficit in a later one."""
    for batch in batches:
        words = [w.encode("latin-1") for w in column(batch, "word").to_pylist()]
        if not words:
            continue
        vector = vectors(words)[:, :depth].astype(np.int16)
        # Where only the surplus has been spent, the deficit is left for the levels below.
        moves = [(OWN, np.zeros(depth, np.int16))]
        for i in range(depth):
            up = np.zeros(depth, np.int16)
            up[i] = 1
            moves.append((DEFICIT, up))
            for j in range(i + 1, depth):
                down = up.copy()
                down[j] = -1
                moves.append((SPENT, down))
        nodes, roles, rows = [], [], []
        for role, move in moves:
            moved = vector + move
            at = np.flatnonzero(((moved >= 0) & (moved <= MOST)).all(axis=1))
            packed = moved[at].astype(np.uint8).tobytes()
            nodes += [packed[k:k + depth] for k in range(0, len(packed), depth)]
            roles.append(np.full(len(at), role, np.int32))
            rows.append(at)
        taken = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(np.concatenate(roles)), column(batch, "word").take(taken),
             column(batch, "n").take(taken)], names=["node", "role", "word", "n"])


class Trie:
    """Words of a subtree, sorted by their remaining counts: a node is a range of them."""

    def __init__(self, vector: np.ndarray):
        self.order = np.lexsort(vector.T[::-1]) if vector.shape[1] else np.arange(len(vector))
        self.vector = vector[self.order]
        n, levels = vector.shape
        # Per level: where each node begins, and the child of a node by its count.
        self.begins, self.children = [np.array([0, n])], []
        node = np.zeros(n, np.int64)
        for level in range(levels):
            key = node * (MOST + 1) + self.vector[:, level]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            child = np.full((len(self.begins[-1]) - 1) * (MOST + 1), -1, np.int32)
            child[key[first]] = np.arange(len(first))
            self.children.append(child)
            self.begins.append(np.append(first, n))
            node = np.repeat(np.arange(len(first)), np.diff(self.begins[-1]))

    def search(self, vector: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth first, in pieces: searchers, and the begin and end of the leaves that they reach."""
        levels = len(self.children)
        stack = [(0, np.arange(s, min(s + PIECE, len(role))), None, None) for s in range(0, len(role), PIECE)]
        while stack:
            level, who, node, left = stack.pop()
            if node is None:
                node, left = np.zeros(len(who), np.int32), role[who]
            begin, end = self.begins[level][node], self.begins[level][node + 1]
            leaf = np.full(len(who), True) if level == levels else end - begin <= LEAF
            if leaf.any():
                yield who[leaf], begin[leaf], end[leaf]
                who, node, left = who[~leaf], node[~leaf], left[~leaf]
            if not len(who):
                continue
            count = vector[who, level].astype(np.int16)
            found = []
            for move, may, then in ((0, None, None), (1, BOTH, DEFICIT), (-1, DEFICIT, SPENT)):
                at = np.arange(len(who)) if may is None else np.flatnonzero(left == may)
                to = count[at] + move
                at, to = at[(to >= 0) & (to <= MOST)], to[(to >= 0) & (to <= MOST)]
                child = self.children[level][node[at].astype(np.int64) * (MOST + 1) + to]
                at, child = at[child >= 0], child[child >= 0]
                found.append((who[at], child, left[at] if then is None else np.full(len(at), then, np.int32)))
            who, node, left = (np.concatenate(c) for c in zip(*found))
            for s in range(0, len(who), PIECE):
                stack.append((level + 1, who[s:s + PIECE], node[s:s + PIECE], left[s:s + PIECE]))


def near(a: str | bytes, b: str | bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Letters:
    """Words side by side, so that many pairs are compared at a time."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        width = min(int(self.length.max(initial=1)), SHORT)
        self.forward = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        self.backward = np.frombuffer(b"".join(w[::-1][:width].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.abs(self.length[a] - self.length[b])
        longer = np.maximum(self.length[a], self.length[b])
        differ = self.forward[a] != self.forward[b]
        found = (gap == 0) & (longer <= SHORT) & (np.count_nonzero(differ, axis=1) == 1)
        one = np.flatnonzero((gap == 1) & (longer <= SHORT))
        before = differ[one].argmax(axis=1)
        behind = (self.backward[a[one]] != self.backward[b[one]]).argmax(axis=1)
        found[one] = before + behind >= longer[one] - 1
        for i in np.flatnonzero((gap <= 1) & (longer > SHORT)).tolist():
            found[i] = near(self.words[a[i]], self.words[b[i]])
        return found


def _search_subtree(table: pa.Table, depth: int) -> pa.Table:
    """Near words of a subtree's words and searchers: ``(word, n_near, best_n, best)``."""
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    role, n = table["role"].to_numpy(), table["n"].to_numpy()
    own = np.flatnonzero(role == OWN)
    size = len(words)
    n_near, best_n, best = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    # Places of the words in order, for ties.
    place = np.empty(size, np.int64)
    place[sorted(range(size), key=words.__getitem__)] = np.arange(size)
    if len(own):
        vector = vectors(words)[:, depth:]
        trie, letters = Trie(vector[own]), Letters(words)
        member = own[trie.order]
        # Its own words look for one another with the whole budget.
        start = np.where(role == OWN, BOTH, role).astype(np.int32)

        def told(who: np.ndarray, other: np.ndarray) -> None:
            n_near[:] += np.bincount(who, minlength=size)
            order = np.lexsort((place[other], -n[other], who))
            who, other = who[order], other[order]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else []
            who, other = who[first], other[first]
            better = (n[other] > best_n[who]) | ((n[other] == best_n[who]) & (place[other] < place[best[who]]))
            best_n[who[better]], best[who[better]] = n[other[better]], other[better]

        for who, begin, end in trie.search(vector, start):
            for s in _spans(end - begin, PAIRS):
                count = (end - begin)[s]
                a = np.repeat(who[s], count)
                b = member[np.repeat(begin[s], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)]
                # At a leaf above the last level the rest of the vectors decides who of two looks.
                gap = vector[b].astype(np.int16) - vector[a]
                turn = gap[np.arange(len(gap)), (gap != 0).argmax(axis=1)] if gap.shape[1] else np.zeros(len(a))
                inside = role[a] <= BOTH
                may = ~inside | (turn > 0) | ((turn == 0) & (place[a] < place[b]))
                a, b = a[may], b[may]
                met = letters.near(a, b)
                told(a[met], b[met])
                told(b[met], a[met])
    kept = np.flatnonzero(n_near)
    return pa.table({
        "word": table["word"].combine_chunks().take(pa.array(kept)), "n_near": n_near[kept], "best_n": best_n[kept],
        "best": table["word"].combine_chunks().take(pa.array(best[kept])),
    })


def _spans(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of the counts that sum up to about the limit."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield slice(start, stop)
        start = stop


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words ``(word, n)``, distinct and of code points below 256,
    that have near ones: their number, and the one of largest n (of ties, the smallest)."""
    spark = words.sparkSession
    # Rows per whole vector; from them the words of the largest subtree for each number of levels.
    whole = words.mapInArrow(_nodes, "node binary, n_words long").groupBy("node").agg(F.sum("n_words").alias("n_words"))
    whole = cut_lineage(whole, "vectors")
    levels = whole.select("n_words", F.explode(F.sequence(F.lit(1), F.lit(len(LEVELS)))).alias("depth"), "node")
    sizes = levels.groupBy("depth", F.expr("substring(node, 1, depth)").alias("node")).agg(F.sum("n_words").alias("size"))
    most = {r.depth: r.most for r in sizes.groupBy("depth").agg(F.max("size").alias("most")).collect()}
    depth = next((d for d in sorted(most) if most[d] <= subtree), len(LEVELS))
    blocks = F.ceil(F.sum("n_words") / F.lit(subtree)).cast("int").alias("blocks")
    nodes = few(cut_lineage(whole.groupBy(F.expr(f"substring(node, 1, {depth})").alias("node")).agg(blocks), "nodes"))
    routed = words.mapInArrow(lambda b: _route(b, depth), _ROUTED).join(nodes, "node")
    # Words of a subtree stay in one block and look into the others; searchers look into all.
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if depth < len(LEVELS):
        routed = routed.withColumn("block", F.lit(0))
    else:
        routed = routed.withColumn("block", block).withColumn(
            "role", F.when((F.col("role") == OWN) & (F.col("block") != home), BOTH).otherwise(F.col("role")))
    found = routed.select("node", "block", "role", "word", "n").groupBy("node", "block").applyInArrow(
        lambda t: _search_subtree(t, depth), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("found")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("found.less")).alias("best_n"), "found.best")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(v.tobytes() for v in vectors([w.encode("latin-1") for w in column(batch, "word").to_pylist()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["node", "n_words"])


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words ``(word, form)`` that have a form: the last word that forms lead to.
    Every round the reach doubles; forms at least double the count, so rounds are few."""
    reach = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut_lineage(reach.join(beyond, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, subtree: int = SUBTREE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the whole texts.

    Words are runs of Latin letters, lower-cased (A-Z), of ``min_length`` letters and ``min_count``
    occurrences; a checksum of id and run drops a letter of one run in 97. Two words are near if one
    letter is inserted, deleted or replaced. ``form`` is the near word of largest count, if that is twice
    the word's own, ``root`` where forms lead. Null and empty texts add nothing; a null id counts as
    ``null``; repeated rows count as often as they occur. An empty table gives an empty table; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    words = cut_lineage(vocabulary(docs, id_col, text_col, min_length, min_count), "vocabulary")
    found = words.join(near_words(words, subtree), "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    found = cut_lineage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    known = roots(found.where("form is not null").select("word", "form"))
    return found.join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = rf"""
with recursive {CRC32_TABLE_SQL}, runs as (
    select doc_id, run, count(*) n from (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) run from documents) group by doc_id, run
), drawn as (
    select run, n, {crc32_sql("coalesce(doc_id::varchar, 'null') || ':' || run")} h from runs cross join crc32_table
), words as materialized (
    select word, sum(n)::bigint n from (
        select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, n from drawn)
    where length(word) >= 5 group by word having sum(n) >= 3
), cut as materialized (
    select word, n, i, word[:i - 1] || word[i + 1:] rest, word[:i - 1] || '*' || word[i + 1:] mask
    from (select word, n, unnest(range(1, length(word) + 1)) i from words)
), near as (
    select a.word, b.word other, b.n from cut a join cut b on a.mask = b.mask and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
    select word, count(*) n_near, arg_min(other, (-n, other)) best, max(n) best_n from near group by word
), formed as materialized (
    select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when best_n >= 2 * w.n then best end form,
           case when best_n >= 2 * w.n then best_n end form_n
    from words w left join best b on w.word = b.word
), chain(word, root) as (
    select word, word from formed
    union all select c.word, f.form from chain c join formed f on c.root = f.word where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n
from formed f join chain c on f.word = c.word join formed l on c.root = l.word where l.form is null
"""
