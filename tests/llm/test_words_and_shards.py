"""Phrases, spelling variants and shards against plain versions of what they must give."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsync.llm import common, phrases, sharding, spelling


# Phrases

def plain_phrases(rows, min_count, max_words=5):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", lower):
            words = re.findall("[^\\x20\\x09]+", piece)
            for size in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, count in counts.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        kept = {p: a for p, a in count.items() if a >= min_count}
        scored = []
        for p, a in kept.items():
            if len(p) < 2 or any(
                len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in kept.items()
            ):
                continue
            score, _, l, r = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]])
                                 for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored), 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(found)


def corpus(seed, texts):
    draw = random.Random(seed)
    words = ["a", "b", "C", "été", "dd", "ß", "e.f", "g\x1ch", "É"]
    marks = [" ", " ", " ", "\t", ", ", ".", "\n", " ! "]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words[:draw.randint(1, 9)]) + draw.choice(marks)
             for _ in range(draw.randint(0, 40)))) for _ in range(texts)]
    # One text holds a third of all rows.
    return rows + [("en", "A b c dd b c, a b c")] * (texts // 2) + [(None, None), ("en", ""), ("de", " \n\t ")]


@pytest.mark.parametrize("seed,shards,min_count", [(1, 1, 3), (2, 2, 5), (3, 3, 4), (4, 5, 9)])
def test_phrases_equal_a_plain_count(spark, seed, shards, min_count):
    rows = corpus(seed, 60)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    found = sorted(map(tuple, phrases.mine(docs, min_count=min_count, shards=shards, top=None).collect()))
    assert found == plain_phrases(rows, min_count) and found


def test_words_that_are_names_of_languages_stay_apart(spark):
    rows = [("es", "de de de que en")] * 7 + [("de", "es es die en es")] * 5 + [("en", "es de")] * 4 + [("que", "es es")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = sorted(map(tuple, phrases.mine(docs, min_count=3, top=None).collect()))
    assert found == plain_phrases(rows, 3)


def test_late_phrases_complete_their_cycle(spark, monkeypatch):
    # All of a long phrase's texts are in one part of the table, so that its parts turn frequent late.
    rows = [("en", f"x{i} y{i}") for i in range(40)] + [("en", "k l m n o")] * 6 + [("en", "l m n o p")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = sorted(map(tuple, phrases.mine(docs, min_count=6, shards=4).collect()))
    assert found == plain_phrases(rows, 6) and {r[2] for r in found} == {"k l m n o", "l m n o"}


def test_only_the_best_of_each_language_and_few_memos(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 50)
    monkeypatch.setattr(phrases, "MEMO_BYTES", 20)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    rows = corpus(5, 50)
    found = sorted(map(tuple, phrases.mine(spark.createDataFrame(rows, "lang string, text string"), min_count=4, top=3).collect()))
    assert found == [r for r in plain_phrases(rows, 4) if r[1] <= 3]


def test_scores_beyond_64_bits_are_exact(spark):
    big = [(10**12 + 7, 10**15 + 3, 10**12 + 9, 3 * 10**12 + 1), (10**13 - 1, 10**16 + 1, 10**13, 10**13 - 1), (100, 10**17, 100, 100)]
    rows = [("en", f"p{i} q", a, n, [l], [r]) for i, (a, n, l, r) in enumerate(big)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, n long, heads array<long>, tails array<long>")
    found = {r.phrase: r.score for r in phrases._ranked(df, None).collect()}
    assert found == {f"p{i} q": 1000 * a * n // (l * r) for i, (a, n, l, r) in enumerate(big)}


def test_cuts_tie_to_the_first(spark):
    df = spark.createDataFrame([("en", "a b c", 5, 100, [10, 20], [20, 10])],
                               "lang string, phrase string, a long, n long, heads array<long>, tails array<long>")
    row = phrases._ranked(df, 1).first()
    assert (row.l, row.r, row.score) == (10, 20, 2500)


# Spelling

def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


words = st.text("abqé", max_size=7) | st.integers(25, 60).map(lambda n: "ab" * n) | st.integers(25, 80).map(lambda n: "a" * n)


@settings(deadline=None, max_examples=300)
@given(words, words)
def test_near_is_one_edit(a, b):
    assert spelling.near(a, b) == plain_near(a, b)
    letters = spelling.Letters([w.encode("latin-1") for w in (a, b)])
    assert letters.near(*map(spelling.np.array, ([0, 1], [1, 0]))).tolist() == [plain_near(a, b)] * 2


@pytest.mark.parametrize("subtree", [1, 3, 20, 1 << 15])
def test_near_words_equal_all_pairs(spark, monkeypatch, subtree):
    monkeypatch.setattr(spelling, "PIECE", 7)
    monkeypatch.setattr(spelling, "PAIRS", 11)
    draw = random.Random(subtree)
    # Anagrams share a vector; long words pass the bound of the counts and of the letter tables.
    made = {"".join(draw.choice("abceé") for _ in range(draw.randint(3, 6))) for _ in range(150)}
    made |= {"".join(draw.sample("abcd", 4)) for _ in range(30)}
    made |= {"a" * n + end for n in (29, 30, 31, 32, 47, 48, 49, 60) for end in ("", "b", "c", "bb", "ÿ")}
    rows = [(w, draw.randint(1, 6)) for w in sorted(made)]
    found = spelling.near_words(spark.createDataFrame(rows, "word string, n long"), subtree).collect()
    expected = set()
    for word, _ in rows:
        met = [(-n, w) for w, n in rows if plain_near(word, w)]
        if met:
            less, best = min(met)
            expected.add((word, len(met), -less, best))
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def plain_variants(rows, min_count):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-z\u00c0-\u00ff]+", lower):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    forms, result = {}, []
    for word, n in kept.items():
        met = sorted((-m, w) for w, m in kept.items() if plain_near(word, w))
        forms[word] = met[0][1] if met and -met[0][0] >= 2 * n else None
        result.append((word, n, len(met)))
    def root(word):
        return word if forms[word] is None else root(forms[word])
    return sorted((w, forms[w], root(w), n, m, kept.get(forms[w])) for w, n, m in result)


def test_variants_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GATHERED", 200)
    draw = random.Random(12)
    stems = ["Colour", "color", "colors", "colôrs", "receive", "recieve", "receve", "Éclair", "éclair", "abcde", "abcd"]
    rows = [(i % 70 or None, " ".join(draw.choice(stems[:draw.randint(1, 11)]) + draw.choice(["", "s", "1", "-x"])
             for _ in range(draw.randint(0, 30)))) for i in range(200)] + [(None, None), (1, ""), (2, "×÷×÷×")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(map(tuple, spelling.variants(docs, subtree=4).collect()))
    assert found == plain_variants(rows, 3)
    assert any(r[1] and r[2] != r[1] for r in found) and any(r[1] is None for r in found)


def test_every_97th_run_loses_a_letter():
    runs = [f"{'abcdefghij'[i % 10]}word{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)]
    salt = zlib.crc32(b"17:")
    changed = [r for r in runs if spelling.variant(r, salt) != r]
    assert changed == [r for r in runs if zlib.crc32(f"17:{r}".encode()) % 97 == 0] and changed
    assert all(len(spelling.variant(r, salt)) == len(r) - 1 for r in changed)


# Shards

def keys(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))


def test_one_more_shard_takes_into_itself_only(spark):
    rows = sharding.assign(keys(spark, 4000)).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and 4000 / 9 * 0.8 < len(moved) < 4000 / 9 * 1.2
    nine = {r.doc_id: r.shard for r in sharding.place(keys(spark, 4000), (1.0,) * 9).collect()}
    assert nine == {r.doc_id: r.grown_shard for r in rows}


def test_weights_and_removed_shards(spark):
    three = {r.doc_id: r.shard for r in sharding.place(keys(spark, 6000), (3, 2, 1)).collect()}
    sizes = Counter(three.values())
    assert all(abs(sizes[i] - 1000 * w) < 150 for i, w in enumerate((3, 2, 1)))
    two = {r.doc_id: r.shard for r in sharding.place(keys(spark, 6000), (3, 0, 1)).collect()}
    assert all(two[k] == s for k, s in three.items() if s != 1) and set(two.values()) == {0, 2}
    heavier = {r.doc_id: r.shard for r in sharding.place(keys(spark, 6000), (3, 2, 2)).collect()}
    assert all(heavier[k] in (s, 2) for k, s in three.items())
    for wrong in ([], [0], [-1, 1]):
        with pytest.raises(ValueError):
            sharding.place(keys(spark, 1), wrong)


def test_slots_have_no_gaps_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    rows = [(5, "same")] * 333 + [(5, f"other {i}") for i in range(100)] + [(None, "x")] * 20 + [(i, "y") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = sharding.assign(docs).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(t) + 1) for i, t in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id == 5}) == 1
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, sharding.assign(docs.repartition(3)).collect()), key=repr)


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = keys(spark, 500).withColumn("more", F.lit("x"))
    sharding.write_shards(docs, str(tmp_path / "out"), max_rows=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == 500
    expected = {r.doc_id: r.shard for r in sharding.place(docs).collect()}
    assert expected == {r.doc_id: r.shard for r in back.collect()}
