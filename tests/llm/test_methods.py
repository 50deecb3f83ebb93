"""Each operator against a plain version of what it must give."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsync.llm import contamination, jaccard, language, mixing, perplexity, quality, repeats, secret_scan, tokens, toxicity
from docsync.llm.common import components, gram_hashes, releasing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(*tokens.read_vocabulary(VOCABULARY))


@settings(deadline=None, max_examples=300)
@given(text=st.text(max_size=60) | st.text("ab' \n\t\x85\x1c　éß字3,.<|endoftext|>", max_size=80))
def test_token_counts_equal_the_library(counter, tokenizer, text):
    assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_special_strings_count_once(counter):
    assert counter.text("<|endoftext|><|endoftext|>") == 2


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        found += [("assign", m.start(), m.end())] * (len(m[2]) >= 6)
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([
    "token", "Secret", "API_KEY", "apikey", "passwd", ":", "=", " ", '"', "'", "abc", "hunter2xyz", "AKIA",
    "0123456789abcdef" * 2, "ABCDEFGH12345678", "é", "\n", "deadbeef",
]), max_size=14).map("".join))
def test_base_spans(text):
    base, spans = secret_scan.scan_text(text)
    assert base == brute_base(text)
    assert set(base) <= set(spans)


def test_entropy_spans_and_allow_list():
    random.seed(3)
    key = "".join(random.choice("ABCDEFGHabcdefgh0123456789+/xyzXYZ") for _ in range(44))
    found = secret_scan.scan_text(f"uses {key} here")[1]
    assert [s[0] for s in found] == ["entropy"] and found[0][1] >= 5 and found[0][2] <= 5 + len(key)
    quiet = ["plain words only " * 9, "A" * 30 + "1" * 10, "id 123e4567-e89b-12d3-a456-426614174000",
             f"sha256: {'0123456789ABCDEF' * 4}", "4952935900253052123456", "anonymousInternationalisation"]
    assert all(not secret_scan.scan_text(t)[1] for t in quiet)


@settings(deadline=None, max_examples=100)
@given(st.text("abcdef0123", min_size=20, max_size=60))
def test_incremental_entropy(text):
    def entropy(window):
        return -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())

    inside = {j for i in range(len(text) - 19) if entropy(text[i:i + 20]) >= 2.9 - 1e-9 for j in range(i, i + 20)}
    assert inside == {j for a, b in secret_scan.suspicious(text, 20, 2.9) for j in range(a, b)}


def test_redaction_joins_overlaps():
    assert secret_scan.redacted("abcdefgh", [("hex", 1, 4), ("hex", 3, 5), ("hex", 6, 7)], "*") == "a*f*h"


def test_rest_of_a_token_beside_a_base_span():
    """What a base span covers in part is found, and replaced, to its end."""
    random.seed(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789"
    secret = "".join(random.sample(letters, 40))
    for first, last in (("AKIA" + "Q7W2E9R4T1Y6U3Z8", "/" + secret), (secret, "_" + "0123456789abcdef" * 2)):
        token = first + last
        text = f"uses {token} here"
        base, spans = secret_scan.scan_text(text)
        assert base and set(base) <= set(spans)
        assert {j for _, a, b in spans for j in range(a, b)} >= set(range(5, 5 + len(token)))
        assert secret_scan.redacted(text, spans, "*") == "uses * here"
    # A span that base spans cover wholly is not added.
    assert {s[0] for s in secret_scan.scan_text('token = "0123456789abcdef0123456789"')[1]} == {"assign", "hex"}
    assert not secret_scan.covered(("entropy", 0, 9), [("hex", 0, 3), ("hex", 4, 9)])
    assert secret_scan.covered(("entropy", 0, 9), [("assign", 0, 4), ("hex", 4, 9)])


def near_copies(seed, groups=12):
    """Texts in groups of near copies of all degrees, exact copies and short ones."""
    r = random.Random(seed)
    texts = ["", " ", "a b", "A b", "a b c"]
    for _ in range(groups):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(5, 60))]
        for _ in range(r.randrange(1, 9)):
            copy = [w if r.random() > r.choice([0, 0.01, 0.03]) else f"x{r.randrange(9)}" for w in base]
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def brute_links(texts, ngram=4, percent=85):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = list(range(len(sets)))
    for _ in label:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label, Counter(k for pair in links for k in pair)


def test_two_full_blocks_are_compared_in_bounded_memory():
    g, random_state = 2 * jaccard.BLOCK, np.random.default_rng(3)
    base = random_state.integers(-2**62, 2**62, 80)
    sets = [np.unique(np.concatenate((base[:52], random_state.choice(base[52:], 5)))) for _ in range(g)]
    sizes = np.array([len(s) for s in sets])
    table = pa.table({
        "cls": np.arange(g)[::-1], "leader": np.zeros(g, np.int64), "block": np.arange(g) % 2, "lo": np.zeros(g, np.int64),
        "hi": np.ones(g, np.int64), "n": sizes.astype(np.int32), "tokens": [s.tobytes() for s in sets],
        "leaders": [[0]] * g, "copies": np.ones(g, np.int64)})
    tracemalloc.start()
    found = jaccard._compare_blocks(table, 85).sort_by("cls")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Intersections, a fragment and its product are 16 MB each; pairs in 64 bits would be 32 MB each.
    assert peak < 70 << 20
    for c in (0, 1, g - 1):
        i = g - 1 - c
        inside = np.array([len(np.intersect1d(sets[i], s)) for s in sets])
        other = np.arange(g) % 2 != i % 2
        assert found["links"][c].as_py() == (other & (100 * inside >= 85 * (sizes[i] + sizes - inside))).sum()


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    given = releasing(iter([1, 2]))
    assert [next(given), next(given), pool.released, list(given), pool.released] == [1, 2, 0, [], 1]
    assert [list(releasing(iter([]))), pool.released] == [[], 2]


@pytest.mark.parametrize("seed,block,frequent,chunk", [(1, 1024, 16, 1 << 21), (2, 3, 2, 300), (3, 2, 3, 50), (4, 5, 2, 1)])
def test_jaccard_join(spark, monkeypatch, seed, block, frequent, chunk):
    """Small blocks, chunks and limits bring every way through the join into play."""
    for name, value in (("BLOCK", block), ("FREQUENT", frequent), ("CHUNK_TOKENS", chunk), ("LIGHT", 2), ("COLUMNS", 16)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard.join(df, fragments=5).collect()}
    sizes, label, links = brute_links(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_links for i in range(len(texts))] == [links[i] for i in range(len(texts))]
    assert len(set(label)) < len(label) - 10


def test_hot_group_of_near_copies(spark):
    """A third of all rows in one group of different texts, most of them not alike enough."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(w if r.random() > 0.04 else f"y{r.randrange(999)}" for w in base) for _ in range(120)]
    texts += [" ".join(f"z{r.randrange(5000)}" for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)[1]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_windows_of_benchmark(spark):
    """Against the plain definition, on texts made of few words so that windows meet by chance."""
    r = random.Random(8)
    items = [" ".join(r.choice("ab") for _ in range(r.choice([1, 2, 3, 5, 12, 13, 14, 20]))) for _ in range(12)] + ["", "..."]
    docs = [" ".join(r.choice(["a", "b", "A", "c", "é"]) for _ in range(r.choice([0, 1, 5, 30, 60]))) for _ in range(40)]
    docs += [f"x {items[i]} y" for i in range(12)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contaminated(d, b).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for i, text in enumerate(docs):
        words, hit, met = split(text), set(), set()
        for j, item in enumerate(items):
            own = split(item)
            size = min(13, len(own))
            for s in range(len(own) - size + 1) if own else ():
                for p in range(len(words) - size + 1):
                    if words[p:p + size] == own[s:s + size]:
                        hit.update(range(p, p + size))
                        met.add(str(j))
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(words), len(hit), sorted(met)), text
        assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if threes[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", " ", "\x1c", "\xa0", "|", "a b a", "\t"]), max_size=30).map("".join))
def test_base_counts(text):
    assert perplexity.base_counts(text) == brute_counts(text)


def brute_kneser_ney(texts, text):
    """Interpolated modified Kneser-Ney by dictionaries, over symbol tuples; the counts of ``text``, one of
    the texts, are taken off the longest runs. Log probabilities of its runs."""
    order = perplexity.ORDER

    def runs(t):
        units = [0] * (order - 1) + list(memoryview(t.encode("utf-16-le")).cast("H"))
        return [tuple(units[i:i + order]) for i in range(len(units) - order + 1)]

    grams = {order: Counter(g for t in texts for g in runs(t))}
    for o in range(order - 1, 0, -1):
        grams[o] = Counter(g[1:] for g in grams[o + 1])
    off = {o: perplexity.discounts(Counter(n for n in grams[o].values() if n <= 4)) for o in grams}

    def parts(gram):
        context = {g: n for g, n in grams[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(context.values())
        return context[gram], total, sum(off[len(gram)][min(n, 3)] for n in context.values()) / total

    def p(gram):
        if not gram:
            return 1 / len(grams[1])
        n, total, spare = parts(gram)
        return (n - off[len(gram)][min(n, 3)]) / total + spare * p(gram[1:])

    own = Counter(runs(text))
    found = []
    for g in runs(text):
        n, total, spare = parts(g)
        n, total = n - own[g], total - sum(m for h, m in own.items() if h[:-1] == g[:-1])
        rest = p(g[1:]) * (spare if total else 1)
        found.append(math.log((n - off[order][min(n, 3)]) / total + rest if total else rest))
    return found


@pytest.mark.parametrize("range_bytes", [1 << 26, 1 << 10])
def test_kneser_ney(spark, monkeypatch, range_bytes):
    """Also where the model is cut into many ranges, whose passes are added up."""
    monkeypatch.setattr(perplexity, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(perplexity, "COUNTED", 40)
    monkeypatch.setattr(perplexity, "GATHERED", 30)
    texts = ["the cat sat on the mat. " * 3, "A dog! éß 12", "", "the dog sat|", "字 mat 字 𝔘 mat", "the dog sat|"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.fit(rows.select("text"))
    assert (model.ranges == 1) == (range_bytes == 1 << 26)
    found = {r.doc_id: r.log_perplexity for r in perplexity.measure(rows, model).collect()}
    assert found.pop(2) is None
    for i, value in found.items():
        assert value == pytest.approx(-np.mean(brute_kneser_ney(texts, texts[i])), abs=1e-5)
    arrays = perplexity.HashArrays.of(model, 0)
    assert (arrays.hashes[1:] > arrays.hashes[:-1]).all()
    # The model has every run of the corpus: it grows with what is read.
    more = rows.select("text").union(spark.createDataFrame([("quite another text",)], "text string"))
    assert perplexity.fit(more).table.count() > model.table.count()


def test_other_scripts_and_reversed_texts_leave_the_band(spark):
    """Letters of any script, digits and marks count as they are."""
    r = random.Random(4)
    stems = ["москва", "река", "дорога", "город", "вода", "земля", "книга", "слово", "время", "человек"]
    text = lambda: " ".join(r.choice(stems) for _ in range(90))
    rows = [(i, text(), "ru") for i in range(60)]
    broken = [(100 + i, "".join(r.sample(t, len(t))).replace("  ", " "), "ru") for i, t in enumerate(text() for _ in range(6))]
    broken += [(200 + i, t[::-1], "ru") for i, t in enumerate(text() for _ in range(6))]
    docs = spark.createDataFrame(rows + broken, "doc_id long, text string, lang string")
    kept = {x.doc_id: x.kept for x in perplexity.apply_rules(docs).collect()}
    assert sum(kept[i] for i in range(60)) >= 58
    assert not any(kept[i] for i, *_ in broken)


def test_bands_reject_what_is_unlike(spark):
    r = random.Random(2)
    words = "the of and to in that was his he it with is for as had you not be her on".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(90)), "en") for i in range(60)]
    rows += [(100, " ".join("".join(r.choice("QWXYZ#$%&*0;é字") for _ in range(6)) for _ in range(90)), "en"), (101, rows[0][1], "xx")]
    got = {r.doc_id: r for r in perplexity.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100].kept and not got[100].base_failed
    assert sum(got[i].kept for i in range(60)) >= 58 and got[101].kept


def test_bands_have_no_switch_by_size(spark, monkeypatch):
    """One more document of a language does not flip the others, and one alone is near the overall band."""
    words = ["60 n_words", "0 word_chars", "0 n_symbols", "0 n_dup_lines", "0 n_repeat_words"]
    many = [(1000 + i, "en", 1.0 + i % 100 / 50) for i in range(400)]

    def judged(rare):
        rows = spark.createDataFrame(many + rare, "doc_id long, lang string, log_perplexity double")
        monkeypatch.setattr(perplexity, "fit", lambda texts: None)
        monkeypatch.setattr(perplexity, "measure", lambda r, model: rows.selectExpr("*", *words))
        docs = rows.select("doc_id", "lang", F.lit("").alias("text"))
        return {r.doc_id: r.kept for r in perplexity.apply_rules(docs).collect()}

    rare = [(i, "xx", 3.0) for i in range(28)] + [(28, "xx", 3.6), (29, "xx", 3.0)]
    fewer, more = judged(rare[:29]), judged(rare)
    assert all(fewer[i] == more[i] for i in fewer)
    rows = spark.createDataFrame(many + [(1, "xx", 9.0)], "doc_id long, lang string, log_perplexity double")
    low, high = {r.lang: (r.low, r.high) for r in perplexity.bands(rows).collect()}["xx"]
    assert low < 2 < high < 9


def test_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 0, None: 500}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    order = sorted(k for k in sizes if k) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, left, capped = {}, sum(sizes.values()), set()
    while True:
        scale = left / sum(w for k, w in weight.items() if k not in capped)
        over = {k for k in sizes if k not in capped and scale * weight[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
        left -= sum(3 * sizes[k] for k in over)
    target = {k: 3 * sizes[k] if k in capped else scale * weight[k] for k in sizes}
    assert got == pytest.approx(target)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_is_near_its_targets_and_repeats(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.choice([0, 1, 5, 20, 300]), r.choice(["hot"] * 4 + ["x", "y", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, keep=["doc_id", "source"]).collect()
    again = mixing.mix(df.repartition(5), keep=["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    taken, target = defaultdict(int), {}
    for row in got:
        assert 0 <= row.copies <= 3
        taken[row.source] += row.size * row.copies
        target[row.source] = row.target
    assert all(abs(taken[s] - target[s]) <= 300 for s in target)
    assert mixing.repeated(df).count() == sum(r.copies for r in got)


def test_repeated_passages(spark):
    r = random.Random(4)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    shared, short = fresh(61), fresh(49)
    texts = [fresh(r.randrange(0, 200)) + shared + fresh(r.randrange(0, 90)) for _ in range(40)]
    texts += [fresh(30) + short + fresh(30) for _ in range(5)] + [fresh(120) for _ in range(20)]
    own = fresh(70)
    texts += [own + fresh(5) + own]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in repeats.find_repeats(df).collect()}
    for i, t in enumerate(texts):
        spans = [tuple(s) for s in got[i].spans]
        if i < 40:
            at = t.index(shared[0])
            assert spans == [(at, at + 61)], i
        else:
            assert spans == [], i


def test_words_alike_in_16_bits_end_a_passage(spark):
    """q318 and q338 have the same upper 16 bits of their hashes; 49 words in common are no passage."""
    first, second = (int(h) >> 48 for h in repeats.WordHashes().of([b"q318", b"q338"]))
    assert first == second
    same = [f"w{i}" for i in range(49)]
    texts = {1: [*same, "q318"], 2: [*same, "q338"], 3: ["q318", *(w + "x" for w in same)], 4: ["q338", *(w + "x" for w in same)]}
    rows = [(i, " ".join([*(f"a{i}.{j}" for j in range(30)), *t, *(f"b{i}.{j}" for j in range(30))])) for i, t in texts.items()]
    found = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_repeated for r in found] == [0] * 4


def test_repeats_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 3)
    r = random.Random(6)
    shared = [f"s{i}" for i in range(80)]
    texts = [[f"{i}u{r.random()}" for _ in range(20)] + shared for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert all([tuple(s) for s in r.spans] == [(20, 100)] for r in repeats.find_repeats(df).collect())


def brute_repeats(texts, size=50):
    """Words inside runs of ``size`` that another text has too."""
    owners = defaultdict(set)
    for i, t in enumerate(texts):
        for s in range(len(t) - size + 1):
            owners[tuple(t[s:s + size])].add(i)
    return [{j for s in range(len(t) - size + 1) if len(owners[tuple(t[s:s + size])]) > 1 for j in range(s, s + size)}
            for t in texts]


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_shared_passages_that_end_in_a_frequent_line(spark, monkeypatch, chunk):
    """The partner with the long left match sorts among the many that share the line only."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    r = random.Random(9)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    hashes = lambda t: gram_hashes(repeats.WordHashes().of([w.encode() for w in t]), 8)
    # A line whose first run of 8 words is nearly always the minimiser.
    line = min((fresh(10) for _ in range(3000)), key=lambda t: hashes(t)[0])
    passage = [fresh(42) for _ in range(12)]
    texts = [fresh(r.randrange(60)) + p + line + fresh(60) for p in passage for _ in range(2)]
    texts += [fresh(60) + line + fresh(60) for _ in range(150)]
    # Copies cut differently, on both sides.
    whole = fresh(200)
    for _ in range(25):
        a = r.randrange(140)
        texts.append(fresh(30) + whole[a:a + r.randrange(49, 120)] + fresh(30))
    r.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: {j for a, b in x.spans for j in range(a, b)} for x in repeats.find_repeats(df).collect()}
    wanted = brute_repeats(texts)
    assert [got[i] for i in range(len(texts))] == wanted and sum(map(bool, wanted)) >= 40


def test_minimisers_by_definition():
    values = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    wanted = {i + int(np.argmin(values[i:i + 7])) for i in range(394)}
    assert repeats.minimisers(values, 7).tolist() == sorted(wanted)
    assert len(gram_hashes(values, 8)) == 393 and not len(gram_hashes(values[:3], 4))


def test_language_encoder_is_binding_and_bundling():
    encoder = language.Encoder(64)
    a, b, s = (encoder.letter(ord(c)) for c in "ab ")
    wanted = np.roll(s, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * s
    assert (encoder.bundle("Ab 12!") == wanted).all()
    assert encoder.bundle("12 !") is None and encoder.bundle("") is None
    assert set(np.unique(a)) == {-1, 1}


def test_language_beyond_the_memo(monkeypatch):
    text = "various words, and others; ключ 字典"
    whole = language.Encoder(64).bundle(text)
    monkeypatch.setattr(language, "MAX_TRIPLES", 3)
    assert (language.Encoder(64).bundle(text) == whole).all()


def test_grammar_rewrites_clauses():
    scorer = toxicity.Scorer({"scum$": 3.0})
    kinds = lambda t: {k for k, v in zip(toxicity.KINDS, scorer.clauses(t)) if v}
    assert kinds("what scum this is") == {"plain"}
    assert kinds("he is not a scum") == {"negated"}
    assert kinds("she said he is scum") == {"reported"}
    assert kinds('he wrote "scum" there') == {"reported"}
    assert kinds("you are scum") == {"targeted"}
    assert kinds("I will kill you") == {"threat"}
    assert kinds("kill time. you see") == set()
    assert kinds("you are nice") == set() and kinds("") == set()


def test_doc_features_match_scorer():
    """Features for learning and the fast way for scoring give one vector."""
    model = quality.train([quality.document_features(b"a b c") + (1,), quality.document_features(b"z!! z!! z!!") + (0,)] * 9,
                          {0: 9, 1: 9})
    text = "one two two one é three|| one".encode()
    used, shares = quality.document_features(text)
    vector = shares @ model.table[used].astype(float)
    assert quality.Scorer(model).scores([text]) == pytest.approx([model.score(vector)], abs=1e-5)
    good, bad = quality.Scorer(model).scores([b"b c a", b"z!! z!! z!! z!!"])
    assert good > 0.7 > bad


def test_word_features_one_by_one():
    words = [b"a", b"abcd", "é".encode(), b"x" * 300]
    buckets, starts, _ = quality.word_features(words)
    for i, word in enumerate(words):
        own = quality.word_features([word])[0]
        end = starts[i + 1] if i + 1 < len(words) else len(buckets)
        assert (buckets[starts[i]:end] == own).all()
        assert len(own) == 1 + len(word) + max(0, len(word) - 1)


def test_predictions_equal_plain_profiles(spark):
    """Bundles, profiles and cosines by plain loops over letter triples."""
    dimensions = 64
    letter = language.Encoder(dimensions).letter

    def plain_bundle(text):
        spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        spaced = re.sub(" +", " ", spaced)
        total = [0] * dimensions
        for i in range(len(spaced) - 2):
            if spaced[i + 1] != " ":
                a, b, c = (letter(ord(x)) for x in spaced[i:i + 3])
                for d in range(dimensions):
                    total[d] += int(a[(d - 2) % dimensions] * b[(d - 1) % dimensions] * c[d])
        return total

    r = random.Random(6)
    words = {"en": ["the", "of", "and", "house"], "de": ["der", "und", "straße", "über"], "fr": ["été", "le", "où", "ça"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 8))) + "! 12", lang)
            for i, lang in enumerate(r.choice(["en", "de", "fr", None]) or "en" for _ in range(45))]
    docs = spark.createDataFrame(rows + [(99, "12 34", None), (98, "der the été", None)], "doc_id long, text string, lang string").repartition(4)
    found = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(docs, F.col("doc_id") % 3 != 1, dimensions=dimensions).collect()}
    profiles = {}
    for i, text, lang in rows:
        if i % 3 != 1:
            profiles[lang] = [a + b for a, b in zip(profiles.get(lang, [0] * dimensions), plain_bundle(text))]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for i, text, _ in [*rows, (98, "der the été", None)]:
        own = plain_bundle(text)
        cosines = {lang: sum(a * b for a, b in zip(own, p)) / norm(own) / norm(p) for lang, p in sorted(profiles.items())}
        best = max(cosines, key=cosines.get)
        share = 1 / sum(math.exp(language.SHARPNESS * (c - cosines[best])) for c in cosines.values())
        assert found[i][0] == best and found[i][1] == pytest.approx(share)
    assert found[99] == ("und", 0.0)
