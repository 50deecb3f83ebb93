import math
from collections import Counter

import pytest

from docsync.operators import index as ix
from docsync.operators import search as se
from docsync.plans.search import build_index, index_for_words, read_index, search, write_index
from docsync.schema import Clause, FieldSpec
from docsync.session import shared_folder

SPECS = [
    FieldSpec("d", "id", "job", "id", identity=True, analyzer="keyword"),
    FieldSpec("d", "title", "doc_info", "title", boost=2.0),
    FieldSpec("d", "tags", "doc_info", "tags", multi=True),
    FieldSpec("d", "content", "doc_content", analyzer="standard_stop"),
]
DOCS = [
    ("1", "The Red Fox", ["quick fox", None, "fox"], "the fox runs and the dog sleeps", 1, ["A"]),
    ("2", "Dog", [], "dog dog dog", 1, ["B"]),
    ("3", None, None, "a fox, a dog: a fox-dog", 0, ["A", "B"]),
    ("4", "Fox and dog", None, None, 1, ["A"]),
    ("5", "", ["x"], "...", 1, []),
]


@pytest.fixture(scope="module")
def docs(frame):
    return frame(DOCS, "id string, title string, tags array<string>, content string, active int, roles array<string>")


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs, SPECS, "id", stop_words=["the", "and"])


def expected_tokens():
    import re

    def words(text, stop=()):
        return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in stop]

    out = {}
    for key, title, tags, content, *_ in DOCS:
        out[key, "id"] = [key]
        out[key, "title"] = words(title)
        out[key, "tags"] = [w for t in tags or [] for w in words(t)]
        out[key, "content"] = words(content, ("the", "and"))
    return {k: v for k, v in out.items() if v}


def test_analyse_and_lengths(docs, rows):
    analysed = ix.analyze_fields(docs, SPECS, "id", ["the", "and"])
    assert {(r.doc_key, r.field): r.terms for r in analysed.collect()} == expected_tokens()
    assert {(k, f): n for k, f, n in rows(ix.field_lengths(analysed))} == {
        k: len(v) for k, v in expected_tokens().items()}


def test_postings_with_and_without_positions(docs, index, rows):
    expected = []
    for (key, field), terms in expected_tokens().items():
        for term, tf in Counter(terms).items():
            at = [i for i, t in enumerate(terms) if t == term]
            expected.append((field, term, key, tf, len(terms), at))
    assert rows(index.postings) == sorted(expected, key=repr)
    analysed = ix.analyze_fields(docs, SPECS, "id", ["the", "and"])
    plain = [e[:-1] for e in expected]
    assert rows(ix.build_postings(analysed, with_positions=False)) == sorted(plain, key=repr)
    some = rows(ix.postings_of_terms(analysed, ["fox", "dog", "fox", "nowhere"]))
    assert some == sorted((e for e in plain if e[1] in ("fox", "dog")), key=repr)


def test_postings_are_built_without_a_shuffle(docs):
    plan = ix.build_postings(ix.analyze_fields(docs, SPECS, "id"))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Python" not in plan.toString()


def test_term_stats_and_count(index, rows):
    df = Counter((f, t) for (_, f), terms in expected_tokens().items() for t in set(terms))
    assert {(f, t): n for f, t, n in rows(index.term_stats)} == dict(df)
    assert rows(ix.document_count(index.docs)) == [(5,)]


def must(*terms):
    return [Clause(f"m{i}", "content", t) for i, t in enumerate(terms)]


def test_bool_query(index, rows):
    p = index.postings
    should = Clause("s", "title", "fox", "should")
    assert rows(se.bool_query(p, must("fox", "dog"))) == [("1", 2, 0), ("3", 2, 0)]
    assert rows(se.bool_query(p, must("fox", "dog") + [should])) == [("1", 2, 1), ("3", 2, 0)]
    assert rows(se.bool_query(p, [should, Clause("t", "content", "sleeps", "should")])) == [("1", 0, 2), ("4", 0, 1)]
    assert rows(se.bool_query(p, must("fox", "cat"))) == []
    assert rows(se.bool_query(p, [])) == []
    # One term asked for by two clauses satisfies both.
    assert rows(se.bool_query(p, must("sleeps", "sleeps"))) == [("1", 2, 0)]


def test_multi_field_query(index, rows):
    p = index.postings
    assert rows(se.multi_field_query(p, ["fox", "dog"], ["title", "content"])) == [("1",), ("3",), ("4",)]
    assert rows(se.multi_field_query(p, ["fox", "dog"], ["title"])) == [("4",)]
    assert rows(se.multi_field_query(p, ["red", "sleeps"], ["title", "content"])) == []
    assert rows(se.multi_field_query(p, [], ["title"])) == []


def brute_force(clauses, n_docs=5):
    tokens = expected_tokens()
    df = Counter((f, t) for (_, f), terms in tokens.items() for t in set(terms))
    out = {}
    for key in {k for k, _ in tokens}:
        hit = [c for c in clauses if c.term in tokens.get((key, c.field), [])]
        if any(c.occur == "must" and c not in hit for c in clauses) or not hit:
            continue
        total = 0.0
        for c in hit:
            terms = tokens[key, c.field]
            idf = 1 + math.log(n_docs / (df[c.field, c.term] + 1))
            total += math.sqrt(terms.count(c.term)) * idf**2 * c.boost / math.sqrt(len(terms))
        out[key] = round(total * len(hit) / len(clauses), 6)
    return out


def test_score_against_brute_force(docs, index, rows):
    clauses = must("fox") + [Clause("s", "title", "fox", "should", 2.0), Clause("t", "content", "dog", "should")]
    expected = sorted(brute_force(clauses).items())
    assert rows(se.score(index.postings, clauses, index.term_stats, index.n_docs)) == expected
    assert rows(se.score(index.postings, clauses, index.term_stats, 5)) == expected
    lengths = ix.field_lengths(ix.analyze_fields(docs, SPECS, "id", ["the", "and"]))
    bare = index.postings.drop("field_len")
    assert rows(se.score(bare, clauses, index.term_stats, 5, lengths)) == expected
    assert rows(se.score(index.postings, [], index.term_stats, 5)) == []


def test_top_k_breaks_ties_by_key(frame):
    scored = frame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "doc_key string, score double")
    assert [r.doc_key for r in se.top_k(scored, 2).collect()] == ["c", "a"]
    assert [r.doc_key for r in se.top_k(scored, None).collect()] == ["c", "a", "b"]
    assert se.total_hits(scored).first().total_hits == 3


def test_query_words():
    assert se.query_words("Red fox, RED_dog!") == ["red", "fox", "dog"]
    assert se.query_words("  ") == []


def test_search_filters_and_ranks(index):
    def keys(words, **kw):
        return [r.doc_key for r in search(index, words, ["title", "content"], ["title"], **kw).collect()]

    assert set(keys("fox dog", active=None)) == {"1", "3", "4"}
    assert set(keys("fox dog")) == {"1", "4"}
    assert keys("dog", roles=["B"]) == ["2"]
    assert keys("dog", roles=["B"], active=None) == ["2", "3"]
    assert keys("fox", k=1, active=None) == keys("fox", k=None, active=None)[:1]
    assert keys("nothing here") == [] == keys("")
    assert set(search(index, "fox", ["title"], ["title"]).columns) == {"doc_key", "title", "score"}


def test_stored_and_per_query_indexes_give_the_same_hits(spark, docs, index):
    folder = shared_folder(spark, "index")
    write_index(index, folder)
    stored = read_index(spark, folder, docs, "id")
    adhoc = index_for_words(docs, SPECS, "id", "fox dog", ["the", "and"])
    hits = [[tuple(r) for r in search(i, "fox dog", ["title", "content"], ["tags"], active=None, k=None).collect()]
            for i in (index, stored, adhoc)]
    assert len(hits[0]) == 3 and hits[0] == hits[1] == hits[2]


def test_terms_reach_the_scan_of_stored_postings(spark, docs, index):
    folder = shared_folder(spark, "index")
    write_index(index, folder)
    stored = read_index(spark, folder, docs, "id")
    plan = se.bool_query(stored.postings, must("fox", "dog"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert "In(term, [dog,fox])" in pushed and "positions" not in plan


def test_words_are_analysed_as_their_field_was(spark, frame, tmp_path):
    docs = frame([("1", "the fox", "de-DE", 1, ["A"]), ("2", "the dog", "en", 1, ["B"]), ("3", "Fox", "en", 0, ["A"])],
                 "id string, content string, lang string, active int, roles array<string>")
    specs = [FieldSpec("d", "content", "job", "content", analyzer="standard_stop", boost=3.0),
             FieldSpec("d", "lang", "job", "lang", analyzer="keyword"),
             FieldSpec("d", "active", "job", "active", analyzer="keyword"),
             FieldSpec("d", "roles", "job", "roles", analyzer="keyword")]
    built = build_index(docs, specs, "id", stop_words=["the"])
    write_index(built, str(tmp_path / "index"))
    for index in (built, read_index(spark, str(tmp_path / "index"), docs, "id")):
        find = lambda words, fields, **kw: sorted(r.doc_key for r in search(index, words, fields, ["lang"], **kw).collect())  # noqa: B023,E731
        assert find("the fox", ["content"]) == ["1"]
        assert find(["Fox"], ["content"], active=None) == ["1", "3"]
        assert find("de-DE", ["lang"]) == ["1"] and find("de-de", ["lang"]) == []
        assert find("fox dog", ["content"]) == [] and find("fox dog", ["content"], operator="or") == ["1", "2"]
        assert find("the", ["content"]) == []
        assert find("fox dog", ["content"], operator="or", roles=["B"]) == ["2"]
        roles = frame([("A",), ("Z",)], "role string")
        assert find("fox dog", ["content"], operator="or", roles=roles, active=None) == ["1", "3"]
    stored = read_index(spark, str(tmp_path / "index"), docs, "id")
    unboosted = search(stored, "fox", ["content"], ["lang"], boosts={}).first().score
    assert round(search(stored, "fox", ["content"], ["lang"]).first().score / unboosted, 3) == 3.0


def test_a_stored_index_reads_documents_for_shown_rows_only(spark, frame, tmp_path):
    frame([("1", "fox", 1)], "id string, content string, active int").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    specs = [FieldSpec("d", "content", "job", "content"), FieldSpec("d", "active", "job", "active", analyzer="keyword")]
    write_index(build_index(docs, specs, "id"), str(tmp_path / "index"))
    found = search(read_index(spark, str(tmp_path / "index"), docs, "id"), "fox", ["content"], ["content"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Locations are shortened in plans, so scans are told by what they read.
    assert plan.count("ReadSchema: struct<id:string,content:string>") == 1 and plan.count("active:int") == 0
