"""The segmented index: any sequence of batches equals an index built anew, and reads no more than it must."""

import random

import pytest
from pyspark.sql import functions as F

from docsync.operators import index as ix
from docsync.operators import search as se
from docsync.plans import segments as sg
from docsync.plans.search import build_index, search
from docsync.schema import FieldSpec

SCHEMA = "id string, title string, content string, roles array<string>, active int"
SPECS = [
    FieldSpec("d", "title", "job", "title", boost=2.0),
    FieldSpec("d", "content", "job", "content", analyzer="standard_stop"),
    FieldSpec("d", "active", "job", "active", analyzer="keyword"),
    FieldSpec("d", "roles", "job", "roles", analyzer="keyword"),
]
STOP = ["the"]


def made(draw, key):
    words = lambda n: " ".join(draw.choice(["red", "fox", "the", "dog", "ran", "far"]) for _ in range(draw.randint(0, n)))
    return (key, words(3), words(25), draw.sample(["A", "B", "C"], draw.randint(0, 2)), draw.randint(0, 1))


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(sg, "BLOCK_BITS", 2)
    monkeypatch.setattr(sg, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(sg, "PAGE_ROWS", 10)


def rebuilt(frame, docs, words, operator, roles, active, k):
    index = build_index(frame(docs, SCHEMA), SPECS, "id", stop_words=STOP)
    return [tuple(r) for r in search(index, words, ["title", "content"], ["title"], roles, active, k=k, operator=operator).collect()]


def found(index, words, operator, roles, active, k, early_stop):
    df = sg.search_segments(index, words, ["title", "content"], ["title"], roles, active, k=k, operator=operator, early_stop=early_stop)
    return [tuple(r) for r in df.collect()]


def batches(spark, frame, root, seed):
    """Writes batches; gives the documents as they are after them."""
    draw = random.Random(seed)
    state = {}
    for step in range(3):
        new = [made(draw, f"k{i}") for i in draw.sample(range(90), 60 if step == 0 else 15)]
        gone = draw.sample(sorted(set(state) - {d[0] for d in new}), 8) + ["unknown"] if step else []
        assert sg.write_segment(spark, root, frame(new, SCHEMA), SPECS, "id", frame([(g,) for g in gone], "id string"),
                                stop_words=STOP, batch=f"b{step}")
        for g in gone:
            state.pop(g, None)
        state.update({d[0]: d for d in new})
    return sorted(state.values())


QUERIES = [("red fox", "and", None, None, 5), ("the dog", "or", ["A"], 1, 4), ("ran far", "and", ["B", "C"], None, 100), ("absent", "or", None, 1, 3), ("the", "and", None, None, 5)]


def test_batches_and_merges_equal_an_index_built_anew(spark, frame, tmp_path, small):
    root = str(tmp_path / "index")
    docs = batches(spark, frame, root, 1)
    index = sg.read_segments(spark, root)
    assert len(index.rows) == 3 and index.n_docs == len(docs)
    expected = {q: rebuilt(frame, docs, *q_args) for q, q_args in enumerate(QUERIES)}
    for q, args in enumerate(QUERIES):
        assert found(index, *args, True) == expected[q]
    stats = build_index(frame(docs, SCHEMA).drop("active", "roles"), SPECS[:2], "id", stop_words=STOP).term_stats
    anew = {tuple(r) for r in stats.collect()}
    assert {tuple(r) for r in sg.merged_stats(index).collect()} == anew
    # The same batch again changes nothing.
    assert not sg.write_segment(spark, root, frame([], SCHEMA), SPECS, "id", batch="b1")
    version = sg.merge_segments(spark, root)
    merged = sg.read_segments(spark, root)
    assert [r.version for r in merged.rows] == [version] and merged.n_docs == len(docs)
    assert merged.table("postings", sg._POSTINGS).count() < index.table("postings", sg._POSTINGS).count()
    assert {tuple(r) for r in sg.merged_stats(merged).collect()} == anew
    for q, args in enumerate(QUERIES[:3]):
        assert found(merged, *args, False) == expected[q]
    # A search that began before goes on over the segments it knows, until they expire.
    assert found(index, *QUERIES[0], True) == expected[0]
    assert len(sg.expire_segments(spark, root)) == 3 and sg.expire_segments(spark, root) == []
    assert not sg.write_segment(spark, root, frame([], SCHEMA), SPECS, "id", batch="b1")
    # And a batch after the merge.
    new = [made(random.Random(9), "k1"), made(random.Random(8), "fresh")]
    sg.write_segment(spark, root, frame(new, SCHEMA), SPECS, "id", stop_words=STOP)
    docs = sorted([d for d in docs if d[0] not in ("k1", "fresh")] + new)
    assert found(sg.read_segments(spark, root), *QUERIES[0], True) == rebuilt(frame, docs, *QUERIES[0])


def test_many_blocks_and_places_go_by_joins(spark, frame, tmp_path, small, monkeypatch):
    root = str(tmp_path / "index")
    docs = batches(spark, frame, root, 2)
    monkeypatch.setattr(sg, "MAX_CONFIG_ROWS", 2)
    index = sg.read_segments(spark, root)
    args = ("red fox", "or", ["A", "B"], 1, 2)
    assert found(index, *args, True) == rebuilt(frame, docs, *args)
    with pytest.raises(ValueError):
        found(index, "red", "or", None, None, 3, True)
    monkeypatch.setattr(sg, "MAX_CONFIG_ROWS", 10)
    with pytest.raises(ValueError):
        sg.search_segments(index._replace(filters=[]), "red", ["title"], [], roles=["A"])


def scanned(df):
    """Rows that each file scan of an executed plan gave out, by the columns read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return [(s.simpleString(10_000), s.metrics().apply("numOutputRows").value()) for s in scans if "FileScan" in s.nodeName() or "Scan parquet" in s.nodeName()]


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_early_stop_and_lookups_read_few_pages(spark, frame, tmp_path, small, plain):
    # Short documents score most: the first blocks tell that the others cannot follow.
    docs = [(f"k{i:04}", "", "red " + "far " * (i // 4), ["A"], 1) for i in range(2000)]
    root = str(tmp_path / "index")
    sg.write_segment(spark, root, frame(docs, SCHEMA).coalesce(2), SPECS, "id")
    index = sg.read_segments(spark, root)
    postings = index.table("postings", sg._POSTINGS)
    clauses = se.word_clauses(["red"], ["content"])
    terms = {"content": ["red"]}
    bounds = sg._bounds(index, clauses, terms, index.table("stats", sg._STATS), "and").orderBy(F.desc("bound"))
    first = bounds.limit(1).collect()
    read = sum(n for _, n in scanned(se._of_clauses(postings, clauses).where(sg._in_blocks(first))))
    assert 0 < read < 200
    best = found(index, "red", "and", None, None, 4, True)
    assert best == found(index, "red", "and", None, None, 4, False) and [b[0] for b in best] == ["k0000", "k0001", "k0002", "k0003"]
    least = best[-1][-1]
    assert bounds.where(F.col("bound") >= least).count() < 5 < bounds.count()
    places = index.docs().where("id in ('k0007', 'k1900')").select(F.col("_segment").alias("segment"), "_place")
    stored = sg._at(index, places, ["id", "content"])
    assert {r.id for r in stored.collect()} == {"k0007", "k1900"}
    content = [n for text, n in scanned(stored) if "content" in text.split("ReadSchema")[1]]
    assert content and sum(content) <= 200


def test_stored_fields_of_hits_read_few_pages(spark, frame, tmp_path, plain):
    rows = [(i, f"text {i}") for i in range(5000)]
    folder = str(tmp_path / "docs")
    frame(rows, "id long, content string").coalesce(1).sortWithinPartitions("id").write.option(
        "parquet.page.row.count.limit", 100).parquet(folder)
    hits = frame([("17", 1.0), ("4000", 3.0), ("-5", 2.0), ("99", 0.5)], "doc_key string, score double")
    shown = se.fetch_fields(hits, spark.read.parquet(folder), ["content"], "id", 3)
    assert sorted(map(tuple, shown.collect())) == [("17", "text 17", 1.0), ("4000", "text 4000", 3.0)]
    (text, read), = scanned(shown)
    assert "PushedFilters: [In(id" in text and read <= 300


def test_segments_refuse_names_and_absent_roots(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="_place"):
        sg.write_segment(spark, str(tmp_path), frame([("a", 1)], "id string, _place int"), SPECS, "id")
    with pytest.raises(ValueError, match="no segment"):
        sg.read_segments(spark, str(tmp_path / "none"))


def test_later_segments_may_add_columns(spark, frame, tmp_path):
    root = str(tmp_path / "index")
    sg.write_segment(spark, root, frame([made(random.Random(1), "a"), ("b", "red", "red", ["A"], 1)], SCHEMA), SPECS, "id")
    wider = frame([("c", "red fox", "", ["A"], 1)], SCHEMA).withColumn("note", F.lit("x"))
    sg.write_segment(spark, root, wider, SPECS, "id")
    df = sg.search_segments(sg.read_segments(spark, root), "red", ["title"], ["note"], ["A"])
    assert {(r.doc_key, r.note) for r in df.collect()} >= {("b", None), ("c", "x")}


def test_texts_are_not_shuffled_by_bitmap(spark, frame, tmp_path, small, monkeypatch):
    """Void documents are told by bitmaps that are sent to the texts; beyond the bound the rows are alike."""
    root, threshold = str(tmp_path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kept = batches(spark, frame, root, 5)
    index = sg.read_segments(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = index.live(index.numbered(index.docs()), "_segment", "_doc_no")
        assert "SortMergeJoin" not in live._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in live.collect()) == [d[0] for d in kept]
        monkeypatch.setattr(sg, "SENT_BITMAPS", 0)
        live = index.live(index.numbered(index.docs()), "_segment", "_doc_no")
        assert "SortMergeJoin" in live._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in live.collect()) == [d[0] for d in kept]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_documents_of_one_file_are_analysed_by_many_tasks(spark, frame, tmp_path):
    docs = frame([(f"k{i}", "fox", "red " * i, [], 1) for i in range(40)], SCHEMA).coalesce(1)
    sg.write_segment(spark, str(tmp_path), docs, SPECS, "id", stop_words=STOP)
    dealt = sg._dealt(sg.read_segments(spark, str(tmp_path)).docs())
    assert len([n for n in dealt.rdd.glom().map(len).collect() if n]) > 1 and dealt.count() == 40


def test_blocks_tell_how_many_documents_have_a_term(spark, frame, tmp_path, small):
    batches(spark, frame, str(tmp_path), 6)
    index = sg.read_segments(spark, str(tmp_path))
    counted = index.table("blocks", sg._BLOCKS).groupBy("field", "term").agg(F.sum("n").alias("df"))
    stored = ix.term_stats(index.table("postings", sg._POSTINGS))
    assert sorted(counted.collect()) == sorted(stored.collect())


def test_texts_and_single_postings_are_not_shuffled(spark, frame, tmp_path, plain):
    """What is shuffled by term is a row per term and block of documents, not one per posting; old versions of
    documents are found without a shuffle of texts; and shuffle files go with the result they are made for."""
    root, docs = str(tmp_path), [(f"k{i}", "fox", "red " * (i % 7 + 1) + f"w{i % 5}", ["A"], 1) for i in range(400)]
    sg.write_segment(spark, root, frame(docs, SCHEMA), SPECS, "id")
    index = sg.read_segments(spark, root)
    numbered = index.numbered(index.docs())
    lists = sg._analysed_lists(numbered, SPECS[:2], [])
    postings = index.table("postings", sg._POSTINGS)
    assert "Exchange hash" not in lists._jdf.queryExecution().executedPlan().toString()
    assert postings.count() == 1200 and lists.count() < 60
    every = index.docs().select(F.col("_segment").alias("segment"), "_place").count()
    dead = sg._bitmaps(numbered.where("id in ('k3', 'k7')").select(F.col("_segment").alias("segment"), F.col("_doc_no").alias("doc_no")), "segment")
    old = sg._of_bitmaps(index, dead)
    assert every == 400 and sorted(r.id for r in old.collect()) == ["k3", "k7"]
    assert "SortMergeJoin" not in old._jdf.queryExecution().executedPlan().toString()


def test_lists_equal_postings_whatever_is_worked_on_at_once(spark, frame, monkeypatch):
    from docsync.operators import lists as pl
    draw = random.Random(4)
    docs = [(i * 3, *made(draw, "")[1:]) for i in range(150)]
    analysed = ix.analyze_fields(frame(docs, SCHEMA.replace("id string", "id bigint")), SPECS[:2], "id", STOP)
    expected = sorted((r.field, r.term, int(r.doc_key), r.tf, r.field_len) for r in ix.build_postings(analysed, False).collect())
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(pl, "AT_ONCE", at_once)
        lists = ix.build_postings(analysed, False, block_bits=4)
        assert sorted(map(tuple, ix.term_stats(lists).collect())) == sorted(map(tuple, ix.term_stats(ix.build_postings(analysed, False)).collect()))
        lists = pl.unpacked(lists)
        rows = pl.postings_of(lists, "field", "term", "block")
        assert sorted((r.field, r.term, r.block * 16 + r.at, r.tf, r.field_len) for r in rows.collect()) == expected
        assert all(abs(r.most - max((t / n) ** 0.5 for t, n in zip(r.tfs, r.lens))) < 1e-12 for r in lists.collect())
