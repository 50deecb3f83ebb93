import itertools

import pytest

from docsync.operators import changes, store
from docsync.plans.reconcile import reconcile, sweep, with_eligible
from docsync.sources.files import list_files

FILE = "path string, version bigint, eligible boolean"
INDEX = "path string, version bigint"
K = ["path"]


def tables(frame):
    listing = frame([("new", 1, True), ("same", 1, True), ("edited", 2, True), ("out-new", 1, False),
                     ("out-edited", 2, False), ("unflagged", 1, None)], FILE)
    index = frame([("same", 1), ("edited", 1), ("out-edited", 1), ("gone", 1)], INDEX)
    return listing, index


def test_classify(frame, rows):
    listing, index = tables(frame)
    assert rows(changes.classify_changes(listing, index, K)) == [
        ("edited", 2, "changed"), ("gone", 1, "deleted"), ("new", 1, "created"),
        ("out-edited", 2, "unchanged"), ("same", 1, "unchanged")]


def test_force_changes_every_eligible_indexed_file(frame, rows):
    listing, index = tables(frame)
    forced = changes.classify_changes(listing, index, K, force=True)
    assert rows(forced.filter("action = 'changed'"), "path") == [("edited",), ("same",)]
    assert rows(changes.changed_files(listing, index, K, force=True), "path") == [
        ("edited",), ("out-edited",), ("same",)]
    by_column = listing.selectExpr("*", "path = 'same' AS force")
    assert rows(changes.classify_changes(by_column, index, K, "force").filter("action = 'changed'"), "path") == [
        ("edited",), ("same",)]


def test_single_operators_agree_with_classify(frame, rows):
    listing, index = tables(frame)
    assert rows(changes.deleted_files(index, listing, K), "path") == [("gone",)]
    assert rows(changes.created_files(listing, index, K), "path") == [("new",), ("out-new",), ("unflagged",)]
    assert rows(changes.changed_files(listing, index, K), "path") == [("edited",), ("out-edited",)]


def test_missing_versions_count_as_different(frame, rows):
    listing = frame([("a", 1, True), ("b", None, True)], FILE)
    index = frame([("a", None), ("b", None)], INDEX)
    assert rows(changes.classify_changes(listing, index, K), "path", "action") == [
        ("a", "changed"), ("b", "unchanged")]


def test_composite_keys(frame, rows):
    listing = frame([("w1", "a", 1, True), ("w2", "a", 1, True)], "web string, " + FILE)
    index = frame([("w1", "a", 1)], "web string, " + INDEX)
    assert rows(changes.classify_changes(listing, index, ["web", "path"]), "web", "action") == [
        ("w1", "unchanged"), ("w2", "created")]


def test_one_shuffle_and_no_join_in_classify(frame):
    listing, index = tables(frame)
    plan = changes.classify_changes(listing, index, K)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_removed_subtree_list_and_table_agree(frame, rows):
    docs = frame([("/a/1", "/a"), ("/a/b/2", "/a/b"), ("/ab/3", "/ab")], "path string, dir string")
    for removed in (["/a"], frame([("/a",), ("/zz",)], "dir string")):
        assert rows(changes.removed_subtree(docs, removed), "path") == [("/a/1",), ("/a/b/2",)]
    assert changes.removed_subtree(docs, []).count() == 0


def test_config_changed(frame, rows):
    now = frame([("same", 1), ("other", 2), ("new", 3)], "index string, stamp int")
    was = frame([("same", 1), ("other", 1)], "index string, stamp int")
    assert rows(changes.config_changed(now, was)) == [("new", True), ("other", True), ("same", False)]


def test_dispatch_drops_what_nobody_handles(frame, rows):
    acts = frame([("a", "page", "created"), ("b", "page", "deleted"), ("c", "pdf", "created")],
                 "path string, file_type string, action string")
    got = changes.dispatch_actions(acts, [("page", "created", "h1"), ("pdf", "changed", "h2")])
    assert rows(got, "path", "handler") == [("a", "h1")]


def test_dedup_work(frame, rows):
    work = frame([("h", "w", "p")] * 3 + [("h", "w2", "p")], "handler string, web string, path string")
    assert rows(changes.dedup_work(work)) == [("h", "w", "p"), ("h", "w2", "p")]


DOC = "path string, content string, version bigint"


def test_upsert_is_idempotent_and_delete_undoes_it(frame, rows):
    docs = frame([("a", "1", 1), ("b", "1", 1), ("b", "dup", 1)], DOC)
    new = frame([("b", "2", 2), ("c", "2", 2)], DOC)
    once = store.upsert_docs(docs, new, K)
    assert rows(once) == [("a", "1", 1), ("b", "2", 2), ("c", "2", 2)]
    assert rows(store.upsert_docs(once, new, K)) == rows(once)
    assert rows(store.delete_docs(once, new, K)) == [("a", "1", 1)]
    assert rows(store.delete_docs(docs, new.filter("path = 'c'"), K)) == rows(docs)


def test_exists_and_latest(frame, rows):
    docs = frame([("a", "x", 1), ("a", "y", 2), ("a", "z", 2), ("b", "x", None)], DOC)
    assert rows(store.latest_per_identity(docs, K, "version", "content")) == [("a", "z", 2), ("b", "x", None)]
    assert rows(store.exists_docs(frame([("a",), ("q",)], "path string"), docs, K)) == [("a",)]


def test_a_hot_key_is_cut_down_before_the_shuffle(frame):
    docs = frame([("a", "x", 1)], DOC)
    plan = store.latest_per_identity(docs, K, "version", "content")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_apply_then_classify_is_all_unchanged(frame, rows):
    """Every combination of indexed and listed versions, including absent ones."""
    states = list(itertools.product([None, 1, 2], repeat=2))
    index = frame([(f"p{i}", o) for i, (o, _) in enumerate(states) if o], INDEX)
    listing = frame([(f"p{i}", n, True) for i, (_, n) in enumerate(states) if n], FILE)
    docs = index.selectExpr("path", "'old' AS content", "version")
    mapped = listing.selectExpr("path", "'new' AS content", "version")
    acts = changes.classify_changes(listing, index, K)
    assert acts.count() == 8
    after = store.apply_changes(docs, acts, mapped, K, "version")
    assert rows(after, "path", "version") == rows(listing, "path", "version")
    again = changes.classify_changes(listing, after.select("path", "version"), K)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_a_document_that_could_not_be_mapped_stays(frame, rows):
    docs = frame([("a", "old", 1)], DOC)
    acts = frame([("a", "changed"), ("b", "created")], "path string, action string")
    after = store.apply_changes(docs, acts, frame([], DOC), K, "version")
    assert rows(after) == [("a", "old", 1)]


WEB = ("w", "/r", "http://h/", "^/r/")
TYPES = [("page", "html"), ("doc", "txt")]
DISPATCH = [("page", "created", "map"), ("page", "changed", "map"), ("page", "deleted", "rm"),
            ("doc", "created", "map")]
LISTED = "path string, dir string, ext string, version bigint"


def test_sweep_and_reconcile(frame, rows):
    listing = frame([("/r/a.html", "/r", "html", 2), ("/r/s/b.html", "/r/s", "html", 1),
                     ("/r/x/c.html", "/r/x", "html", 9), ("/r/d.txt", "/r", "txt", 1),
                     ("/r/e.bin", "/r", "bin", 1), ("/r/f.txt", "/r", "txt", 5)], LISTED)
    index = frame([("/r/a.html", "/r", "html", 1), ("/r/x/c.html", "/r/x", "html", 1),
                   ("/r/gone.html", "/r", "html", 1), ("/r/gone.txt", "/r", "txt", 1),
                   ("/r/f.txt", "/r", "txt", 4)], LISTED)
    work = sweep(listing, index, WEB, ["/r/x"], TYPES, DISPATCH, [("/r/s", "S", None)], ["R"])
    assert rows(work, "path", "action", "handler", "url", "roles") == [
        ("/r/a.html", "changed", "map", "http://h/a.html", ["R"]),
        ("/r/d.txt", "created", "map", "http://h/d.txt", ["R"]),
        ("/r/gone.html", "deleted", "rm", "http://h/gone.html", ["R"]),
        ("/r/s/b.html", "created", "map", "http://h/s/b.html", ["S"])]
    docs = index.selectExpr("path", "'old' AS content", "version AS version_ticks")
    contents = frame([("/r/a.html", "A"), ("/r/s/b.html", None), ("/r/d.txt", "D"), ("/r/zzz", "Z")],
                     "path string, content string")

    def handler(items):
        return items.selectExpr("path", "content", "2L AS version_ticks")

    from pyspark.sql import functions as F
    checks = {"content": (F.col("content").isNull(), "no content")}
    after, errors = reconcile(docs, work, contents, {"map": handler}, checks)
    assert rows(after, "path", "content") == [
        ("/r/a.html", "A"), ("/r/d.txt", "D"), ("/r/f.txt", "old"), ("/r/gone.txt", "old"), ("/r/x/c.html", "old")]
    assert rows(errors) == [("/r/s/b.html", "content", "no content")]


def test_sweep_of_a_real_folder(spark, tmp_path, rows):
    from docsync.functions.values import version_ticks
    (tmp_path / "s").mkdir()
    for name in ("a.html", "s/b.html", "c.bin"):
        (tmp_path / name).write_text("x")
    listing = list_files(spark, str(tmp_path)).withColumn("version", version_ticks("modified"))
    empty = listing.limit(0)
    web = ("w", str(tmp_path), "http://h", ".")
    work = sweep(listing, empty, web, [], TYPES, DISPATCH, [], ["R"])
    assert rows(work, "url", "action") == [("http://h/a.html", "created"), ("http://h/s/b.html", "created")]
    assert sweep(listing, listing, web, [], TYPES, DISPATCH, [], ["R"]).count() == 0
    assert with_eligible(listing, [], TYPES).filter("eligible").count() == 2


def test_a_sweep_leaves_other_webs_alone(frame, rows):
    listing = frame([("/r/a.html", "/r", "html", 1)], LISTED)
    index = frame([("/r/a.html", "/r", "html", 1), ("/v/x.html", "/v", "html", 1), ("/r/b.html", "/r", "html", 1)], LISTED)
    work = sweep(listing, index, WEB, [], TYPES, DISPATCH, [], ["R"])
    assert rows(work, "path", "action") == [("/r/b.html", "deleted")]


def test_a_handler_that_is_not_supplied_is_an_error(frame, rows):
    listing = frame([("/r/a.html", "/r", "html", 1), ("/r/d.txt", "/r", "txt", 1)], LISTED)
    work = sweep(listing, listing.limit(0), WEB, [], TYPES, DISPATCH, [], ["R"])
    docs = frame([], "path string, content string, version_ticks bigint")
    contents = frame([("/r/a.html", "A"), ("/r/d.txt", "D")], "path string, content string")
    with pytest.raises(ValueError, match="map"):
        reconcile(docs, work, contents, {"other": lambda items: items})
    keeps_one = lambda items: items.filter("path = '/r/a.html'").selectExpr("path", "content", "1L AS version_ticks")
    after, errors = reconcile(docs, work, contents, {"map": keeps_one})
    assert rows(after, "path") == [("/r/a.html",)]
    assert rows(errors) == [("/r/d.txt", "mapping", "no document")]


def test_equal_versions_keep_the_same_row_in_every_order(frame, rows):
    docs = frame([("a", "x", 1), ("a", "y", 1), ("a", "z", 0)], DOC)
    first = rows(store.latest_per_identity(docs, K, "version"))
    assert first == rows(store.latest_per_identity(docs.orderBy("content", ascending=False).repartition(3), K, "version"))
    assert len(first) == 1 and first[0][2] == 1
