import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from docsync.sources import files, quarantine as qu, snapshots
from docsync.session import shared_folder

FILE = "path string, dir string, ext string"


def test_list_files(spark, tmp_path, rows):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.HTML").write_text("hello")
    (tmp_path / "a" / "b" / "y y.pdf").write_text("")
    (tmp_path / "z").write_text("1")
    root = str(tmp_path)
    listed = files.list_files(spark, root)
    assert rows(listed, "path", "name", "dir", "ext", "length") == sorted([
        (f"{root}/a/x.HTML", "x.HTML", f"{root}/a", "html", 5),
        (f"{root}/a/b/y y.pdf", "y y.pdf", f"{root}/a/b", "pdf", 0),
        (f"{root}/z", "z", root, None, 1),
    ], key=repr)
    assert listed.filter("modified is null").count() == 0
    assert rows(files.list_files(spark, root, "*.pdf"), "name") == [("y y.pdf",)]


def test_listing_covers_empty_and_hidden_files_and_skips_excluded_folders(spark, tmp_path, rows):
    for name in ("_layout.html", ".hidden", "sub/_x/deep.txt", "out/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    listed = files.list_files(spark, str(tmp_path), excluded_dirs=[f"{tmp_path}/out"])
    assert rows(listed, "name", "length") == [(".hidden", 0), ("_layout.html", 0), ("deep.txt", 0)]


def test_listing_of_several_roots_and_uris(spark, tmp_path, rows):
    for name in ("a/1.txt", "b/2.txt", "b/c/3.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = files.list_files(spark, [f"file://{tmp_path}/a", f"{tmp_path}/b/", f"{tmp_path}/gone"])
    assert rows(listed, "name", "dir") == [
        ("1.txt", f"{tmp_path}/a"), ("2.txt", f"{tmp_path}/b"), ("3.md", f"{tmp_path}/b/c")]


def test_listing_by_uri_takes_any_name(spark, tmp_path, rows):
    for name in ("a b/c%20d/1.txt", "a b/e#f?g/2.txt", "a b/\u00e4/3.txt"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("x")
    dirs = [(f"{tmp_path}/a b/c%20d",), (f"{tmp_path}/a b/e#f?g",), (f"{tmp_path}/a b/\u00e4",)]
    for root in (f"{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}/", f"file://{tmp_path}/a b"):
        assert rows(files.list_files(spark, root), "dir") == sorted(dirs, key=repr)


def test_listing_where_hadoop_mounts_a_folder(spark, tmp_path, rows):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "1.txt").write_text("x")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.listed.link./in", f"file://{tmp_path}")
    listed = files.list_files(spark, ["viewfs://listed/in", "viewfs://listed/in/gone/too"])
    assert rows(listed, "path") == [(f"{tmp_path}/a b/1.txt",)]


def test_bare_roots_on_a_cluster_are_those_all_executors_share(spark, tmp_path, rows, monkeypatch):
    root = shared_folder(spark, "tree")
    spark.range(1).coalesce(1).write.parquet(f"{root}/a")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert rows(files.list_files(spark, root, "*.parquet"), "ext") == [("parquet",)]
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path))


def test_exclude_subtrees_list_and_table_agree(frame, rows):
    listed = frame([("/a/1", "/a", ""), ("/a/b/2", "/a/b", ""), ("/ab/3", "/ab", ""), ("/c/4", "/c", "")], FILE)
    tops = ["/a", "/c/d"]
    kept = [("/ab/3",), ("/c/4",)]
    assert rows(files.exclude_subtrees(listed, tops), "path") == kept
    assert rows(files.exclude_subtrees(listed, frame([(t,) for t in tops], "dir string")), "path") == kept
    assert files.exclude_subtrees(listed, []).count() == 4


def test_route_by_extension_ignores_case_and_drops_unowned(frame, rows):
    listed = frame([("/1.HTM", "/", "HTM"), ("/2.txt", "/", "txt"), ("/3", "/", None)], FILE)
    assert rows(files.route_by_extension(listed, [("page", ".Htm")]), "path", "file_type") == [("/1.HTM", "page")]


def test_quarantine_splits_and_reports_every_failure(frame, rows):
    df = frame([("a", None, 1), ("b", "x", -1), ("c", None, -1), ("d", "x", 1), ("e", "x", None)],
               "path string, html string, n int")
    checks = {"fetch": (F.col("html").isNull(), "no page"), "size": (F.col("n") < 0, "negative")}
    ok, errors = qu.quarantine(df, checks)
    assert rows(ok, "path") == [("d",), ("e",)]
    assert rows(errors) == [("a", "fetch", "no page"), ("b", "size", "negative"),
                            ("c", "fetch", "no page"), ("c", "size", "negative")]


def test_quarantine_in_one_pass(spark, frame, rows):
    df = frame([("a", None), ("b", "x")], "path string, html string")
    for part in (df, df.where("false")):
        ok, errors = qu.quarantine(part, {"fetch": (F.col("html").isNull(), "no page")}, once=True)
        assert ok.columns == df.columns
        plan = ok._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(_second" in plan and "LocalTableScan" not in plan
        assert (rows(ok), rows(errors)) == (([("b", "x")], [("a", "fetch", "no page")]) if part is df else ([], []))


DOC = "path string, doc_type string, content string"
MARKS = ", is_deleted boolean, changed_at timestamp, change_id bigint"
DELTA = DOC + MARKS


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)


def test_snapshot_round_trip_and_versions(spark, frame, rows):
    root = shared_folder(spark, "test")
    first = frame([("a", "Page", "1"), ("b", "Image", "2")], DOC)
    snapshots.write_snapshot(first, root, 0, stamps={"i": at(1)})
    snapshots.write_snapshot(first.filter("path = 'a'"), root, 1)
    assert rows(snapshots.read_snapshot(spark, root)) == [("a", "Page", "1")]
    assert rows(snapshots.read_snapshot(spark, root, version=0)) == rows(first)
    assert snapshots.read_snapshot(spark, root).columns == first.columns
    with pytest.raises(ValueError, match="already published"):
        snapshots.write_snapshot(first, root, 1)
    with pytest.raises(ValueError, match="not published"):
        snapshots.read_snapshot(spark, root, version=7)


def test_unpublished_files_are_invisible(spark, frame, rows):
    root = shared_folder(spark, "test")
    docs = frame([("a", "Page", "1")], DOC)
    with pytest.raises(ValueError, match="nothing is published"):
        snapshots.read_snapshot(spark, root)
    snapshots.write_snapshot(docs, root, 0)
    # A write that died before its manifest row: the folder is there, the version is not.
    frame([("b", "Page", "x")], DOC).write.partitionBy("doc_type").parquet(f"{root}/base/v=1")
    assert rows(snapshots.read_snapshot(spark, root)) == rows(docs)
    snapshots.write_snapshot(docs, root, 1)
    assert rows(snapshots.read_snapshot(spark, root)) == rows(docs)


def test_stamps_of_the_newest_base(spark, frame, rows):
    root = shared_folder(spark, "test")
    docs = frame([("a", "Page", "1")], DOC)
    assert snapshots.read_stamps(spark, root) is None
    snapshots.write_snapshot(docs, root, 0, stamps={"i": at(1)})
    snapshots.write_snapshot(docs, root, 1, stamps={"i": at(2), "j": at(3)})
    got = {r["index"]: r.s for r in snapshots.read_stamps(spark, root)
           .select("index", F.unix_seconds("stamp").alias("s")).collect()}
    assert got == {"i": int(at(2).timestamp()), "j": int(at(3).timestamp())}


def test_deltas_lie_over_the_base_whatever_order_they_arrive_in(spark, frame, rows):
    root = shared_folder(spark, "test")
    snapshots.write_snapshot(frame([("a", "Page", "1"), ("b", "Page", "1"), ("c", "Page", "1")], DOC), root, 0)
    late = frame([("a", "Page", "3", False, at(9), 9), ("b", None, None, True, at(9), 9)], DELTA)
    early = frame([("a", "Page", "2", False, at(5), 5), ("b", "Page", "2", False, at(5), 5),
                   ("d", "Page", "2", False, at(5), 5)], DELTA)
    assert snapshots.write_delta(late, root, 0)
    assert snapshots.write_delta(early, root, 1)
    assert not snapshots.write_delta(early.limit(0), root, 1)
    expected = [("a", "Page", "3"), ("c", "Page", "1"), ("d", "Page", "2")]
    assert rows(snapshots.read_snapshot(spark, root)) == expected
    assert snapshots.compact(spark, root) == 1
    assert rows(snapshots.read_snapshot(spark, root)) == expected
    assert snapshots.read_delta_changes(spark, root, ["path"]) is None
    assert os.path.isdir(f"{root}/delta")
    snapshots.write_delta(frame([("c", None, None, True, at(1), 1)], DELTA), root, 2)
    assert rows(snapshots.read_snapshot(spark, root)) == [("a", "Page", "3"), ("d", "Page", "2")]


def test_bucketed_base_stays_in_place_while_it_is_updated(spark, frame, rows):
    from docsync.operators.store import upsert_docs

    root = shared_folder(spark, "test")
    docs = frame([(f"p{i}", "Page", "1") for i in range(50)], DOC)
    snapshots.write_snapshot(docs, root, 0, buckets=4)
    stored = snapshots.read_snapshot(spark, root)
    assert rows(stored) == rows(docs)
    incoming = frame([("p1", "Page", "2"), ("q", "Page", "2")], DOC).repartition(4, "path")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert_docs(stored, incoming, ["path"]).repartition(4, "path")
        physical = plan._jdf.queryExecution().executedPlan().toString()
        # Only the incoming rows move: once as keys, once as rows.
        assert physical.count("Exchange") == 2 and "Bucketed: true" in physical
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = sorted([("p1", "Page", "2"), ("q", "Page", "2")] + [r for r in rows(docs) if r[0] != "p1"], key=repr)
    snapshots.write_snapshot(upsert_docs(stored, incoming, ["path"]), root, 1, buckets=4)
    assert rows(snapshots.read_snapshot(spark, root)) == expected
    snapshots.write_delta(frame([("q", None, None, True, at(1), 1)], DELTA), root, 0)
    assert snapshots.compact(spark, root) == 2
    after = snapshots.read_snapshot(spark, root)
    assert rows(after) == [r for r in expected if r[0] != "q"]
    grouped = after.groupBy("path").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert snapshots.read_snapshot(spark, root, version=0).count() == 50


def test_compact_keeps_stamps_layout_and_columns(spark, frame, rows):
    root = shared_folder(spark, "test")
    base = frame([("a", "Page", "1", "old")], DOC + ", note string")
    snapshots.write_snapshot(base, root, 0, stamps={"i": at(1)}, partition_by=["doc_type"])
    snapshots.write_delta(frame([("b", "Page", "2", "kw", False, at(2), 2)], DOC + ", keywords string" + MARKS), root, 0)
    snapshots.write_delta(frame([("c", "Page", "3", False, at(3), 3)], DELTA), root, 1)
    expected = [("a", "1", "old", None), ("b", "2", None, "kw"), ("c", "3", None, None)]
    for _ in range(3):
        assert rows(snapshots.read_snapshot(spark, root), "path", "content", "note", "keywords") == expected
        snapshots.compact(spark, root)
    assert [r["index"] for r in snapshots.read_stamps(spark, root).collect()] == ["i"]


def test_late_events_lose_after_compact(spark, frame, rows):
    root = shared_folder(spark, "test")
    snapshots.write_snapshot(frame([("a", "Page", "1"), ("b", "Page", "1")], DOC), root, 0, buckets=2)
    snapshots.write_delta(frame([("a", "Page", "9", False, at(9), 9), ("b", None, None, True, at(9), 9)], DELTA), root, 0)
    snapshots.compact(spark, root)
    late = [("a", "Page", "2", False, at(2), 2), ("b", "Page", "2", False, at(2), 2), ("c", "Page", "2", False, at(2), 2)]
    snapshots.write_delta(frame(late, DELTA), root, 1)
    for _ in range(2):
        assert rows(snapshots.read_snapshot(spark, root)) == [("a", "Page", "9"), ("c", "Page", "2")]
        snapshots.compact(spark, root)
    snapshots.write_delta(frame([("b", "Page", "10", False, at(10), 10)], DELTA), root, 2)
    assert ("b", "Page", "10") in rows(snapshots.read_snapshot(spark, root))


def test_a_bucketed_base_is_not_shuffled_when_read(spark, frame):
    root = shared_folder(spark, "test")
    snapshots.write_snapshot(frame([(f"p{i}", "Page", "1") for i in range(20)], DOC), root, 0, buckets=4)
    snapshots.write_delta(frame([("p1", "Page", "2", False, at(2), 2)], DELTA), root, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = snapshots.read_snapshot(spark, root)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Every scan of the base feeds its join directly: no exchange has a bucketed scan right below it.
    lines = plan.splitlines()
    below = [lines[i:i + 4] for i, line in enumerate(lines) if "Exchange" in line]
    assert below and not any("Bucketed: true" in part for lines in below for part in lines)


def test_a_path_outside_the_root_has_no_url(frame, rows):
    df = frame([("/r/a b",), ("/v/x",), ("/rx/y",)], "path string")
    assert rows(files.derive_url(df, "http://h/", "/r"), "url") == [("http://h/a%20b",), (None,), (None,)]


def test_expired_versions_leave_what_readers_need(spark, frame, rows):
    root = shared_folder(spark, "test")
    assert snapshots.expire_versions(spark, root) == []
    snapshots.write_snapshot(frame([("a", "Page", "1"), ("b", "Page", "2")], DOC), root, 0)
    change = lambda *r: frame([r], DELTA)
    snapshots.write_delta(change("a", "Page", "3", False, at(1), 1), root, 1)
    assert snapshots.expire_versions(spark, root) == []
    snapshots.compact(spark, root)
    snapshots.write_delta(change("b", None, None, True, at(2), 2), root, 2)
    # An attempt that was never published, and one that may still be at work.
    frame([("x", "y", "z")], DOC).write.parquet(f"{root}/delta/v=1-lost")
    frame([("x", "y", "z")], DOC).write.parquet(f"{root}/delta/v=3-new")
    before = rows(snapshots.read_snapshot(spark, root))
    assert snapshots.expire_versions(spark, root, keep=2) == ["delta/v=1-lost"]
    gone = snapshots.expire_versions(spark, root)
    assert [g.split("-")[0] for g in gone] == ["base/v=0", "delta/v=1"]
    assert rows(snapshots.read_snapshot(spark, root)) == before == [("a", "Page", "3")]
    assert snapshots._manifest(spark, root).count() == 2
    # A batch that is written again after its delta went is folded already and changes nothing.
    snapshots.write_delta(change("a", "Page", "3", False, at(1), 1), root, 1)
    assert rows(snapshots.read_snapshot(spark, root)) == before
    with pytest.raises(ValueError):
        snapshots.expire_versions(spark, root, 0)
