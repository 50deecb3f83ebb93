import datetime as dt
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from docsync.schema import CHANGE_EVENTS
from docsync.session import shared_folder
from docsync.sources import snapshots
from docsync.streaming import debounce, events, sync

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
WEBS = [("w", "/r", "http://h", r"^/r/"), ("v", "/v", "http://v", r"\.html$")]
TYPES = [("page", "html")]
DISPATCH = [("page", "created", "map"), ("page", "changed", "map"), ("page", "deleted", "rm")]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def event(i, sec, path, kind, is_dir=False, web="w"):
    return (i, at(sec), web, path, is_dir, kind)


def test_route_events(frame, rows):
    found = events.route_events(frame([
        event(1, 1, "/r/a.HTML", "Created"), event(2, 2, "/r/b.txt", "Created"), event(3, 3, "/q/a.html", "Changed"),
        event(4, 4, "/r/a b.html", "Deleted"), event(5, 5, "/r/a.html", "Renamed"), event(6, 6, "/r/d.html", "Created", True),
        event(7, 7, "/v/x.html", "Changed", web="v"), event(8, 8, "/r/a.html", "Changed", web="unknown"),
    ], CHANGE_EVENTS), WEBS, TYPES, DISPATCH)
    assert rows(found, "event_id", "action", "handler", "url") == [
        (1, "created", "map", "http://h/a.HTML"), (4, "deleted", "rm", "http://h/a%20b.html"),
        (7, "changed", "map", "http://v/x.html")]


def test_latest_event_by_time_then_id(frame, rows):
    found = events.latest_event(frame([
        event(1, 5, "a", "Deleted"), event(2, 5, "a", "Created"), event(9, 4, "a", "Changed"), event(3, 1, "b", "Deleted")],
        CHANGE_EVENTS))
    assert rows(found, "path", "change_type") == [("a", "Created"), ("b", "Deleted")]


def test_folder_events(frame, rows):
    files = "path string, dir string"
    listing = frame([("/a/1", "/a"), ("/a/b/2", "/a/b"), ("/ab/3", "/ab")], files)
    index = frame([("/a/1", "/a"), ("/a/old", "/a"), ("/c/4", "/c")], files)
    found = events.folder_events(frame([
        event(1, 1, "/a", "Deleted", True), event(2, 2, "/a", "Created", True), event(3, 3, "/a/b", "Created", True),
        event(4, 4, "/c/d", "Deleted", True), event(5, 5, "/ab", "Created")], CHANGE_EVENTS), listing, index)
    assert rows(found, "event_id", "path", "change_type") == [
        (1, "/a/1", "Deleted"), (1, "/a/old", "Deleted"), (2, "/a/1", "Created"), (3, "/a/b/2", "Created")]
    last = events.latest_event(found)
    assert rows(last, "path", "change_type") == [("/a/1", "Created"), ("/a/b/2", "Created"), ("/a/old", "Deleted")]


def fold(times, gap):
    """Brute force over the sorted (time, id) pairs of one key."""
    windows = []
    for t, i in sorted(times):
        if windows and t < windows[-1][0] + gap:
            windows[-1][1] += 1
            windows[-1][2] = i
        else:
            windows.append([t, 1, i])
    return [tuple(w) for w in windows]


def random_events(seed, spread, n):
    """Keys of many shapes: sparse, dense, bursts at one moment, times on block edges; one hot key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 5 + ["k1", "k2", "k3"])
        micros = rng.choice([
            rng.randrange(spread), rng.randrange(spread) // 7 * 7, rng.randrange(spread) // 1024 * 1024,
            rng.randrange(max(1, spread // 50))])
        # Moments before 1970 as well.
        rows.append((key, micros - spread // 3, i))
    return rows


@pytest.mark.parametrize("gap_us, spread", [(7, 300), (1500, 300_000), (5_000_000, 10**9), (10_000_000, 10**7)])
@pytest.mark.parametrize("fold_limit", [0, 100, 1000])
def test_debounce_against_brute_force(frame, monkeypatch, gap_us, spread, fold_limit):
    """All keys by pointers, small keys folded and the hot one by pointers, all keys folded."""
    monkeypatch.setattr(debounce, "FOLD_LIMIT", fold_limit)
    made = random_events(gap_us, spread, 600)
    df = frame([(k, t, i) for k, t, i in made], "path string, t bigint, event_id bigint").select(
        "path", F.timestamp_micros("t").alias("ts"), "event_id")
    got = debounce.debounce_events(df, timedelta(microseconds=gap_us), ["path"])
    found = {(r.path, r.o, r.d, r.n_events, r.last_event) for r in got.select(
        "path", F.unix_micros("opened").alias("o"), F.unix_micros("due").alias("d"), "n_events", "last_event").collect()}
    expected = {
        (key, o, o + gap_us, n, last)
        for key in {k for k, _, _ in made}
        for o, n, last in fold([(t, i) for k, t, i in made if k == key], gap_us)
    }
    assert found == expected


def test_debounce_rejects_no_gap(frame):
    with pytest.raises(ValueError):
        debounce.debounce_events(frame([("a", T0, 1)], "path string, ts timestamp, event_id bigint"), timedelta(0), ["path"])


def drain(query):
    query.awaitTermination()


def test_debounce_stream_equals_batch(spark, frame):
    gap = timedelta(seconds=60)
    rng = random.Random(3)
    made = sorted((rng.randrange(3600), f"p{rng.randrange(6)}", i) for i in range(300))
    made += [(10**6, f"p{k}", 10_000 + k) for k in range(6)] + [(2 * 10**6, "end", 20_000)]
    rows = [("h", "w", p, at(t), i) for t, p, i in made]
    schema = "handler string, web string, path string, ts timestamp, event_id bigint"
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    for n, part in enumerate((rows[:100], rows[100:200], rows[200:300], rows[300:306], rows[306:])):
        frame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")
        stream = spark.readStream.schema(schema).parquet(folder)
        drain(debounce.debounce_stream(stream, gap).writeStream.format("parquet")
              .option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out))
    key = ["path", "opened", "due", "n_events", "last_event"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*key).collect()))
    # The last marker's own window stays open; those of the keys were closed by it.
    batch = debounce.debounce_events(frame(rows, schema), gap).filter("path <> 'end'")
    assert streamed == sorted(map(tuple, batch.select(*key).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce_stream_takes_events_in_any_order(spark, frame, seed):
    """A third of all events under one key, many at one moment, batches shuffled within the delay."""
    gap, rng = timedelta(seconds=60), random.Random(seed)
    made = [(rng.randrange(1800) // rng.choice([1, 1, 30]) * 1, rng.choice(["hot", "p1", "p2", "p3"] + ["hot"] * 1), i) for i in range(900)]
    made.sort(key=lambda e: e[0] + rng.randrange(-290, 290))
    made += [(10**6, "end", 10_000), (2 * 10**6, "end", 20_000)]
    rows = [("h", "w", p, at(t), i) for t, p, i in made]
    schema = "handler string, web string, path string, ts timestamp, event_id bigint"
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    parts = [rows[s:s + 300] for s in range(0, 900, 300)] + [rows[900:901], rows[901:]]
    for n, part in enumerate(parts):
        frame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")
        stream = spark.readStream.schema(schema).parquet(folder)
        drain(debounce.debounce_stream(stream, gap, "600 seconds").writeStream.format("parquet")
              .option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out))
    key = ["path", "opened", "due", "n_events", "last_event"]
    streamed = sorted(map(tuple, spark.read.parquet(out).filter("path <> 'end'").select(*key).collect()))
    batch = debounce.debounce_events(frame(rows, schema), gap).filter("path <> 'end'")
    assert streamed == sorted(map(tuple, batch.select(*key).collect())) and len(streamed) > 60


def test_read_change_events_drops_other_kinds(spark, frame):
    folder, out = shared_folder(spark, "land"), shared_folder(spark, "out")
    frame([event(1, 1, "a", "Created"), event(2, 1, "a", "Renamed")], CHANGE_EVENTS).write.json(folder)
    stream = events.read_change_events(spark, folder, "json")
    drain(stream.writeStream.format("parquet").option("checkpointLocation", out + "-c")
          .trigger(availableNow=True).start(out))
    assert [r.event_id for r in spark.read.parquet(out).collect()] == [1]


CONTENT = [("/r/a.html", "A"), ("/r/b.html", "B"), ("/r/s/c.html", "C"), ("/r/bad.html", None)]
FEED = [
    event(1, 1, "/r/a.html", "Created"), event(2, 2, "/r/b.html", "Created"), event(3, 3, "/r/gone.html", "Created"),
    event(4, 4, "/r/a.html", "Deleted"), event(5, 5, "/r/s/c.html", "Created"), event(6, 6, "/r/bad.html", "Changed"),
    event(7, 7, "/r/b.html", "Deleted"), event(8, 8, "/r/b.html", "Changed"), event(9, 9, "/r/x.txt", "Created"),
]


def run_sync(spark, frame, parts, folders=None, order=None):
    landing, root = shared_folder(spark, "land"), shared_folder(spark, "sync")
    contents = frame(CONTENT, "path string, content string")

    def start():
        return sync.sync_stream(
            events.read_change_events(spark, landing), root, root + "-check",
            lambda wanted: contents.join(wanted, "path", "left_semi"),
            {"map": lambda items: items.select("path", "url", "content")}, WEBS, TYPES, DISPATCH,
            {"content": (F.col("content").isNull(), "no content")}, folders)

    for part in parts:
        frame(part, CHANGE_EVENTS).coalesce(1).write.mode("append").parquet(landing)
        drain(start())
    return root, start


EXPECTED = [("/r/b.html", "B", "http://h/b.html"), ("/r/s/c.html", "C", "http://h/s/c.html")]


def test_sync_stream_equals_batch_for_any_split_and_order(spark, frame, rows):
    splits = ([FEED], [FEED[:4], FEED[4:]], [[e] for e in FEED[5:]] + [FEED[:5]])
    for parts in splits:
        root, _ = run_sync(spark, frame, parts)
        assert rows(snapshots.read_snapshot(spark, root), "path", "content", "url") == EXPECTED
        errors = spark.read.option("recursiveFileLookup", True).parquet(root + "/errors")
        assert rows(errors) == [("/r/bad.html", "content", "no content")]


def test_replayed_batch_changes_nothing(spark, frame, rows):
    root, _ = run_sync(spark, frame, [FEED])
    before = rows(snapshots.read_snapshot(spark, root))
    assert not snapshots.write_delta(snapshots.read_snapshot(spark, root).limit(0), root, 0)
    assert rows(snapshots.read_snapshot(spark, root)) == before


def test_sync_stream_over_a_base_with_folder_events(spark, frame, rows):
    root = shared_folder(spark, "sync")
    base = frame([("/r/old/1.html", "u", "1"), ("/r/keep.html", "u", "k")], "path string, url string, content string")
    feed = frame([event(1, 1, "/r/old", "Deleted", True), event(2, 2, "/r/s", "Created", True)], CHANGE_EVENTS)
    contents = frame(CONTENT, "path string, content string")
    with_dir = F.regexp_replace("path", r"/[^/]*\z", "").alias("dir")
    changes, errors = sync.changes_of_batch(
        feed, lambda wanted: contents, {"map": lambda items: items.select("path", "url", "content")}, WEBS, TYPES,
        DISPATCH, None, contents.select("path", with_dir), base.select("path", with_dir))
    snapshots.write_snapshot(base, root, 0, partition_by=["url"])
    snapshots.write_delta(changes, root, 0)
    assert errors.count() == 0
    assert rows(snapshots.read_snapshot(spark, root), "path", "content") == [("/r/keep.html", "k"), ("/r/s/c.html", "C")]


def test_items_have_the_roles_of_their_folder_and_scratch_goes(spark, frame, rows, tmp_path):
    import os

    from docsync.session import cut_lineage, scratch

    feed = frame([event(1, 1, "/r/b.html", "Created"), event(2, 2, "/r/s/c.html", "Changed")], CHANGE_EVENTS)
    contents = frame(CONTENT, "path string, content string")
    with scratch(spark) as folder:
        changes, errors = sync.changes_of_batch(
            feed, lambda wanted: contents, {"map": lambda items: items.select("path", "url", "content", "roles")},
            WEBS, TYPES, DISPATCH, role_conf=[("/r/s", "S", None)], root_roles=["R"])
        assert rows(changes, "path", "roles") == [("/r/b.html", ["R"]), ("/r/s/c.html", ["S"])]
        assert errors.count() == 0 and os.listdir(folder)
    assert not os.path.exists(folder)
    kept = cut_lineage(contents, "kept")
    assert kept.count() == contents.count()


def test_an_event_for_an_unknown_handler_is_an_error(spark, frame):
    feed = frame([event(1, 1, "/r/b.html", "Created")], CHANGE_EVENTS)
    contents = frame(CONTENT, "path string, content string")
    with pytest.raises(ValueError, match="no handler supplied for map"):
        sync.changes_of_batch(feed, lambda wanted: contents, {"other": lambda i: i}, WEBS, TYPES, DISPATCH)


def test_configuration_may_be_tables(spark, frame, rows):
    feed = frame([event(1, 1, "/r/b.html", "Created"), event(2, 2, "/q/x.bin", "Created")], CHANGE_EVENTS)
    tables = [frame([tuple(r) for r in rows_], schema) for rows_, schema in (
        (WEBS, "web string, root string, base_url string, filter string"), (TYPES, "file_type string, ext string"),
        (DISPATCH, "file_type string, action string, handler string"))]
    assert rows(events.route_events(feed, *tables)) == rows(events.route_events(feed, WEBS, TYPES, DISPATCH))
    assert events.route_events(feed, *tables).count() == 1


def test_the_stream_folds_its_deltas(spark, frame, rows):
    landing, root = shared_folder(spark, "land"), shared_folder(spark, "sync")
    contents = frame(CONTENT, "path string, content string")
    for i, part in enumerate(([event(1, 1, "/r/b.html", "Created")], [event(2, 2, "/r/s/c.html", "Created")])):
        frame(part, CHANGE_EVENTS).coalesce(1).write.mode("append").parquet(landing)
        drain(sync.sync_stream(
            events.read_change_events(spark, landing), root, root + "-check", lambda wanted: contents,
            {"map": lambda items: items.select("path", "url", "content")}, WEBS, TYPES, DISPATCH, compact_every=2))
    assert snapshots.read_delta_changes(spark, root, ["path"]) is None
    assert rows(snapshots.read_snapshot(spark, root), "path") == [("/r/b.html",), ("/r/s/c.html",)]


def test_content_of_the_folders_of_a_batch(spark, frame, monkeypatch):
    folder = shared_folder(spark, "contents")
    rows = [(f"/d{i}", f"/d{i}/{j}.html", f"text {i} {j}") for i in range(6) for j in range(3)]
    frame(rows, "dir string, path string, text string").repartition(1).write.partitionBy("dir").parquet(folder)
    table = spark.read.schema("path string, text string, dir string").parquet(folder)
    wanted = frame([("/d1/0.html",), ("/d4/2.html",), ("/none/1.html",)], "path string")
    found = sync.content_by_folder(table)(wanted)
    assert {r.path for r in found.collect()} == {f"/d{i}/{j}.html" for i in (1, 4) for j in range(3)}
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 2
    assert sync.content_by_folder(table)(wanted.where("false")).count() == 0
    monkeypatch.setattr(sync, "MAX_CONFIG_ROWS", 1)
    assert sorted(r.path for r in sync.content_by_folder(table)(wanted).collect()) == sorted(r.path for r in found.collect())
