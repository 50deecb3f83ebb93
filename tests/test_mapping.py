from pyspark.sql import functions as F

from docsync.operators import content, mapping
from docsync.schema import FieldSpec, Task

ITEM = "url string, name string, props string, html string, text string, kind string"
PAGE = '<html lang="en"><title>T</title><body><p>one</p><p> two </p></body></html>'


def items(frame):
    return frame([
        ("http://m.x/a?q=1", "a.html", '{"author": "Ann"}', PAGE, "body text", "draft"),
        ("http://x/b", "b.html", None, None, None, None),
    ], ITEM)


SPECS = [
    FieldSpec("page", "url", "job", "url", identity=True),
    FieldSpec("page", "host", "url", "host", is_variable=True),
    FieldSpec("page", "name", "file", "name", task=Task("job", "kind", "eq", "draft", "replace", "!")._replace(
        condition="eq", test="draft")),
    FieldSpec("page", "author", "doc_info", "author"),
    FieldSpec("page", "body", "doc_content", task=Task("variable", "host", "matches", "^m", "set", "mobile")),
    FieldSpec("page", "lang", "file_content", "lang", tag="html"),
    FieldSpec("page", "p", "page_content", tag="p", multi=True,
              task=Task("job", "kind", "eq", "draft", "set", "X")),
    FieldSpec("page", "title", "page_content", tag="title", boost=2.0,
              task=Task("job", "kind", "is_null", None, "set", "none")),
]


def test_map_fields_runs_every_stage(frame):
    got = {r.url: r.asDict() for r in mapping.map_fields(items(frame), SPECS).collect()}
    assert got["http://m.x/a?q=1"] == {
        "url": "http://m.x/a?q=1", "name": "a.html", "author": "Ann", "body": "mobile", "lang": "en",
        "p": ["X", "X"], "title": "T"}
    assert got["http://x/b"] == {
        "url": "http://x/b", "name": "b.html", "author": None, "body": None, "lang": None, "p": None,
        "title": "none"}


def test_mapping_is_one_native_projection(frame):
    plan = mapping.map_fields(items(frame), SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


def test_variables_are_visible_until_dropped(frame):
    seen = mapping.with_variables(items(frame), SPECS)
    assert "host" in seen.columns
    assert "host" not in mapping.drop_variables(seen, SPECS).columns
    assert "host" not in mapping.map_fields(items(frame), SPECS).columns


def test_field_rows_number_repeated_values_and_skip_nulls(frame, rows):
    docs = frame([("k", ["a", None, "b"], None, 5), ("n", None, "t", None)],
                 "url string, p array<string>, title string, size int")
    specs = [SPECS[0], FieldSpec("page", "p", "page_content", tag="p", multi=True),
             FieldSpec("page", "title", "page_content", tag="title", boost=2.0),
             FieldSpec("page", "size", "file", "size")]
    assert rows(mapping.to_field_rows(docs, specs, "url")) == sorted([
        ("k", "url", 0, "k", 1.0), ("k", "p", 0, "a", 1.0), ("k", "p", 1, "b", 1.0), ("k", "size", 0, "5", 1.0),
        ("n", "url", 0, "n", 1.0), ("n", "title", 0, "t", 2.0)], key=repr)


def test_identity_uses_all_identity_fields(frame, rows):
    specs = [FieldSpec("p", "a", "job", identity=True), FieldSpec("p", "b", "job", identity=True)]
    docs = frame([("1", "x"), ("1", None), ("2", "x")], "a string, b string")
    assert mapping.identity_columns(specs) == ["a", "b"]
    assert rows(mapping.identity_key(docs, specs)) == [("1", "x"), ("2", "x")]


def test_job_fields(frame, rows):
    df = mapping.job_fields(frame([("a",)], "path string"), "Page", F.array(F.lit("R")), False)
    assert rows(df) == [("a", "Page", False, ["R"])]


def test_assemble_text_orders_by_number_across_runs(frame, rows):
    n = content.RUN_LENGTH * 2 + 5
    parts = [("long", i, f"w{i}") for i in reversed(range(n))] + [
        ("short", 10, "ten "), ("short", 9, " nine"), ("short", 11, None), ("gone", 0, None)]
    got = dict(rows(content.assemble_text(frame(parts, "doc_key string, pos bigint, text string"))))
    assert got == {"long": " ".join(f"w{i}" for i in range(n)), "short": "nine ten"}


def test_shared_strings(frame, rows):
    cells = frame([("w", 1, True, "0"), ("w", 2, False, " lit "), ("w", 3, True, "9"), ("w", 4, True, "x"),
                   ("w", 5, True, None), ("v", 1, True, "0")],
                  "workbook_id string, pos int, is_shared boolean, raw string")
    strings = frame([("w", 0, " shared\n"), ("w", 1, "other")], "workbook_id string, idx int, text string")
    ok, errors = content.resolve_shared_strings(cells, strings)
    assert rows(ok) == [("w", 1, "shared"), ("w", 2, "lit")]
    assert rows(errors) == [("v", 1, "no shared string 0"), ("w", 3, "no shared string 9"),
                            ("w", 4, "no shared string x")]


def test_shared_strings_in_one_pass(frame, rows):
    cells = frame([("w", 1, True, "0"), ("w", 2, False, " lit "), ("w", 3, True, "9")],
                  "workbook_id string, pos int, is_shared boolean, raw string")
    strings = frame([("w", 0, "shared")], "workbook_id string, idx int, text string")
    ok, errors = content.resolve_shared_strings(cells, strings, once=True)
    for df in (ok, errors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1
    assert (rows(ok), rows(errors)) == ([("w", 1, "shared"), ("w", 2, "lit")], [("w", 3, "no shared string 9")])


def test_body_attribute_tests_tasks_and_shared_names(frame, rows):
    page = ("<html><head><title>T</title><meta name='k' content='no'><META NAME=\"description\" content='d&eacute;'></head>"
            "<body class=b><h1>H</h1><div id='x'>one</div><div id='main'>two</div></body></html>")
    specs = [
        FieldSpec("page", "url", "job", "url", identity=True),
        FieldSpec("page", "body", "page_content", tag="body"),
        FieldSpec("page", "about", "file_content", "content", tag="meta", where=("name", "description")),
        FieldSpec("page", "main", "page_content", tag="div", where=("id", "main")),
        FieldSpec("page", "title", "page_content", tag="title", boost=2.0),
        FieldSpec("page", "title", "page_content", tag="h1"),
        FieldSpec("page", "kind", "job", "url", task=(
            Task("job", "url", "eq", "u", "set", "first"), Task("job", "url", "matches", "u|v", "replace", "x"))),
    ]
    items = frame([("u", page), ("v", "no markup"), ("w", None)], "url string, html string")
    mapped = mapping.map_fields(items, specs)
    assert rows(mapped, "url", "body", "about", "main", "title", "kind") == [
        ("u", "Honetwo", "dé", "two", ["T", "H"], "first"), ("v", None, None, None, [], "x"),
        ("w", None, None, None, [], "w")]
    stored = mapping.to_field_rows(mapped, specs, "url").filter("field = 'title'")
    assert rows(stored, "pos", "value", "boost") == [(0, "T", 2.0), (1, "H", 2.0)]
