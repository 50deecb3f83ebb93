import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from docsync.functions import markup, paths, rights, text, urls, values


def one(frame, expr, value, kind="string"):
    return frame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path, expected", [
    ("/", ["/"]), ("/a", ["/", "/a"]), ("/a/b/c", ["/", "/a", "/a/b", "/a/b/c"]),
])
def test_ancestors(frame, path, expected):
    assert one(frame, paths.ancestors, path) == expected


@pytest.mark.parametrize("path, folder, name, ext", [
    ("/a/b.HTML", "/a", "b.HTML", "html"), ("/a.b/c", "/a.b", "c", None),
    ("/a/b.tar.gz", "/a", "b.tar.gz", "gz"), ("/a/.conf", "/a", ".conf", "conf"),
])
def test_path_parts(frame, path, folder, name, ext):
    assert one(frame, paths.folder_of, path) == folder
    assert one(frame, paths.name_of, path) == name
    assert one(frame, paths.extension_of, path) == ext


def test_folder_prefix_is_not_a_parent(frame):
    assert not one(frame, lambda c: paths.is_at_or_below(c, "/a"), "/ab")
    assert one(frame, lambda c: paths.is_at_or_below(c, "/a/"), "/a/b")
    assert one(frame, lambda c: paths.is_at_or_below(c, "/"), "/anything")


@pytest.mark.parametrize("path, expected", [
    ("/r/a b.html", "http://h/x/a%20b.html"), ("/r/a+b/é~*.txt", "http://h/x/a%2Bb/%C3%A9~%2A.txt"),
    ("/r/50%/q?.x", "http://h/x/50%25/q%3F.x"),
])
def test_url_below(frame, path, expected):
    assert one(frame, lambda c: urls.url_below(F.lit("http://h/x/"), F.lit("/r/"), c), path) == expected


def test_url_parts_of_broken_and_partial_urls(frame):
    assert one(frame, lambda c: urls.url_part(c, "query"), "http://h/p") is None
    assert one(frame, lambda c: urls.url_part(c, "host"), "http://[bad") is None
    assert one(frame, lambda c: urls.url_part(c, "authority"), "http://u@h:8/p#f") == "u@h:8"


@pytest.mark.parametrize("raw, expected", [
    ("a\r\nb", "a\nb"), ("  a  \n\n\t \n b ", "a\nb"), ("", ""), (" \n ", ""), ("a  b", "a  b"),
])
def test_normalise_lines(frame, raw, expected):
    assert one(frame, text.normalise_lines, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&nbsp;x", " x"), ("&unknown;", "&unknown;"),
    ("&lt;&gt;&quot;&#39;&middot;&copy;", "<>\"'·©"),
])
def test_decode_entities(frame, raw, expected):
    assert one(frame, text.decode_entities, raw) == expected


def test_decode_entities_covers_named_and_numeric(frame):
    known = [n for n in text.NAMED if n != "NewLine;"]
    whole = "x".join("&" + n for n in known)
    raw = ["&eacute;&#233;&#x41;&#X1F600;&amp;lt;", whole, "&#0;&#xD800;&#99999999;&;&#;&x", "&&amp;&", None]
    got = frame([(r,) for r in raw], "x string").select(text.decode_entities(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [
        "ééA😀&lt;", "x".join(text.NAMED[n] for n in known), raw[2], "&&&", None]


def test_decoded_space_survives_trimming(frame):
    assert one(frame, lambda c: markup.visible_text(c), "<p> &nbsp;a </p>") == " a"


@pytest.mark.parametrize("raw, expected", [
    ("The END, the-end 3x", ["the", "end", "the", "end", "3x"]), ("", []), ("--", []), ("Çé_ß", ["çé", "ß"]),
])
def test_tokenize(frame, raw, expected):
    assert one(frame, text.tokenize, raw) == expected
    assert one(frame, lambda c: text.tokenize(c, ["the"]), raw) == [t for t in expected if t != "the"]


HTML = """<html lang="de"><head><title>T &amp; t</title><!-- <p>no</p> -->
<script>var a = "<p>no</p>";</script><meta name="keywords" content='k, l'><meta name=x content=y>
</head><body class=""><p>one <b>two</b></p><P id=7>
 three
</P><pre>not p</pre></body></html>"""


def test_first_attribute(frame):
    get = lambda *a, **k: one(frame, lambda c: markup.first_attribute(c, *a, **k), HTML)
    assert get("html", "lang") == "de"
    assert get("html", "id") is None
    assert get("table", "id") is None
    assert get("body", "class") is None
    assert get("meta", "name") == "keywords"
    assert get("meta", "content", where=("name", "keywords")) == "k, l"
    assert get("meta", "content", where=("name", "x")) == "y"
    # The first p has no id: the attribute is absent, whatever later elements have.
    assert get("p", "id") is None


def test_element_texts(frame):
    assert one(frame, lambda c: markup.element_texts(c, "p"), HTML) == ["one two", "three"]
    assert one(frame, lambda c: markup.element_texts(c, "title"), HTML) == ["T & t"]
    assert one(frame, lambda c: markup.element_texts(c, "h1"), HTML) == []
    assert one(frame, lambda c: markup.element_texts(c, "p"), None) is None


def test_tag_names_are_checked():
    with pytest.raises(ValueError):
        markup.element_texts(F.col, "p[1]")


def test_visible_text(frame):
    assert one(frame, markup.visible_text, HTML) == "T & t\none two\nthree\nnot p"


def test_version_ticks(frame):
    moment = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert one(frame, values.version_ticks, moment, "timestamp") == 638396640000000000


@pytest.mark.parametrize("operand, condition, test, met", [
    ("a", "eq", "a", True), ("a", "ne", "a", False), ("b", "ne", "a", True), (None, "ne", "a", False),
    ("abc", "contains", "b", True), ("abc", "matches", "^b", False), (None, "is_null", None, True),
    (None, "eq", "a", False),
])
def test_conditions(frame, operand, condition, test, met):
    assert one(frame, lambda c: values.condition_met(c, condition, test), operand) is met


def test_join_values_joins_when_not_empty(frame):
    kind = "array<string>"
    assert one(frame, values.join_values, ["a", None, "b"], kind) == "a, b"
    assert one(frame, values.join_values, [], kind) is None
    assert one(frame, values.join_values, None, kind) is None


def test_info_member(frame):
    assert one(frame, lambda c: values.info_member(c, "a"), '{"a": 1, "b": "x"}') == "1"
    assert one(frame, lambda c: values.info_member(c, "z"), '{"a": 1}') is None
    assert one(frame, lambda c: values.info_member(c, "a"), None) is None


@pytest.mark.parametrize("mask, read_data, any_read", [
    (0x1, True, True), (0x2, False, False), (0x80, False, False), (0x10000, False, True),
    (0x80000000, False, True), (0x40000000, False, False), (0x20000000, False, False),
    (0x10000000, False, True), (0x40000000 | 0x1, True, False), (0x301BF, True, True), (0, False, False),
])
def test_rights(frame, mask, read_data, any_read):
    assert one(frame, rights.grants_read_data, mask, "bigint") is read_data
    assert one(frame, rights.grants_any_read, mask, "bigint") is any_read


def test_every_named_entity(spark):
    names = list(text.NAMED)
    df = spark.createDataFrame([(i, f"a&{n}b&{n[:-1]}c") for i, n in enumerate(names)], "i int, s string")
    found = {r.i: r.d for r in df.select("i", text.decode_entities(F.col("s")).alias("d")).collect()}
    assert found == {i: f"a{text.NAMED[n]}b&{n[:-1]}c" for i, n in enumerate(names)}


def plain_elements(html, tag):
    """Inside of every element, by a stack over the tags."""
    found, stack = [], []
    for m in re.finditer(rf"(?is)</?{tag}(?:\s[^>]*)?/?>", html):
        if m[0].endswith("/>") and not m[0].startswith("</"):
            found.append((m.start(), ""))
        elif not m[0].startswith("</"):
            stack.append(m)
        elif stack:
            opening = stack.pop()
            found.append((opening.start(), html[opening.end():m.start()]))
    return ["".join(re.split("<[^>]*>", inner)) for _, inner in sorted(found)]


def test_nested_elements_end_at_their_own_tag(spark):
    draw = random.Random(4)
    pieces = ["<div>", "<div class='x'>", "</div>", "</DIV >", "<b>", "</b>", "one", "two", "<div/>"]
    pages = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    pages.append("<div>" * 300 + "deep" + "</div>" * 300)
    # Where elements nest; without nesting the first closing tag ends an element.
    pages = [p for p in pages if re.search("(?is)<div(?:\\s[^>]*)?>(?:(?!</div\\s*>).)*<div(?:\\s[^>]*)?>", p)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = {r.i: r.t for r in df.select("i", markup.element_texts(F.col("html"), "div").alias("t")).collect()}
    assert found == {i: plain_elements(p, "div") for i, p in enumerate(pages)} and len(found) > 100
    chosen = markup.element_texts(F.lit("<div>a<div id='k'>b<div>c</div></div></div>"), "div", where=("id", "k"))
    assert spark.range(1).select(chosen.alias("t")).first().t == ["bc"]
