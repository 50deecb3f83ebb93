from docsync.operators import access

CONF = "dir string, allow string, deny string"


def test_roles_inherit_replace_and_deny(frame, rows):
    dirs = frame([(d,) for d in ("/", "/a", "/a/b", "/a/b/c", "/d", "/e/f", "/g", "/a/b")], "dir string")
    conf = [("/a", "A,B,B", None), ("/a/b", None, "B"), ("/d", "C", "C"), ("/e", "", None), ("/g", "x, y", "y")]
    expected = [("/", ["R", "S"]), ("/a", ["A", "B", "B"]), ("/a/b", ["A"]), ("/a/b/c", ["A"]), ("/d", []),
                ("/e/f", [""]), ("/g", ["x", " y"])]
    assert rows(access.inherit_roles(dirs, conf, ["R", "S"])) == sorted(expected, key=repr)
    assert rows(access.inherit_roles(dirs, frame(conf, CONF), ["R", "S"])) == sorted(expected, key=repr)


def test_deny_on_the_root(frame, rows):
    dirs = frame([("/a",)], "dir string")
    assert rows(access.inherit_roles(dirs, [("/", None, "S")], ["R", "S"])) == [("/a", ["R"])]
    assert rows(access.inherit_roles(dirs, [], ["R"])) == [("/a", ["R"])]


ACL = [("f", "u", 1, "allow"), ("f", "u", 3, "deny"), ("f", "v", 1, "allow"), ("f", "v", 2, "deny"),
       ("f", "w", 2, "allow"), ("g", "u", 1, "deny")]


def acl(frame):
    return frame(ACL, "path string, account string, rights bigint, entry_type string")


def test_deny_wins_unless_told_otherwise(frame, rows):
    assert rows(access.read_rights(acl(frame))) == [
        ("f", "u", False), ("f", "v", True), ("f", "w", False), ("g", "u", False)]
    assert rows(access.read_rights(acl(frame), deny_aware=False)) == [
        ("f", "u", True), ("f", "v", True), ("f", "w", False), ("g", "u", True)]


def test_authorized_groups(frame, rows):
    assert rows(access.authorized_groups(acl(frame), "v;u")) == [("f", ["v"])]
    assert rows(access.authorized_groups(acl(frame), ["v", "u"], deny_aware=False)) == [
        ("f", ["u", "v"]), ("g", ["u"])]


def test_visible_to(frame, rows):
    docs = frame([("a", ["A", "B"]), ("b", ["C"]), ("c", []), ("d", None)], "path string, roles array<string>")
    caller = frame([("B",), ("C",), ("C",)], "role string")
    assert rows(access.visible_to(docs, ["B", "Z"]), "path") == [("a",)]
    assert rows(access.visible_to(docs, []), "path") == []
    assert rows(access.visible_to(docs, caller), "path") == [("a",), ("b",)]
