import pytest

from docsync.schema import (
    Clause, FieldSpec, Task, check_clauses, check_dispatch, check_file_types, check_role_conf, check_specs,
)
from docsync.session import config_frame, shared_folder

KEY = FieldSpec("page", "url", "job", "url", identity=True)


def test_identity_is_required():
    with pytest.raises(ValueError, match="identity"):
        check_specs([FieldSpec("page", "title", "page_content", tag="title")])


def test_identity_cannot_be_a_variable():
    with pytest.raises(ValueError, match="identity"):
        check_specs([FieldSpec("page", "url", "job", "url", identity=True, is_variable=True)])


def test_field_names_are_unique():
    with pytest.raises(ValueError, match="unique"):
        check_specs([KEY, KEY])


@pytest.mark.parametrize("bad", [
    FieldSpec("page", "x", "nowhere"), FieldSpec("page", "x", "job", analyzer="snowball"),
    FieldSpec("page", "x", "job", task=Task("job", "y", "like")),
    FieldSpec("page", "x", "job", task=Task("job", "y", "eq", "z", "append")),
])
def test_words_are_known(bad):
    with pytest.raises(ValueError, match="is not one of"):
        check_specs([KEY, bad])


def test_variables_must_be_set_before_they_steer():
    late = FieldSpec("page", "v", "url", "host", is_variable=True)
    early = FieldSpec("page", "x", "file", "name", task=Task("variable", "v", "eq", "a", "clear"))
    with pytest.raises(ValueError, match="not set yet"):
        check_specs([KEY, early, late])
    check_specs([KEY, late._replace(source="job", member="url"), early])


def test_configuration_keys_are_unique():
    with pytest.raises(ValueError):
        check_file_types([("a", "HTML"), ("b", ".html")])
    with pytest.raises(ValueError):
        check_dispatch([("a", "created", "x"), ("a", "created", "y")])
    with pytest.raises(ValueError):
        check_dispatch([("a", "renamed", "x")])
    with pytest.raises(ValueError):
        check_role_conf([("/a", "x", None), ("/a", None, "y")])
    with pytest.raises(ValueError):
        check_clauses([Clause("c", "f", "a"), Clause("c", "f", "b")])
    with pytest.raises(ValueError):
        check_clauses([Clause("c", "f", "a", "not")])


def test_config_frame_has_its_size_limit(spark):
    rows = [(str(i), str(i)) for i in range(10_001)]
    with pytest.raises(ValueError, match="table"):
        config_frame(spark, rows, "a string, b string")
    assert config_frame(spark, [], "a string, b string").count() == 0


def test_shared_folder_is_below_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(root) and first != second
