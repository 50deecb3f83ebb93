"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from docsync.llm import (
    contamination, jaccard, language, mixing, perplexity, phrases, quality, repeats, secret_scan, sharding,
    spelling, tokens, toxicity,
)

PROSE = " ".join(f"word{i % 37} tail{i % 11}" for i in range(60))
LONG = " ".join(f"long{i}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (None, PROSE, None, None),
    (3, None, "en", "a"), (4, "", None, "b"), (5, "  \n\t ", "de", "b"), (6, LONG, "de", None),
    (None, None, None, None), (7, "one", "en", "b"), (8, "token = \"0123456789abcdef0123456789\"", "en", "b"),
]
# Names that the operators use inside.
CLASH = """key hash token cls part kind copy n score label place size target copies class bucket draw
words start end item_id spans leader near before rank position epochs run order row_id kept_0 key_id key_hash shard slot
law ids id word a l r lang_ first last form root role node block heads tails""".split()
NOTHING = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (None, 1, 1), (99, 0, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(PROSE.split()[:20])), (1, "one"), (None, " ".join(LONG.split()[5:25])), (3, None), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("token", F.lit(1))


def anyone(column):
    return F.lit(True)


OPERATORS = {
    "tokens": lambda d, l, b: tokens.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "toxicity": lambda d, l, b: toxicity.score(d, toxicity.fit(d, l, anyone)),
    "jaccard": lambda d, l, b: jaccard.join(d),
    "perplexity": lambda d, l, b: perplexity.apply_rules(d),
    "quality": lambda d, l, b: quality.score(d, quality.fit(d, l, anyone)),
    "language": lambda d, l, b: language.identify(d, F.lit(True)),
    "secrets": lambda d, l, b: secret_scan.scan(d),
    "contamination": lambda d, l, b: contamination.contaminated(d, b),
    "mixing": lambda d, l, b: mixing.mix(d),
    "repeats": lambda d, l, b: repeats.find_repeats(d),
    "sharding": lambda d, l, b: sharding.assign(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(name, docs, labels, benchmark):
    found = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)
    same = [tuple(r) for r in found if r.doc_id == 2]
    assert name in ("mixing", "sharding") or same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels, benchmark):
    none = [t.where("false") for t in (docs, labels, benchmark)]
    assert OPERATORS[name](*none).collect() == []
    assert len(OPERATORS[name](docs, *none[1:]).collect()) == len(ROWS)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_defined_results(docs, labels, benchmark):
    found = {n: by_id(OPERATORS[n](docs, labels, benchmark)) for n in OPERATORS if n not in ("toxicity", "quality")}
    for i in (3, 4):
        assert (found["tokens"][i].n_bytes, found["tokens"][i].n_tokens, found["tokens"][i].over_limit) == (0, 0, False)
        assert (found["secrets"][i].spans, found["secrets"][i].base_sha256) == ("", NOTHING)
        assert not found["perplexity"][i].kept and found["perplexity"][i].log_perplexity is None
        assert (found["contamination"][i].n_words, found["contamination"][i].contaminated) == (0, False)
        assert found["mixing"][i].size == 0
    for i in (3, 4, 5):
        assert (found["jaccard"][i].n_shingles, found["jaccard"][i].component_id) == (0, i)
        assert (found["language"][i].lang_pred, found["language"][i].score) == ("und", 0.0)
        assert found["repeats"][i].n_repeated == 0
    assert found["jaccard"][1].component_id == found["jaccard"][2].component_id == 1
    assert found["jaccard"][1].n_links == found["jaccard"][2].n_links == 3
    assert found["jaccard"][7].n_shingles == 1 and found["jaccard"][6].n_shingles == 29_997
    assert found["tokens"][6].over_limit and found["perplexity"][6].n_words == 30_000
    assert found["contamination"][1].items == ["1"] and found["contamination"][1].n_hit >= 20
    assert (found["contamination"][6].items, found["contamination"][6].n_hit) == ([], 20)
    assert found["contamination"][7].contaminated
    assert found["repeats"][1].n_repeated == found["repeats"][1].n_words == 120
    assert found["secrets"][8].n_assign == found["secrets"][8].n_hex == 1


def test_keep_one_of_nulls_and_copies(docs):
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert texts.count(PROSE) == 1 and texts.count(None) == 2 and len(texts) == len(ROWS) - 3
    assert [r.doc_id for r in left.collect() if r.text == PROSE] == [1]


def test_keep_one_of_equal_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "f g h i"), (5, "f g h i"), (None, ""), (None, "")]
    left = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == ["", "", "a b c d e", "f g h i"]


def test_redaction_keeps_rows_and_columns(docs):
    done = secret_scan.redact_documents(docs.withColumn("n_chars", F.length("text")))
    assert done.columns == [*docs.columns, "n_chars"] and done.count() == len(ROWS)
    row = done.where("doc_id = 8").first()
    assert row.text == '[secret]"' and row.n_chars == len(row.text)


def test_repeated_keeps_columns(docs):
    done = mixing.repeated(docs)
    assert done.columns == docs.columns
    assert max(r["count"] for r in done.groupBy("doc_id", "text").count().collect()) <= 6


def test_words_and_phrases_of_all_kinds_of_rows(spark, docs):
    # Digits end a run, so all runs but a lone one are too short.
    assert spelling.variants(docs).collect() == [] == spelling.variants(docs.where("false")).collect()
    more = docs.withColumn("text", F.concat(F.col("text"), F.lit(" Straße straße strase")))
    words = {r.word: (r.n, r.form) for r in spelling.variants(more).collect()}
    assert words["straße"] == (18, None) and words["strase"] == (8, "straße")  # one of nine lost a letter
    found = phrases.mine(docs, min_count=3, top=None).collect()
    assert {r.lang for r in found} == {"en"} and {r.a for r in found} == {3}
    assert phrases.mine(docs.where("false")).collect() == []
    assert phrases.mine(docs.where("text is null")).collect() == []


def test_shards_of_all_kinds_of_rows(docs):
    found = sharding.assign(docs).collect()
    none = [r for r in found if r.doc_id is None]
    assert len({r.shard for r in none}) == 1 and {r.size for r in none} == {1, len(PROSE) + 1}
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    placed = sharding.place(docs.drop("shard"))
    assert placed.columns == [*docs.drop("shard").columns, "shard"]
    with pytest.raises(ValueError):
        sharding.place(docs)


def test_stages_with_clashing_names_and_empty_tables(spark, docs, tmp_path):
    """Every stage keeps the columns, whatever their names, and takes rows of all kinds and none."""
    quality = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", "one")], "item_id string, text string")
    for name, rows in (("all", docs), ("none", docs.where("false"))):
        folder = str(tmp_path / name)
        for table, df in (("documents", rows), ("labels", quality if name == "all" else quality.where("false")),
                          ("benchmark", items if name == "all" else items.where("false"))):
            df.write.parquet(f"{folder}/{table}.parquet")
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert found.columns == docs.columns
            assert found.count() == 0 or name == "all"
        assert corpus_pipeline.run(spark, folder).columns == docs.columns
    texts = {r.doc_id: r.text for r in corpus_pipeline.uncontaminated(spark, docs, str(tmp_path / "all")).collect()}
    assert 7 not in texts and texts[1] == PROSE
