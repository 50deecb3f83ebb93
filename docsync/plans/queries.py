"""One query per operator over the given tables, by key.

Arrays are joined to text in the results so that they compare the same everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import markup, text, values
from docsync.operators import access, changes, content, mapping, search as se, store
from docsync.operators import index as ix
from docsync.plans import inputs, reconcile as rc
from docsync.plans.reconcile import with_eligible
from docsync.plans.segments import (
    Segments, merge_segments, merged_stats, read_segments, search_segments, write_segment,
)
from docsync.plans.search import (
    TextIndex, build_index, index_for_words, read_index, search, write_index,
)
from docsync.schema import Clause, FieldSpec, Task
from docsync.session import cut_lineage, scratch, shared_folder, swept
from docsync.sources import files, quarantine as qu, snapshots
from docsync.streaming import debounce, events, sync

Query = Callable[[SparkSession, str], DataFrame]

WEBS = [inputs.WEB, inputs.SHOP]
WORDS = ["the", "and"]
FIELDS = ["title", "content"]
BOOSTS = {"title": 2.0}
CLAUSES = [
    Clause("c1", "content", "the", "must"),
    Clause("c2", "content", "of", "must"),
    Clause("c3", "content", "and", "should"),
    Clause("c4", "title", "the", "should", 2.0),
]
STOP_WORDS = ["the", "of", "and", "le", "la", "de", "der", "und"]


def _joined(column: str, sep: str = "|") -> Column:
    return F.array_join(column, sep).alias(column)


# --- sources, routing, sinks ---------------------------------------------------------------------


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as a folder tree, one file to a folder, and lists it: every file is a row."""
    root = shared_folder(spark, "tree")
    docs = inputs.documents(spark, sf_dir).withColumn("rest", F.col("doc_id") % 7)
    docs.repartition("source", "lang", "rest").write.partitionBy("source", "lang", "rest").parquet(root)
    listed = files.list_files(spark, root, "*.parquet")
    below = F.regexp_extract("dir", r"(/source=[^/]+/lang=[^/]+/rest=[0-9]+)\z", 1)
    return listed.groupBy(below.alias("dir"), "ext").agg(
        F.count("*").alias("n_files"), F.bool_and(F.col("length") > 0).alias("has_content"),
        F.bool_and(F.col("modified").isNotNull()).alias("has_time"),
    )


def exclude_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.exclude_subtrees(inputs.listing(spark, sf_dir), inputs.EXCLUDED)


def route_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.route_by_extension(inputs.listing(spark, sf_dir), inputs.FILE_TYPES)


def derive_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by the title of their document, so that names need encoding."""
    named = inputs.as_files(inputs.documents(spark, sf_dir)).select(
        "doc_id",
        F.concat("dir", F.lit("/"), inputs.title_of(F.col("text")), F.lit("~*."), "ext").alias("path"),
    )
    return files.derive_url(named, "https://www.example.com/docs/", "/")


def split_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_url(inputs.pages(spark, sf_dir).select("page_id", "url"))


# Buckets of the document tables written here; a real table has one per few hundred MB.
BUCKETS = 8


def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the document table as base 0 and reports what version 0 holds per document type."""
    root = shared_folder(spark, "snapshot")
    snapshots.write_snapshot(inputs.docs(spark, sf_dir), root, 0, buckets=BUCKETS)
    written = snapshots.read_snapshot(spark, root, version=0)
    return written.groupBy("doc_type").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("content")).alias("n_chars")
    )


def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base 0 holds the documents indexed before, delta 1 what the listing changed since."""
    root = shared_folder(spark, "snapshot")
    before = _docs_at(spark, sf_dir, inputs.index(spark, sf_dir))
    now = _docs_at(spark, sf_dir, inputs.listing(spark, sf_dir))
    snapshots.write_snapshot(before, root, 0, partition_by=["ext"])
    action = changes.classify_changes(
        inputs.listing(spark, sf_dir).withColumn("eligible", F.lit(True)),
        inputs.index(spark, sf_dir), ["path"],
    )
    marked = action.filter("action <> 'unchanged'").select(
        "path", (F.col("action") == "deleted").alias("is_deleted"),
        F.timestamp_seconds(F.lit(0)).alias("changed_at"), F.lit(1).cast("bigint").alias("change_id"),
    )
    snapshots.write_delta(marked.join(now, "path", "left"), root, 1)
    return snapshots.read_snapshot(spark, root).select("path", "version", "content")


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base 0 and a delta with one more column are folded; then a delta arrives late that is older
    than what the first one changed and would overwrite every document."""
    return snapshots.read_snapshot(spark, _compacted(spark, sf_dir)).select("path", "version", "content", "note")


def expire_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions, of which the first base and the folded delta are deleted before reading."""
    root = _compacted(spark, sf_dir)
    gone = snapshots.expire_versions(spark, root)
    if len(gone) != 2:
        raise ValueError(f"deleted {gone}")
    return snapshots.read_snapshot(spark, root).select("path", "version", "content", "note")


def _compacted(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "snapshot")
    listing, index = inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir)
    snapshots.write_snapshot(_docs_at(spark, sf_dir, index), root, 0, buckets=BUCKETS)

    def marked(df: DataFrame, second: int) -> DataFrame:
        return df.withColumns({
            "changed_at": F.timestamp_seconds(F.lit(second)), "change_id": F.lit(second).cast("bigint")})

    action = changes.classify_changes(listing.withColumn("eligible", F.lit(True)), index, ["path"])
    touched = action.filter("action <> 'unchanged'").select("path", (F.col("action") == "deleted").alias("is_deleted"))
    now = _docs_at(spark, sf_dir, listing).withColumn("note", F.lit("edited"))
    snapshots.write_delta(marked(touched.join(now, "path", "left"), 10), root, 1)
    snapshots.compact(spark, root)
    late = listing.select("path").union(index.select("path")).distinct().select(
        "path", F.lit(False).alias("is_deleted"), F.lit(0).cast("bigint").alias("version"), F.lit("late").alias("content"))
    snapshots.write_delta(marked(late, 5), root, 2)
    return root


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One web of two in the same index is swept: a listing of its folder against all documents."""
    web = ("first", "/src1", "https://first.example.com/", ".")
    listing = inputs.listing(spark, sf_dir).filter(F.col("dir").startswith("/src1/"))
    work = rc.sweep(listing, inputs.index(spark, sf_dir), web, inputs.EXCLUDED, inputs.FILE_TYPES,
                    inputs.DISPATCH, inputs.ROLE_CONF, inputs.ROOT_ROLES)
    return work.withColumn("roles", _joined("roles"))


def forced_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored stamp of the index is older than the configured one: all of the web's eligible
    documents are ordered anew. After publishing with the new stamps nothing is forced."""
    root = shared_folder(spark, "snapshot")
    web = ("first", "/src1", "https://first.example.com/", ".")
    stamp = lambda day: datetime(2024, 1, day, tzinfo=timezone.utc)
    listing, index = inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir)
    configured = spark.createDataFrame([("main", stamp(2)), ("other", stamp(1))], "index string, stamp timestamp")
    orders = []
    for version, day in enumerate((1, 2)):
        snapshots.write_snapshot(
            _docs_at(spark, sf_dir, index), root, version, stamps={"main": stamp(day)}, buckets=BUCKETS)
        work = rc.configured_sweep(
            listing.filter(F.col("dir").startswith("/src1/")), index, web, "main", configured,
            snapshots.read_stamps(spark, root), [], inputs.FILE_TYPES, inputs.DISPATCH, [], [])
        orders.append(cut_lineage(work.select(F.lit(day).alias("day"), "path", "action", "handler"), "orders"))
    return orders[0].unionByName(orders[1])


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address has a fragment count as not fetched."""
    fetched = inputs.page_items(spark, sf_dir).select(
        "page_id", F.when(~F.col("url").contains("#"), F.col("html")).alias("html")
    )
    mapped = fetched.select(
        "page_id", "html", markup.element_texts(F.col("html"), "p").alias("paragraphs")
    )
    checks = {
        "fetch": (F.col("html").isNull(), "page was not fetched"),
        "content": (F.size("paragraphs") < 5, "fewer than five paragraphs"),
    }
    ok, errors = qu.quarantine(mapped, checks, "page_id", once=True)
    good = ok.select("page_id", F.lit("ok").alias("stage"), F.lit("").alias("message"))
    return good.unionByName(errors)


# --- field mapping -------------------------------------------------------------------------------


def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mapping.map_fields(inputs.page_items(spark, sf_dir), inputs.PAGE_SPECS)
    return mapped.withColumn("paragraph", _joined("paragraph"))


def map_fields_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements chosen by an attribute, two elements that feed one field, two tasks on one field."""
    specs = [
        FieldSpec("page", "page_id", "job", "page_id", identity=True),
        FieldSpec("page", "ad", "page_content", tag="div", where=("class", "ad")),
        FieldSpec("page", "charset", "file_content", "charset", tag="meta", where=("charset", "utf-8")),
        FieldSpec("page", "other", "file_content", "charset", tag="meta", where=("charset", "latin1")),
        FieldSpec("page", "title", "page_content", tag="title"),
        FieldSpec("page", "title", "page_content", tag="h1"),
        FieldSpec("page", "kind", "job", "doc_type", task=(
            Task("job", "url", "contains", "?", "set", "query"), Task("job", "url", "contains", "#", "clear"))),
    ]
    mapped = mapping.map_fields(inputs.page_items(spark, sf_dir), specs)
    return mapped.withColumn("title", _joined("title"))


def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = inputs.listing(spark, sf_dir)
    roles = access.inherit_roles(listed.select("dir"), inputs.ROLE_CONF, inputs.ROOT_ROLES)
    kind = F.when(F.col("ext") == "html", "Page").otherwise("Document")
    with_url = files.derive_url(listed.join(roles, "dir"), inputs.WEB[2], inputs.WEB[1])
    return mapping.job_fields(with_url, kind, F.col("roles")).select(
        "path", "url", "doc_type", "searchable", _joined("roles")
    )


def with_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        FieldSpec("page", "page_id", "job", "page_id", identity=True),
        FieldSpec("page", "scheme", "url", "scheme", is_variable=True),
        FieldSpec("page", "query", "url", "query", is_variable=True),
        FieldSpec("page", "access", "url", "host", task=Task(
            "variable", "scheme", "eq", "https", "set", "encrypted")),
        FieldSpec("page", "place", "url", "path", task=Task(
            "variable", "query", "is_null", None, "clear")),
    ]
    seen = mapping.with_variables(inputs.page_items(spark, sf_dir), specs)
    return mapping.drop_variables(seen, specs).select("page_id", "access", "place")


def conditional_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    def when(condition: str, operand: str, test: str | None, then: Column) -> Column:
        return values.conditional_value(F.col("source"), F.col(operand), condition, test, then)

    return inputs.labelled(spark, sf_dir).select(
        "doc_id",
        when("eq", "lang", "en", F.lit("english")).alias("set_eq"),
        when("ne", "lang", "en", F.lit(None)).alias("clear_ne"),
        when("contains", "text", "the", F.lit("has the")).alias("set_contains"),
        when("matches", "text", r"[0-9]{3}", F.regexp_replace("source", "src", "s")).alias("replace_matches"),
        when("is_null", "quality", None, F.lit("unlabelled")).alias("set_null"),
    )


def join_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a document: language and labels; none at all for unlabelled English ones."""
    keywords = F.array(
        F.when(F.col("lang") != "en", F.col("lang")),
        F.when(F.col("quality") == 1, "good"),
        F.when(F.col("toxic") == 1, "toxic"),
    )
    return inputs.labelled(spark, sf_dir).select(
        "doc_id", values.join_values(keywords).alias("keywords")
    )


def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = inputs.table(spark, sf_dir, "events").select("event_id", "props")
    return mapping.info_fields(seen, {"k": "k", "author": "author"}).select("event_id", "k", "author")


def to_field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mapping.map_fields(inputs.page_items(spark, sf_dir), inputs.PAGE_SPECS)
    return mapping.to_field_rows(mapped, inputs.PAGE_SPECS, "url")


def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages identified by host and query together; those without a query have no identity."""
    specs = [
        FieldSpec("page", "host", "url", "host", identity=True),
        FieldSpec("page", "query", "url", "query", identity=True),
        FieldSpec("page", "path", "url", "path"),
    ]
    return mapping.identity_key(mapping.map_fields(inputs.page_items(spark, sf_dir), specs), specs)


# --- content -------------------------------------------------------------------------------------


def first_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return inputs.pages(spark, sf_dir).select(
        "page_id",
        markup.first_attribute(html, "html", "lang").alias("lang"),
        markup.first_attribute(html, "meta", "charset").alias("charset"),
        markup.first_attribute(html, "a", "href").alias("link"),
        markup.first_attribute(html, "div", "id").alias("div_id"),
    )


def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.node_texts(inputs.pages(spark, sf_dir), "p")


def normalise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select(
        "doc_id", text.normalise_lines(F.col("text")).alias("text")
    )


def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pages(spark, sf_dir).select(
        "page_id", text.decode_entities(F.col("html")).alias("html")
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pages(spark, sf_dir).select(
        "page_id", markup.visible_text(F.col("html")).alias("text")
    )


def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.assemble_text(inputs.fragments(spark, sf_dir))


def resolve_shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, errors = content.resolve_shared_strings(
        inputs.cells(spark, sf_dir), inputs.shared_strings(spark, sf_dir), once=True
    )
    good = ok.withColumn("message", F.lit(None).cast("string"))
    return good.unionByName(errors, allowMissingColumns=True)


# --- changes -------------------------------------------------------------------------------------

KEYS = ["path"]


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.deleted_files(inputs.index(spark, sf_dir), inputs.listing(spark, sf_dir), KEYS)


def created_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.created_files(inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir), KEYS)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_files(inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir), KEYS)


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_eligible(inputs.listing(spark, sf_dir), inputs.EXCLUDED, inputs.FILE_TYPES)


def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.classify_changes(_eligible(spark, sf_dir), inputs.index(spark, sf_dir), KEYS)


def removed_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose last folder event is a removal, as a table, against the indexed documents."""
    last = events.latest_event(
        inputs.folder_change_events(spark, sf_dir).filter(F.col("change_type") != "Other")
    )
    removed = last.filter("change_type = 'Deleted'").select(F.col("path").alias("dir"))
    return changes.removed_subtree(inputs.index(spark, sf_dir), removed).select("path", "dir")


def version_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = inputs.table(spark, sf_dir, "events")
    return seen.select(
        "event_id", values.version_ticks(F.col("ts").cast("timestamp")).alias("version_ticks")
    )


def config_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index per source and language; its stamp is taken from its largest document, as it is now
    and as it was among the documents indexed before."""
    def stamps(df: DataFrame) -> DataFrame:
        name = F.concat_ws("-", "source", "lang").alias("index")
        return df.groupBy(name).agg(F.timestamp_seconds(F.max("n_chars")).alias("stamp"))

    every = inputs.labelled(spark, sf_dir)
    return changes.config_changed(stamps(every), stamps(every.filter("quality is not null")))


def dispatch_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = inputs.folder(classify_changes(spark, sf_dir)).withColumn(
        "ext", F.substring_index("path", ".", -1)
    )
    typed = files.route_by_extension(acted, inputs.FILE_TYPES)
    return changes.dispatch_actions(typed, inputs.DISPATCH).select(
        "path", "action", "file_type", "handler"
    )


def dedup_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir).select("handler", "web", "path")
    return changes.dedup_work(routed)


# --- index maintenance ---------------------------------------------------------------------------


def _docs_at(spark: SparkSession, sf_dir: str, state: DataFrame) -> DataFrame:
    """Documents of a listing or index with their content."""
    texts = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    return state.join(texts, "doc_id").select("path", "ext", "version", "content")


def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_docs(
        _docs_at(spark, sf_dir, inputs.index(spark, sf_dir)),
        _docs_at(spark, sf_dir, inputs.listing(spark, sf_dir)), KEYS,
    )


def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes what is on disk now, which leaves the documents whose file is gone."""
    return store.delete_docs(
        _docs_at(spark, sf_dir, inputs.index(spark, sf_dir)), inputs.listing(spark, sf_dir), KEYS
    )


def exists_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exists_docs(inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir), KEYS)


def latest_per_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = inputs.change_events(spark, sf_dir)
    return store.latest_per_identity(seen, KEYS, "ts", "event_id").select(
        "path", "event_id", "change_type"
    )


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.apply_changes(
        _docs_at(spark, sf_dir, inputs.index(spark, sf_dir)),
        classify_changes(spark, sf_dir),
        _docs_at(spark, sf_dir, inputs.listing(spark, sf_dir)), KEYS, "version",
    )


# --- access --------------------------------------------------------------------------------------


def inherit_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = inputs.as_files(inputs.documents(spark, sf_dir)).select("dir")
    return access.inherit_roles(dirs, inputs.ROLE_CONF, inputs.ROOT_ROLES).select(
        "dir", _joined("roles")
    )


def read_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.read_rights(inputs.acl(spark, sf_dir))


def read_rights_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.read_rights(inputs.acl(spark, sf_dir), deny_aware=False)


def has_read_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.has_read_permission(inputs.masks(spark, sf_dir))


def authorized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.authorized_groups(inputs.acl(spark, sf_dir), inputs.GROUPS)
    return found.select("path", _joined("groups"))


def visible_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = access.visible_to(inputs.docs(spark, sf_dir), ["B", " E", "ROOT"])
    return seen.select("path", _joined("roles"))


# --- text index and search -----------------------------------------------------------------------


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.as_files(inputs.documents(spark, sf_dir)).select(
        "path", "lang", inputs.title_of(F.col("text")).alias("title"), F.col("text").alias("content")
    )


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [s for s in inputs.DOC_SPECS if s.field in FIELDS]
    return ix.analyze_fields(_titled(spark, sf_dir), specs, "path")


def _index(spark: SparkSession, sf_dir: str, words: list[str]) -> TextIndex:
    return index_for_words(
        _titled(spark, sf_dir), [s for s in inputs.DOC_SPECS if s.field in FIELDS], "path", words
    )


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.tokenize(inputs.documents(spark, sf_dir), "doc_id", "text")


def analyze_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        FieldSpec("document", "lang", "job", "lang", analyzer="keyword"),
        FieldSpec("document", "title", "doc_info", "title", analyzer="standard"),
        FieldSpec("document", "content", "doc_content", analyzer="standard_stop"),
    ]
    analysed = ix.analyze_fields(_titled(spark, sf_dir), specs, "path", STOP_WORDS)
    return ix.explode_terms(analysed)


def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = ix.build_postings(_analysed(spark, sf_dir))
    return postings.withColumn("positions", _joined("positions", " "))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_stats(ix.build_postings(_analysed(spark, sf_dir), with_positions=False))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.field_lengths(_analysed(spark, sf_dir))


def term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.term_query(inputs.docs(spark, sf_dir), "active", 1)
    return se.term_query(found, "dir", "/src1/en").select("path", "title")


def bool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir, [c.term for c in CLAUSES])
    return se.bool_query(index.postings, CLAUSES)


def multi_field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.multi_field_query(_index(spark, sf_dir, WORDS).postings, WORDS, FIELDS)


def _scored(spark: SparkSession, sf_dir: str) -> tuple[TextIndex, DataFrame]:
    index = _index(spark, sf_dir, [c.term for c in CLAUSES])
    return index, se.score(index.postings, CLAUSES, index.term_stats, index.n_docs)


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1]


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(_scored(spark, sf_dir)[1], 20)


def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.total_hits(_scored(spark, sf_dir)[1])


def fetch_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, scored = _scored(spark, sf_dir)
    return se.fetch_fields(se.top_k(scored, 20), index.docs, ["title", "lang"], "path", 20)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole user query over the document table: active, visible, all words in one field."""
    docs = inputs.docs(spark, sf_dir)
    index = index_for_words(
        docs, [s for s in inputs.DOC_SPECS if s.field in FIELDS], "path", WORDS
    )
    return search(index, WORDS, FIELDS, ["title", "lang"], ["A", "D"], 1, BOOSTS, 20)


def _stored_index(spark: SparkSession, sf_dir: str, specs: list[FieldSpec], stop_words: list[str]) -> TextIndex:
    """The document table's index, written and read again."""
    docs, folder = inputs.docs(spark, sf_dir), shared_folder(spark, "index")
    write_index(build_index(docs, specs, "path", with_positions=False, stop_words=stop_words), folder)
    return read_index(spark, folder, docs, "path")


STORED = [
    FieldSpec("document", "title", "doc_info", "title", boost=2.0),
    FieldSpec("document", "content", "doc_content", analyzer="standard_stop"),
    FieldSpec("document", "lang", "job", "lang", analyzer="keyword"),
    FieldSpec("document", "active", "job", "active", analyzer="keyword"),
    FieldSpec("document", "roles", "job", "roles", analyzer="keyword"),
]


def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words in one field, each field analysed in its own way; activity and roles as terms."""
    index = _stored_index(spark, sf_dir, STORED, ["the"])
    return search(index, "The and", FIELDS, ["title", "lang"], ["A", "D"], 1, k=20)


def search_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored_index(spark, sf_dir, STORED[:2], ["the"])
    return search(index, "the and", FIELDS, ["title"], active=None, k=50, operator="or")


def search_keyword_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole value as one term: no splitting, no lower case."""
    index = _stored_index(spark, sf_dir, STORED[2:], [])
    return search(index, ["fr"], ["lang"], ["lang"], active=1, k=None)


def _segmented(spark: SparkSession, sf_dir: str) -> Segments:
    """An index of three batches. The first holds the labelled documents. The second edits those of low
    quality, deletes the toxic ones and adds those without a label, of which the third cuts the Spanish
    ones down to their title."""
    root, kept, marks = shared_folder(spark, "segments"), F.coalesce("toxic", F.lit(0)) == 0, ["quality", "toxic"]
    # The documents are read and joined once for all batches, and go when the last one is written.
    with scratch(spark), swept(spark):
        docs = inputs.marked_docs(spark, sf_dir)
        edited = docs.withColumn("content", F.when(
            F.col("quality") == 0, F.concat("content", F.lit(" the and edited"))).otherwise(F.col("content")))
        edited = edited.withColumn("title", inputs.title_of(F.col("content")))
        write_segment(spark, root, docs.where("quality is not null").drop(*marks), STORED, "path", stop_words=["the"])
        changed = edited.where(kept & ((F.col("quality") == 0) | F.col("quality").isNull()))
        write_segment(spark, root, changed.drop(*marks), STORED, "path", docs.where("toxic = 1").select("path"), stop_words=["the"])
        cut = docs.where("quality is null and toxic is null and lang = 'es'").withColumn("content", F.col("title"))
        write_segment(spark, root, cut.drop(*marks), STORED, "path", stop_words=["the"])
    return read_segments(spark, root)


def search_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over segments written by three batches: as over an index built anew."""
    return search_segments(_segmented(spark, sf_dir), "The and", FIELDS, ["title", "lang"], active=None, k=50)


def search_by_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of the words, in active documents of a role, by bitmaps of their numbers."""
    found = search_segments(_segmented(spark, sf_dir), "the and edited", FIELDS, ["title"], ["A", "B"], 1, k=40, operator="or")
    return found


def search_merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _segmented(spark, sf_dir)
    merge_segments(spark, index.root)
    return search_segments(read_segments(spark, index.root), "The and", FIELDS, ["title", "lang"], active=None, k=50, early_stop=False)


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of all terms, kept up through changes and deletions."""
    return merged_stats(_segmented(spark, sf_dir))


# --- change events -------------------------------------------------------------------------------


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.route_events(
        inputs.change_events(spark, sf_dir), WEBS, inputs.FILE_TYPES, inputs.DISPATCH
    )


def _landed(spark: SparkSession, found: DataFrame) -> str:
    """Events as files in a landing folder."""
    folder = shared_folder(spark, "landing")
    found.write.parquet(folder)
    return folder


def read_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the landed events to a table."""
    stream = events.read_change_events(spark, _landed(spark, inputs.change_events(spark, sf_dir)))
    out = shared_folder(spark, "events")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", shared_folder(spark, "events-checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    read = spark.read.schema(stream.schema).parquet(out)
    return read.select("event_id", "web", "path", "is_dir", "change_type",
                       F.unix_micros("ts").alias("micros"))


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).drop("ts")


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest_event(_routed(spark, sf_dir)).select("web", "path", "event_id", "action")


def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debounce.debounce_events(_routed(spark, sf_dir), timedelta(days=1))
    return found.withColumns({c: F.unix_micros(c) for c in ("opened", "due")})


def debounce_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per handler: a key has thousands of moments and is never gathered."""
    found = debounce.debounce_events(_routed(spark, sf_dir), timedelta(hours=1), ["handler"])
    return found.withColumns({c: F.unix_micros(c) for c in ("opened", "due")})


def folder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.folder_events(
        inputs.folder_change_events(spark, sf_dir), inputs.listing(spark, sf_dir),
        inputs.index(spark, sf_dir),
    )
    return found.drop("ts")


def _sync_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files that change events name."""
    folder = F.concat(F.lit("/src"), (F.col("doc_id") % 20).cast("string"))
    return inputs.documents(spark, sf_dir).select(
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"),
        "lang", "text",
    )


def sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams all change events into a document table and reads the table."""
    stream = events.read_change_events(spark, _landed(spark, inputs.change_events(spark, sf_dir)))
    root = shared_folder(spark, "sync")

    def as_document(items: DataFrame) -> DataFrame:
        return items.select("path", "url", "lang", F.col("text").alias("content"))

    query = sync.sync_stream(
        stream, root, shared_folder(spark, "sync-checkpoint"),
        lambda wanted: _sync_content(spark, sf_dir), {"index_page": as_document}, WEBS,
        inputs.FILE_TYPES, inputs.DISPATCH,
    )
    query.awaitTermination()
    return snapshots.read_snapshot(spark, root)


def sync_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches of events for pages and PDF files, out of order, with a handler for each kind and
    the roles of the folders; contents are partitioned by folder, and each batch reads its own."""
    kind = F.when(F.regexp_extract("path", r"/([0-9]+)\.html$", 1).cast("bigint") % 3 == 0, ".pdf").otherwise(".html")
    found = inputs.change_events(spark, sf_dir).withColumn("path", F.concat(F.regexp_extract("path", r"^(.*)\.html$", 1), kind))
    landing, contents, root = (shared_folder(spark, p) for p in ("landing", "contents", "sync"))
    for i in range(3):
        found.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(landing)
    folder = F.concat(F.lit("/src"), (F.col("doc_id") % 20).cast("string"))
    ending = F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".html")
    files = inputs.documents(spark, sf_dir).select(
        folder.alias("dir"), F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), "lang", "text")
    files.write.partitionBy("dir").parquet(contents)
    table = spark.read.schema(files.schema).parquet(contents)

    def as_document(content: Column) -> Callable[[DataFrame], DataFrame]:
        return lambda items: items.select("path", "url", "lang", _joined("roles"), content.alias("content"))

    query = sync.sync_stream(
        events.read_change_events(spark, landing, max_files=1), root, shared_folder(spark, "sync-checkpoint"),
        sync.content_by_folder(table),
        {"index_page": as_document(F.col("text")), "index_pdf": as_document(inputs.title_of(F.col("text")))}, WEBS,
        inputs.FILE_TYPES, inputs.DISPATCH, role_conf=inputs.ROLE_CONF, root_roles=inputs.ROOT_ROLES, compact_every=2,
    )
    query.awaitTermination()
    return snapshots.read_snapshot(spark, root)


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole sweep applied: the documents indexed before, brought to what the listing says, and the items
    that gave no document. Office files of low quality are not to be had, Spanish pages fail a check."""
    listing, index = inputs.listing(spark, sf_dir), inputs.index(spark, sf_dir)
    work = rc.sweep(listing, index, inputs.WEB, inputs.EXCLUDED, inputs.FILE_TYPES, inputs.DISPATCH, [], inputs.ROOT_ROLES)
    before = index.select("path", F.col("version").alias("version_ticks"), F.lit("before").alias("state"), F.lit(None).cast("string").alias("url"))
    files = inputs.as_files(inputs.labelled(spark, sf_dir))
    content = files.filter((F.col("ext") != "docx") | (F.coalesce("quality", F.lit(1)) != 0)).select(
        "path", "lang", F.col("n_chars").alias("version_ticks"))

    def handler(state: str) -> Callable[[DataFrame], DataFrame]:
        return lambda items: items.select("path", "version_ticks", F.lit(state).alias("state"), "url", "lang")

    handlers = {name: handler(name) for name in ("index_page", "index_pdf", "index_office")}
    checks = {"language": ((F.col("lang") == "es") & F.col("path").endswith(".html"), "not read")}
    docs, errors = rc.reconcile(before, work, content, handlers, checks)
    errors = errors.select("path", F.lit(-1).cast("bigint").alias("version_ticks"), F.concat_ws(": ", "stage", "message").alias("state"))
    return docs.select("path", "version_ticks", "state", "url").unionByName(errors, allowMissingColumns=True)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        list_files, exclude_subtrees, route_by_extension, derive_url, split_url, write_snapshot,
        read_snapshot, compact, expire_versions, sweep, forced_sweep, quarantine,
        map_fields, map_fields_where, job_fields, with_variables, conditional_value, join_values, info_fields,
        to_field_rows, identity_key,
        first_attribute, node_texts, normalise_lines, decode_entities, page_text, assemble_text,
        resolve_shared_strings,
        deleted_files, created_files, changed_files, classify_changes, removed_subtree,
        version_ticks, config_changed, dispatch_actions, dedup_work,
        upsert_docs, delete_docs, exists_docs, latest_per_identity, apply_changes,
        inherit_roles, read_rights, read_rights_untyped, has_read_permission, authorized_groups,
        visible_to,
        tokenize, analyze_fields, build_postings, term_stats, field_lengths, term_query,
        bool_query, multi_field_query, score, top_k, total_hits, fetch_fields,
        read_change_events, route_events, latest_event, debounce_events, debounce_hot, folder_events, sync_stream,
        sync_folders, reconcile,
        search_stored_index, search_any_word, search_keyword_field,
        search_after_delta, search_by_roles, search_merged_segments, segment_stats,
    )
}
QUERIES["search"] = search_documents
