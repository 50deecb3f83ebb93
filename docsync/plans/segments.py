"""The text index kept in step with its documents by immutable segments.

A batch of changes becomes one segment: its documents, their postings, and marks on the documents of
earlier segments that it replaces or deletes. Nothing written before is touched, and no document that did
not change is read. Layout below one root::

    segment/v=N-.../docs      documents with their place, ordered by length, short ones first
    segment/v=N-.../bases     the first document number of each file's places
    segment/v=N-.../lists     postings of a term in a block of documents, sorted by field, term and block: document
                              numbers, term counts and field lengths, greatest part of a score, without its
                              term's weight, and number of postings
    segment/v=N-.../stats     what the batch adds to document frequencies, less what it takes away
    segment/v=N-.../filters   bitmaps of the documents with a value, for the fields searches filter by
    segment/v=N-.../dead      bitmaps of documents of earlier segments that this one makes void
    manifest/v=N-.../         one row: exists once the segment does

Documents are numbered without gaps inside a segment. Activity, roles and void documents are bitmaps of
32,768 numbers each, which are tested for the documents a query has scored; no search reads a row per
document. Postings are cut into lists by blocks of numbers; the tables ``postings``, a row for each, and
``blocks``, a row per term and block, are read from them. As short documents come first, and a word weighs more in
them, blocks differ in the most their documents can score, and those that cannot reach the k-th best
score are not read. ``merge_segments`` folds segments into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsync.operators import index as ix
from docsync.operators.lists import postings_of, renumber_lists, unpacked
from docsync.operators import search as se
from docsync.schema import FieldSpec
from docsync.session import MAX_CONFIG_ROWS, config_frame, cut_lineage, scratch, swept
from docsync.sources.snapshots import delete_folder, names_below

# Numbers per bitmap, as many as Spark's bitmaps hold; and the bits of a number inside a block of postings.
BITMAP = 1 << 15
BLOCK_BITS = 10
# Bitmaps sent to the rows that are tested by them: 32 MB, those of 268 million documents.
SENT_BITMAPS = 1 << 13
# Blocks read before the k-th best score is first known.
FIRST_BLOCKS = 64
# Rows per page of postings, stored documents: what a lookup reads at least.
PAGE_ROWS = 1024
# Bytes of a group of stored rows, so that a file is read by as many tasks as its size asks for: the longest
# documents lie in one.
GROUP_BYTES = 8 << 20
# Batches that a merged segment remembers, the last ones.
KNOWN_BATCHES = 1000
# Where a stored document lies; and names that documents may not use.
AT = ["_segment", "_place"]
RESERVED = [*AT, "_part", "_base", "_doc_no", "_bitmap", "_dead", "_length", "_was"]

MANIFEST = (
    "version bigint, batch string, batches array<string>, folder string, folds array<bigint>, n_docs bigint, key string, schema string, "
    "fields string, filters array<string>, stop_words array<string>"
)
_POSTINGS = "segment bigint, field string, term string, block bigint, doc_no bigint, tf bigint, field_len bigint"
_BLOCKS = "segment bigint, field string, term string, block bigint, most double, n bigint"
_LISTS = (
    "segment bigint, field string, term string, block bigint, most double, n bigint, ats array<int>, tfs array<int>, lens array<int>"
)
_STATS = "field string, term string, df bigint"
_BASES = "segment bigint, part bigint, base bigint"
_FILTERS = "segment bigint, field string, term string, bitmap bigint, bits binary"
_DEAD = "segment bigint, bitmap bigint, bits binary"


class Segments(NamedTuple):
    """The segments that make up the index now, oldest first, and how its fields are analysed."""

    spark: SparkSession
    root: str
    rows: list
    key: str
    specs: Sequence[FieldSpec]
    filters: Sequence[str]
    stop_words: Sequence[str]

    @property
    def n_docs(self) -> int:
        return sum(r.n_docs for r in self.rows)

    def table(self, name: str, schema: str) -> DataFrame:
        if name == "postings":
            rows = postings_of(self.table("lists", _LISTS), "segment", "field", "term", "block")
            number = F.shiftleft("block", BLOCK_BITS) + F.col("at")
            return rows.select("segment", "field", "term", "block", number.alias("doc_no"), *(
                F.col(c).cast("bigint").alias(c) for c in ("tf", "field_len")))
        if name == "blocks":
            # A list may be parted.
            return self.table("lists", _LISTS).groupBy("segment", "field", "term", "block").agg(
                F.max("most").alias("most"), F.sum("n").alias("n"))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r.folder}/{name}" for r in self.rows))

    def docs(self) -> DataFrame:
        """Stored documents, void ones too, with segment and place; later segments may add columns."""
        schema = StructType()
        for row in self.rows:
            new = StructType.fromJson(json.loads(row.schema))
            schema = StructType(schema.fields + [f for f in new.fields if f.name not in schema.names])
        schema = schema.add("_segment", "long").add("_place", "long")
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r.folder}/docs" for r in self.rows))

    def numbered(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``_doc_no``. There are no more bases than files."""
        bases = F.broadcast(self.table("bases", _BASES).toDF("_segment", "_part", "_base"))
        rows = docs.withColumn("_part", F.shiftright("_place", 33)).join(bases, ["_segment", "_part"])
        number = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)
        return rows.withColumn("_doc_no", number).drop("_part", "_base")

    def live(self, rows: DataFrame, segment: str = "segment", doc_no: str = "doc_no") -> DataFrame:
        """Those of the rows whose document no later segment has made void."""
        dead = self.table("dead", _DEAD).groupBy(F.col("segment").alias(segment), F.col("bitmap").alias("_bitmap")).agg(
            F.expr("bitmap_or_agg(bits)").alias("_dead"))
        rows = rows.withColumn("_bitmap", F.floor(F.col(doc_no) / BITMAP)).join(_sent(dead), [segment, "_bitmap"], "left")
        return rows.where(F.col("_dead").isNull() | ~_is_set("_dead", doc_no)).drop("_bitmap", "_dead")


def _sent(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps, counted first, to be sent to the rows they are joined with: the documents of a bitmap follow
    each other in length, and a shuffle by bitmap would put the longest of them into one task. Beyond the
    bound both sides are shuffled."""
    return F.broadcast(bitmaps) if bitmaps.count() <= SENT_BITMAPS else bitmaps


def _is_set(bits: str, doc_no: str = "doc_no") -> Column:
    """Whether a bitmap has the bit of a number."""
    byte = f"cast(conv(hex(substring({bits}, cast({doc_no} % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"shiftright({byte}, cast({doc_no} % 8 as int)) & 1 = 1")


def _bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of the numbers ``doc_no`` per group."""
    placed = rows.withColumns({"bitmap": F.floor(F.col("doc_no") / BITMAP), "bit": F.col("doc_no") % BITMAP})
    return placed.groupBy(*by, "bitmap").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def _manifest(spark: SparkSession, root: str) -> list:
    """Rows of all published segments: one small row per batch that no merge has folded in yet, and one
    per merge."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest/v=*").orderBy("version").collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return []
        raise


def read_segments(spark: SparkSession, root: str) -> Segments:
    """The index as last published."""
    rows = _manifest(spark, root)
    if not rows:
        raise ValueError(f"no segment is published below {root}")
    folded = {v for r in rows for v in r.folds}
    about = rows[-1]
    specs = [FieldSpec("", f["field"], "job", analyzer=f["analyzer"], boost=f["boost"]) for f in json.loads(about.fields)]
    return Segments(spark, root, [r for r in rows if r.version not in folded], about.key, specs, about.filters, about.stop_words)


def write_segment(
    spark: SparkSession, root: str, docs: DataFrame, specs: Sequence[FieldSpec], key: str,
    deleted: DataFrame | None = None, filters: Sequence[str] = ("active", "roles"), stop_words: Sequence[str] = (),
    batch: str | None = None,
) -> bool:
    """Publish a batch of changes: ``docs`` are new or changed documents, one per key, ``deleted`` has the
    keys of documents to go. ``filters`` names the fields among ``specs`` that searches filter by; their
    values become bitmaps. Returns False, writing nothing, where ``batch`` is published already. There
    is one writer at a time."""
    rows = _manifest(spark, root)
    if batch is not None and any(batch == r.batch or batch in r.batches for r in rows):
        return False
    taken = sorted(set(RESERVED) & set(docs.columns))
    if taken:
        raise ValueError(f"segments need the column names {taken}")
    earlier = read_segments(spark, root) if rows else None
    # Intermediate results go once the segment is published, shuffled rows once they are written.
    with scratch(spark), swept(spark):
        _write(spark, root, rows[-1].version + 1 if rows else 0, earlier, docs, specs, key, deleted, filters, stop_words, batch)
    return True


def _write(spark, root, version, earlier: Segments | None, docs, specs, key, deleted, filters, stop_words, batch) -> None:
    folder = f"segment/v={version}-{uuid.uuid4().hex}"
    now = _write_docs(spark, root, folder, version, docs, specs, filters, key)
    now = now._replace(stop_words=stop_words)

    numbered = now.numbered(now.docs())
    terms = [s for s in specs if s.field not in filters]
    _write_lists(now, _sorted(_analysed_lists(numbered, terms, stop_words), "field", "term", "block"))
    _write_filters(now, numbered)
    stats = now.table("lists", _LISTS).groupBy("field", "term").agg(F.sum("n").alias("df"))
    gone = None
    if earlier:
        keys = now.docs().select(key)
        keys = keys if deleted is None else keys.unionByName(deleted.select(key))
        old = earlier.docs().select(key, *AT).join(keys.distinct(), key, "left_semi")
        old = earlier.live(earlier.numbered(old), "_segment", "_doc_no")
        gone = cut_lineage(old.select(F.col("_segment").alias("segment"), F.col("_doc_no").alias("doc_no")), "gone")
    dead = _bitmaps(gone, "segment") if gone is not None else spark.createDataFrame([], _DEAD)
    dead.write.parquet(f"{root}/{folder}/dead")
    if earlier:
        # The old versions alone are analysed again, to be taken out of the statistics.
        before = _dealt(_of_bitmaps(earlier, now.table("dead", _DEAD))).withColumn("_doc_no", F.monotonically_increasing_id())
        lost = ix.term_stats(_analysed_lists(before, terms, stop_words))
        stats = stats.unionByName(lost.withColumn("df", -F.col("df"))).groupBy("field", "term").agg(F.sum("df").alias("df"))
    _sorted(stats.where("df <> 0"), "field", "term").write.parquet(f"{root}/{folder}/stats", compression="zstd")
    n_docs = now.docs().count() - (gone.count() if gone is not None else 0)
    _publish(now, batch, [], n_docs)


def _write_docs(spark, root, folder, version, docs, specs, filters, key) -> Segments:
    """Write the documents, short ones first, with their places, and the numbers that places stand for."""
    types = dict(docs.dtypes)
    texts = [F.length(F.col(s.field).cast("string")) for s in specs
             if s.field not in filters and s.analyzer != "keyword" and s.field in types]
    length = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0))
    # The place is taken after sorting: the task's number and the row's number in it.
    rows = docs.withColumn("_length", length).repartitionByRange("_length", key).sortWithinPartitions("_length", key)
    rows = rows.drop("_length").withColumns({"_segment": F.lit(version).cast("bigint"), "_place": F.monotonically_increasing_id()})
    rows.write.options(**_layout()).parquet(f"{root}/{folder}/docs")
    fields = json.dumps([{"field": s.field, "analyzer": s.analyzer, "boost": s.boost} for s in specs])
    about = spark.createDataFrame([(version, None, [], folder, [], 0, key, docs.schema.json(), fields, list(filters), [])], MANIFEST).first()
    now = Segments(spark, root, [about], key, list(specs), list(filters), [])
    parts = now.docs().groupBy(F.shiftright("_place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.lit(version).cast("bigint").alias("segment"), "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases.write.parquet(f"{root}/{folder}/bases")
    return now


def _dealt(docs: DataFrame) -> DataFrame:
    """Stored documents dealt out to tasks by place. As they are stored, the longest lie in one file, and
    few files are large enough to be read by more than one task."""
    spark = docs.sparkSession
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *AT)


def _analysed_lists(docs: DataFrame, specs: Sequence[FieldSpec], stop_words: Sequence[str]) -> DataFrame:
    """Posting lists of numbered documents."""
    return ix.build_postings(ix.analyze_fields(docs, specs, "_doc_no", stop_words), with_positions=False, block_bits=BLOCK_BITS)


def _layout() -> dict:
    """How large tables are stored: in short pages and groups, in about half the disk that Spark's default takes."""
    return {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.block.size": GROUP_BYTES, "compression": "zstd"}


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of equal first columns side by side, and split over tasks and files where they are many."""
    return rows.hint("rebalance", *by[:2]).sortWithinPartitions(*by)


def _write_lists(now: Segments, lists: DataFrame) -> None:
    """Write lists that are in order of field, term and block. What is known once a list is made is not
    shuffled with it."""
    version, folder = now.rows[0].version, f"{now.root}/{now.rows[0].folder}"
    rows = unpacked(lists).withColumns({"segment": F.lit(version).cast("bigint"), "n": F.col("n").cast("bigint")})
    rows.select(*StructType.fromDDL(_LISTS).names).write.options(**_layout()).parquet(f"{folder}/lists")


def _write_filters(now: Segments, numbered: DataFrame) -> None:
    version, folder = now.rows[0].version, f"{now.root}/{now.rows[0].folder}"
    specs = [FieldSpec("", f, "job", analyzer="keyword") for f in now.filters if f in numbered.columns]
    if not specs:
        now.spark.createDataFrame([], _FILTERS).write.parquet(f"{folder}/filters")
        return
    values = ix.explode_terms(ix.analyze_fields(numbered, specs, "_doc_no")).select(
        F.lit(version).cast("bigint").alias("segment"), "field", "term", F.col("doc_key").cast("bigint").alias("doc_no"))
    found = _bitmaps(values, "segment", "field", "term").select(*StructType.fromDDL(_FILTERS).names)
    _sorted(found, "field", "term", "bitmap").write.parquet(f"{folder}/filters")


def _publish(now: Segments, batch: str | None, folded: Sequence, n_docs: int) -> None:
    # A single small file: its rename into place is the commit.
    about = now.rows[0]
    known = [b for r in folded for b in (*r.batches, r.batch) if b is not None][-KNOWN_BATCHES:]
    row = (about.version, batch, known, about.folder, [r.version for r in folded], n_docs, now.key, about.schema, about.fields, list(now.filters),
           list(now.stop_words))
    config_frame(now.spark, [row], MANIFEST).coalesce(1).write.json(f"{now.root}/manifest/v={about.version}-{uuid.uuid4().hex}")


def _at(index: Segments, wanted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored documents at the places ``(segment, _place)``. Few places (counted first) are looked up:
    documents lie in order of their place, so only the pages that hold one are read."""
    docs = index.docs()
    docs = docs.select(*(columns or [c for c in docs.columns if c not in AT]), *AT)
    places = wanted.select("segment", "_place").limit(MAX_CONFIG_ROWS + 1).collect()
    keys = wanted.select(F.col("segment").alias("_segment"), "_place")
    if len(places) > MAX_CONFIG_ROWS:
        return docs.join(keys, AT, "left_semi")
    segments, found = sorted({p.segment for p in places}), sorted({p._place for p in places})
    return docs.where(F.col("_segment").isin(segments) & F.col("_place").isin(found)).join(F.broadcast(keys), AT, "left_semi")


def _of_bitmaps(index: Segments, bitmaps: DataFrame) -> DataFrame:
    """Stored documents whose number is in bitmaps by segment, which are sent to them as a rule: no text is
    shuffled to be found."""
    bitmaps = bitmaps.select(F.col("segment").alias("_segment"), F.col("bitmap").alias("_bitmap"), F.col("bits").alias("_dead"))
    rows = index.numbered(index.docs()).withColumn("_bitmap", F.floor(F.col("_doc_no") / BITMAP))
    return rows.join(_sent(bitmaps), ["_segment", "_bitmap"]).where(_is_set("_dead", "_doc_no")).drop("_bitmap", "_dead", "_doc_no")


def merge_segments(spark: SparkSession, root: str) -> int:
    """Fold all segments into one and publish it; returns its version. Void documents and their postings go,
    the others get new numbers; no text is analysed again. Searches that began before go on over the old
    segments, whose files stay."""
    old = read_segments(spark, root)
    version = old.rows[-1].version + 1
    with scratch(spark), swept(spark):
        _merge(spark, root, version, old)
    return version


def _merge(spark, root, version, old: Segments) -> None:
    folder = f"segment/v={version}-{uuid.uuid4().hex}"
    live = old.live(old.numbered(old.docs()), "_segment", "_doc_no")
    was = live.withColumn("_was", F.struct("_segment", "_doc_no")).drop(*AT, "_doc_no")
    now = _write_docs(spark, root, folder, version, was, old.specs, old.filters, old.key)
    now = now._replace(stop_words=old.stop_words)
    numbers = cut_lineage(_renumbered(old, now), "numbers")
    moved = old.table("lists", _LISTS).join(_sent(numbers), ["segment", "block"])
    # A list stays a row while its numbers change: single postings are neither joined nor shuffled.
    moved = moved.withColumn("nos", F.transform("ats", lambda at: F.get("to", at)))
    _write_lists(now, renumber_lists(moved, BLOCK_BITS, lambda rows: _sorted(rows, "field", "term")))
    _write_filters(now, now.numbered(now.docs().drop("_was")))
    stats = old.table("stats", _STATS).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    _sorted(stats, "field", "term").write.parquet(f"{root}/{folder}/stats", compression="zstd")
    spark.createDataFrame([], _DEAD).write.parquet(f"{root}/{folder}/dead")
    schema = StructType([f for f in StructType.fromJson(json.loads(now.rows[0].schema)).fields if f.name != "_was"]).json()
    about = spark.createDataFrame([{**now.rows[0].asDict(), "schema": schema}], MANIFEST).first()
    _publish(now._replace(rows=[about]), None, old.rows, old.n_docs)


def _renumbered(old: Segments, now: Segments) -> DataFrame:
    """``(segment, block, to)``: the new numbers of a block's documents, in order of their old ones; null for
    void documents."""
    kind = "int" if old.n_docs < 1 << 31 else "bigint"
    new = now.numbered(now.docs().select("_was", *AT)).select(
        F.col("_was._segment").alias("segment"), F.col("_was._doc_no").alias("was_no"), F.col("_doc_no").cast(kind).alias("doc_no"))
    every = old.numbered(old.docs().select(*AT)).select(
        F.col("_segment").alias("segment"), F.col("_doc_no").alias("was_no"), F.lit(None).cast(kind).alias("doc_no"))
    numbers = new.unionByName(every).groupBy("segment", "was_no").agg(F.max("doc_no").alias("doc_no"))
    numbers = numbers.withColumn("block", F.shiftright("was_no", BLOCK_BITS))
    return numbers.groupBy("segment", "block").agg(
        F.sort_array(F.collect_list(F.struct("was_no", "doc_no")))["doc_no"].alias("to"))


def expire_segments(spark: SparkSession, root: str) -> list[str]:
    """Delete the segments that a merge has folded in, their manifest rows first, and return their folders.
    Searches that began before the merge have to be done. The merged segment still knows their last
    ``KNOWN_BATCHES`` batches."""
    live = {r.folder for r in read_segments(spark, root).rows}
    gone = [r for r in _manifest(spark, root) if r.folder not in live]
    for row in gone:
        for name in names_below(spark, f"{root}/manifest"):
            if name.startswith(f"v={row.version}-"):
                delete_folder(spark, f"{root}/manifest/{name}")
    for row in gone:
        delete_folder(spark, f"{root}/{row.folder}")
    return [r.folder for r in gone]


def merged_stats(index: Segments) -> DataFrame:
    """``(field, term, df)`` over all segments: what a rebuilt index would have."""
    return index.table("stats", _STATS).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")


def search_segments(
    index: Segments, words: str | Sequence[str], fields: Sequence[str], show: Sequence[str],
    roles: Sequence[str] | None = None, active: int | None = 1, boosts: dict[str, float] | None = None,
    k: int = 20, operator: str = "and", early_stop: bool = True,
) -> DataFrame:
    """The user query over a segmented index: ``(doc_key, *show, score)`` of the best ``k``, as
    ``plans.search.search`` gives it for an index built anew.

    Two short jobs come first: the blocks that can score most are read, and their k-th best score tells
    which other blocks need to be. ``early_stop=False`` reads all blocks of the words."""
    if k > MAX_CONFIG_ROWS:
        raise ValueError(f"at most {MAX_CONFIG_ROWS} hits are looked up")
    unknown = [f for f, given in (("roles", roles), ("active", active)) if given is not None and f not in index.filters]
    if unknown:
        raise ValueError(f"the index has no filter {unknown}")
    analyzers = {s.field: s.analyzer for s in index.specs}
    terms = se.field_terms(words, {f: analyzers.get(f, "standard") for f in fields}, index.stop_words)
    boosts = {s.field: s.boost for s in index.specs} if boosts is None else boosts
    clauses = [c for f, asked in terms.items() for c in se.word_clauses(asked, [f], boosts)]
    stats = cut_lineage(se._of_clauses(index.table("stats", _STATS), clauses).groupBy("field", "term").agg(
        F.sum("df").alias("df")).where("df > 0"), "stats")

    postings = index.table("postings", _POSTINGS)

    def hits(postings: DataFrame) -> DataFrame:
        postings = postings.withColumn("doc_key", F.struct("segment", "doc_no"))
        scored = se.score_terms(postings, terms, stats, index.n_docs, boosts, operator=operator)
        scored = _allowed(index, scored.select("doc_key.segment", "doc_key.doc_no", "score"), roles, active)
        return _named(index, cut_lineage(scored, "scored"), k)

    if not clauses:
        return _shown(index, hits(postings.where("false")), show)
    if not early_stop:
        return _shown(index, cut_lineage(hits(postings), "hits"), show)
    bounds = cut_lineage(_bounds(index, clauses, terms, stats, operator), "bounds")
    first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).collect()
    best = cut_lineage(hits(postings.where(_in_blocks(first))), "hits")
    scores = [r.score for r in best.select("score").collect()]
    rest = bounds if len(scores) < k else bounds.where(F.col("bound") >= min(scores) - 10 ** -se.SCORE_DIGITS)
    more = rest.limit(MAX_CONFIG_ROWS + FIRST_BLOCKS).collect()
    if len(more) < MAX_CONFIG_ROWS:
        done = {(r.segment, r.block) for r in first}
        more = [r for r in more if (r.segment, r.block) not in done]
        further = postings.where(_in_blocks(more)) if more else None
    else:
        # Too many to be named one by one: a join finds them, the first blocks among them.
        further, best = postings.join(rest.select("segment", "block"), ["segment", "block"], "left_semi"), best.where("false")
    if further is not None:
        best = cut_lineage(_best(best.unionByName(hits(further)), k), "hits")
    return _shown(index, best, show)


def _in_blocks(rows: Sequence) -> Column:
    """A condition on segment and block that the scan can use."""
    found = F.lit(False)
    for segment in sorted({r.segment for r in rows}):
        found = found | ((F.col("segment") == segment) & F.col("block").isin(sorted(r.block for r in rows if r.segment == segment)))
    return F.col("block").isin(sorted({r.block for r in rows})) & found


def _bounds(index: Segments, clauses, terms, stats: DataFrame, operator: str) -> DataFrame:
    """``(segment, block, bound)``: the most a document of a block can score, for blocks that may hold a
    hit."""
    counts, found = se._somewhere(terms, operator)
    blocks = index.table("blocks", _BLOCKS).withColumn("doc_key", F.struct("segment", "block")).withColumns(
        {"tf": F.col("most") * F.col("most"), "field_len": F.lit(1)})
    weighed = se._weighed(blocks, clauses, stats, index.n_docs, None)
    whole = weighed.groupBy("segment", "block").agg(
        (F.sum("_weight") * F.count("*") / len(clauses)).alias("bound"), *(c.alias(n) for n, c in counts.items()))
    return whole.where(found).select("segment", "block", "bound")


def _allowed(index: Segments, scored: DataFrame, roles: Sequence[str] | None, active: int | None) -> DataFrame:
    """Scored documents that are not void, active, and of one of the roles."""
    rows = index.live(scored).withColumn("bitmap", F.floor(F.col("doc_no") / BITMAP))
    for field, values in (("active", None if active is None else [active]), ("roles", roles)):
        if values is not None:
            asked = (F.col("field") == field) & F.col("term").isin([str(v) for v in values])
            bits = index.table("filters", _FILTERS).where(asked).groupBy("segment", "bitmap").agg(
                F.expr("bitmap_or_agg(bits)").alias("allowed"))
            rows = rows.join(_sent(bits), ["segment", "bitmap"]).where(_is_set("allowed")).drop("allowed")
    return rows.drop("bitmap")


def _best(named: DataFrame, k: int) -> DataFrame:
    return named.orderBy(F.desc("score"), "doc_key").limit(k)


def _named(index: Segments, scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` with key and place. Ties are broken by key, so the keys of all documents that tie with
    the k-th best score are looked up, and no others."""
    worst = scored.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("worst")).first().worst
    tied = scored.where(F.col("score") >= F.lit(worst).cast("double"))
    by_base = Window.partitionBy("segment").orderBy("base")
    bases = index.table("bases", _BASES).withColumn("end", F.coalesce(F.lead("base").over(by_base), F.lit(1 << 62)))
    placed = tied.join(F.broadcast(bases), "segment").where("doc_no >= base and doc_no < end").select(
        "segment", (F.shiftleft("part", 33) + F.col("doc_no") - F.col("base")).alias("_place"), "score")
    placed = cut_lineage(placed, "placed")
    keys = _at(index, placed, [index.key]).select(
        F.col("_segment").alias("segment"), "_place", F.col(index.key).cast("string").alias("doc_key"))
    return _best(placed.join(keys, ["segment", "_place"]), k)


def _shown(index: Segments, best: DataFrame, show: Sequence[str]) -> DataFrame:
    """Hits with their stored fields, best first."""
    stored = _at(index, best, list(show)).withColumnRenamed("_segment", "segment")
    found = stored.join(F.broadcast(best), ["segment", "_place"])
    return found.select("doc_key", *show, "score").orderBy(F.desc("score"), "doc_key")
