"""Operator inputs derived from the plain tables: file listings, documents, access entries, events.

Every input covers its whole source table. What counts as indexed before, as gone or as changed
comes from the ``labels`` table: labelled documents were indexed, toxic ones have left the disk, and
those of low quality were edited since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import paths
from docsync.operators.access import inherit_roles
from docsync.schema import FieldSpec, Task
from docsync.session import cut_lineage

ROOT_ROLES = ["ROOT", "A"]
ROLE_CONF = [
    ("/src1", "A,B", None),
    ("/src1/en", None, "B"),
    ("/src2", "C", "C"),
    ("/src3/de", "D, E", "A"),
]
EXCLUDED = ["/src3", "/src1/en"]
FILE_TYPES = [("page", "html"), ("pdf", "pdf"), ("office", "docx")]
DISPATCH = [
    ("page", "created", "index_page"),
    ("page", "changed", "index_page"),
    ("page", "deleted", "remove"),
    ("pdf", "created", "index_pdf"),
    ("pdf", "deleted", "remove"),
    ("office", "changed", "index_office"),
]
WEB = ("intranet", "/", "https://intranet.example.com", r"^/src[0-9]+/")
SHOP = ("shop", "/", "https://shop.example.com/s/", r"\.html$")
GROUPS = "g1;g3;g9"

PAGE_SPECS = [
    FieldSpec("page", "doc_type", "job", "doc_type", analyzer="keyword"),
    FieldSpec("page", "url", "job", "url", identity=True, analyzer="keyword"),
    FieldSpec("page", "length", "file", "length", analyzer="keyword"),
    FieldSpec("page", "host", "url", "host", is_variable=True),
    FieldSpec("page", "section", "url", "path", analyzer="keyword",
              task=Task("job", "url", "matches", r"/(en|fr|de|es)/", "replace", "")),
    FieldSpec("page", "query", "url", "query", analyzer="keyword"),
    FieldSpec("page", "lang", "file_content", "lang", tag="html", analyzer="keyword"),
    FieldSpec("page", "mobile", "file_content", "charset", tag="meta", analyzer="keyword",
              task=Task("variable", "host", "matches", r"^m\.", "set", "mobile")),
    FieldSpec("page", "title", "page_content", tag="title", boost=2.0),
    FieldSpec("page", "paragraph", "page_content", tag="p", multi=True),
    FieldSpec("page", "content", "page_content", tag="body"),
]

DOC_SPECS = [
    FieldSpec("document", "path", "file", "path", identity=True, analyzer="keyword"),
    FieldSpec("document", "lang", "job", "lang", analyzer="keyword"),
    FieldSpec("document", "title", "doc_info", "title", boost=2.0),
    FieldSpec("document", "content", "doc_content"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table as it is stored; how it is split is the session's matter."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with quality and toxic where they have labels."""
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _ext() -> Column:
    kind = F.col("doc_id") % 4
    return F.when(kind == 0, "html").when(kind == 1, "pdf").when(kind == 2, "docx").otherwise("xlsx")


def as_files(df: DataFrame) -> DataFrame:
    """Attach dir, ext and path of the file a document stands for."""
    folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    return df.withColumns({"dir": folder, "ext": _ext()}).withColumn(
        "path", F.concat("dir", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "ext")
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk now: ``(path, dir, ext, doc_id, version)``."""
    edited = F.when(F.col("quality") == 0, 1).otherwise(0)
    return (
        as_files(labelled(spark, sf_dir))
        .filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select("path", "dir", "ext", "doc_id", (F.col("n_chars") + edited).alias("version"))
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was indexed before: ``(path, dir, ext, doc_id, version)``."""
    return (
        as_files(labelled(spark, sf_dir))
        .filter(F.col("quality").isNotNull())
        .select("path", "dir", "ext", "doc_id", F.col("n_chars").alias("version"))
    )


def title_of(text: Column) -> Column:
    """First line of a text."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def _as_docs(files: DataFrame, roles: DataFrame, *marks: str) -> DataFrame:
    return files.join(roles, "dir").select(
        "path", "dir", "doc_id", "lang", "roles",
        F.when(F.col("ext") == "html", "Page").otherwise("Document").alias("doc_type"),
        title_of(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.coalesce("quality", F.lit(1)).alias("active"),
        F.col("n_chars").alias("version_ticks"), *marks,
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table over all documents, with roles inherited from the folders."""
    files = as_files(labelled(spark, sf_dir))
    return _as_docs(files, inherit_roles(files.select("dir"), ROLE_CONF, ROOT_ROLES))


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table with ``quality`` and ``toxic``, written once to the shared folder. The roles are
    written first: once their size is known, few of them are sent to the texts."""
    files = as_files(labelled(spark, sf_dir))
    roles = cut_lineage(inherit_roles(files.select("dir"), ROLE_CONF, ROOT_ROLES), "roles")
    return cut_lineage(_as_docs(files, roles, "quality", "toxic"), "marked", "zstd")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as items to be mapped."""
    return pages(spark, sf_dir).select(
        "page_id", "url", "html", F.lit("Page").alias("doc_type"),
        F.length("html").cast("bigint").alias("length"),
    )


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access entries ``(path, account, rights, entry_type)``: one group per document by its id, and
    group g9 on every document; entries of toxic documents deny."""
    files = as_files(labelled(spark, sf_dir))
    entry_type = F.when(F.col("toxic") == 1, "deny").otherwise("allow").alias("entry_type")
    own = files.select(
        "path", F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string")).alias("account"),
        (F.col("doc_id") % 4).alias("rights"), entry_type,
    )
    common = files.select(
        "path", F.lit("g9").alias("account"), F.lit(1).cast("bigint").alias("rights"), entry_type
    )
    return own.unionByName(common)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, rights)``: masks with specific bits from the length and generic bits by language."""
    generic = (
        F.when(F.col("lang") == "fr", F.lit(0x80000000))
        .when(F.col("lang") == "de", F.lit(0x40000000))
        .when(F.col("lang") == "es", F.lit(0x20000000))
        .otherwise(F.lit(0))
    ).cast("bigint")
    return documents(spark, sf_dir).select(
        "doc_id", (F.col("n_chars") * 2).bitwiseOR(generic).alias("rights")
    )


def _change_type() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "Created")
        .when(kind.isin("view", "click"), "Changed")
        .when(kind == "error", "Deleted")
        .otherwise("Other")
    )


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file event per row of ``events``; the user names the file, and with it the web."""
    folder = (F.col("user_id") % 20).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, WEB[0]).otherwise(SHOP[0]).alias("web"),
        F.concat(
            F.lit("/src"), folder, F.lit("/"), F.col("user_id").cast("string"), F.lit(".html")
        ).alias("path"),
        F.lit(False).alias("is_dir"),
        _change_type().alias("change_type"),
    )


def folder_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder event per row of ``events``: the user names a source folder, the value decides
    whether it is the folder itself or one of its language folders."""
    lang = F.element_at(
        F.array(F.lit(""), F.lit("/en"), F.lit("/fr"), F.lit("/de"), F.lit("/es")),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(WEB[0]).alias("web"),
        F.concat(F.lit("/src"), (F.col("user_id") % 20).cast("string"), lang).alias("path"),
        F.lit(True).alias("is_dir"),
        _change_type().alias("change_type"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as text fragments."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_key"), F.col("turn").alias("pos"), "text"
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cells: a user's turn is a reference to the string two turns on, others are literal.
    The last user turn of a conversation may refer to a string that does not exist."""
    shared = F.col("role") == "user"
    raw = F.when(shared, (F.col("turn") + 2).cast("string")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("workbook_id"), F.col("turn").alias("pos"),
        shared.alias("is_shared"), raw.alias("raw"),
    )


def shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the string tables of workbooks."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("workbook_id"), F.col("turn").alias("idx"), "text"
    )


def folder(df: DataFrame) -> DataFrame:
    """Attach ``dir`` to rows with a path."""
    return df.withColumn("dir", paths.folder_of(F.col("path")))
