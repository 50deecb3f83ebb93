"""Mixing sources to target weights by capped water-filling.

A source is clamped where its target would repeat it more than ``max_epochs`` times, and what it
cannot take is shared among the others by weight until no target is above its clamp. Sorted by
clamp over weight, the clamped sources are a prefix, so the rounds of clamping and sharing become
one running sum over the table of sources.

A document is then taken a whole number of times, plus once more for a seeded part of the
documents. That part is a systematic sample: documents of a source lie in order of size class and
seeded hash, and every 1/f-th of them is taken, so the words taken stay within about one document
of the target. Ranks come from counts of small cells (source, size class, one of 256 hash buckets)
plus a row number inside each cell; no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import WORD
from docsync.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 9
# Seeded starts of the systematic sample that are compared.
STARTS = 8
# So many cells, about 100 bytes each, may be broadcast.
BROADCAST_CELLS = 1 << 19
CELL = ["source", "class", "bucket"]


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(value: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))


def _digits(hexadecimal: Column, n: int) -> Column:
    return F.conv(F.substring(hexadecimal, 1, n), 16, 10).cast("long")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over all rows that come before a row in order, which must be a total one.

    Ranges of the order are summed up first, and what lies before each range is added to the sums inside
    it, so no task sorts more than a range. There are no more ranges than shuffle partitions."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({f"own_{n}": c for n, c in sums.items()}).repartitionByRange(ranges, *order)
    rows = cut_lineage(rows.withColumn("range", F.spark_partition_id()), "ranges")
    whole = rows.groupBy("range").agg(*[F.sum(f"own_{n}").alias(f"own_{n}") for n in sums])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("range", *[F.coalesce(F.sum(f"own_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(F.broadcast(whole), "range")
    for n in sums:
        found = found.withColumn(n, F.col(f"base_{n}") + F.coalesce(F.sum(f"own_{n}").over(inside), F.lit(0)))
    return found.select(*df.columns, *sums)


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` to ``(source, position, source_size, target, epochs)``.

    Sources may be as many as there are hosts: both orders, by name and by filling, are cut into ranges.
    A source of size 0 has target 0 and 0 epochs.
    """
    df = running_sums(sources, [F.col("source").asc_nulls_last()], {"position": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    df = df.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * max_epochs})
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("position").asc()]
    df = running_sums(df, order, {"i": F.lit(1).cast("long"), "capped": F.col("cap"), "passed": F.col("weight")})
    df = cut_lineage(df, "targets")
    # Two single rows: the sums over all sources, and the first source that its share does not fill, which
    # sets the level for all after it.
    whole = df.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    df = df.withColumns({"left": F.lit(whole.words or 0) - F.col("capped"), "open": F.lit(whole.weight or 0) - F.col("passed")})
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("open")
    level = df.where(fits).agg(F.min(F.struct("i", "left", "open")).alias("level")).first().level
    if level is None:
        level = (0, 0, 1)
    shared = (F.lit(level[1]) * F.col("weight")).cast("double") / F.lit(level[2])
    target = F.when(F.col("i") < level[0], F.col("cap").cast("double")).otherwise(shared)
    df = df.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return df.select("source", "position", "source_size", "target", epochs.alias("epochs"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: list[str] | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """How often each document is taken: the ``keep`` columns (by default the id) with ``size``,
    ``source_size``, ``target`` and ``copies``.

    Null texts and texts without words have size 0 and are taken like others, which adds no words.
    A null source is a source of its own, the last. Repeated rows are separate documents; rows
    that agree in id and size may swap places in a sample, which changes no total. An empty table
    gives an empty table. Other columns do not matter, whatever their names.
    """
    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep or [id_col])]
    rows = docs.select(
        *kept, F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"),
        _seeded(F.col(f"`{id_col}`"), seed).alias("draw"),
    )
    # Size class: the number of binary digits and the first four of them.
    rows = rows.withColumns({
        "class": F.expr("length(bin(size)) * 16 + shiftright(size, greatest(0, length(bin(size)) - 4))"),
        "bucket": _digits(F.col("draw"), 2),
    })
    sized = cut_lineage(rows.select("source", "size", "draw", "class", "bucket"), "mixing")
    cells = sized.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    # A source has at most 256 cells per size class: this window is small however large the source.
    earlier = (
        Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))
    ).select(*[F.col(c).alias(f"cell_{c}") for c in CELL], "first", "position", "source_size", "target", "epochs")
    cells = cut_lineage(cells, "mixing")
    starts = _best_starts(_ranked(sized, _few(cells), "draw", "size"), seed)
    # What a row needs is put on its cell, so rows with their texts move once, for the ranks.
    cells = cut_lineage(cells.join(starts, "position"), "mixing")
    ranked = _ranked(rows, _few(cells), "draw", "size", "kept_0")
    return ranked.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep or [id_col])],
        "size", "source_size", "target", (F.floor("epochs") + _extra(F.col("start"))).alias("copies"),
    )


def _few(cells: DataFrame) -> DataFrame:
    """Few cells (counted first) are sent to the rows; beyond that bound both sides are shuffled."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def _ranked(rows: DataFrame, cells: DataFrame, *order: str) -> DataFrame:
    """Each row with what its cell knows and its rank in its source."""
    same = F.col("source").eqNullSafe(F.col("cell_source"))
    for c in CELL[1:]:
        same = same & (F.col(c) == F.col(f"cell_{c}"))
    inside = F.row_number().over(Window.partitionBy(*CELL).orderBy(*order))
    return rows.join(cells, same).withColumn("rank", F.col("first") + inside)


def _extra(start: Column) -> Column:
    """1 for each rank at which the running count of the sample steps up, else 0."""
    part = F.col("epochs") - F.floor("epochs")
    return F.floor(F.col("rank") * part + start) - F.floor((F.col("rank") - 1) * part + start)


def _best_starts(ranked: DataFrame, seed: int) -> DataFrame:
    """Of some seeded starts of the sample, the one that takes nearest to the target, per source."""
    starts = [
        _digits(_seeded(F.concat(F.col("position").cast("string"), F.lit(f":{j}")), seed), 8) / F.lit(float(1 << 32))
        for j in range(STARTS)
    ]
    sums = ranked.groupBy("position", "target").agg(
        *[F.sum(F.col("size") * (F.floor("epochs") + _extra(s))).alias(f"taken_{j}") for j, s in enumerate(starts)]
    )
    best = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"taken_{j}") - F.col("target")).alias("off"), F.lit(j).alias("j"), s.alias("start"))
        for j, s in enumerate(starts)
    ]))
    return sums.select("position", best["start"].alias("start"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    names = docs.columns
    place = [f"c{i}" for i in range(len(names))]
    chosen = {k: place[names.index(options.pop(k, d))] for k, d in
              (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mix(docs.toDF(*place), keep=place, **chosen, **options)
    every = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("again")
    return taken.where("copies > 0").select(*place, every).select(*[F.col(p).alias(c) for p, c in zip(place, names)])


ORACLE_SQL = r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
           md5(concat('9:', coalesce(cast(doc_id as varchar), 'null'))) draw
    from documents
), placed as (
    select *, length(bin(size)) * 16 + (size >> greatest(0, length(bin(size)) - 4)) class, substr(draw, 1, 2) bucket
    from sized
), totals as (
    select source, sum(size)::bigint source_size from sized group by source
), named as (
    select *, row_number() over (order by source nulls last) - 1 position from totals
), weighed as (
    select *, case position % 3 when 0 then 5 when 1 then 2 else 1 end::bigint weight, source_size * 3 cap from named
), filled as (
    select *, row_number() over (order by cap::double / weight, position) i,
           sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, position
               rows between unbounded preceding and 1 preceding), 0) open_words,
           sum(weight) over () - coalesce(sum(weight) over (order by cap::double / weight, position
               rows between unbounded preceding and 1 preceding), 0) open_weight
    from weighed
), level as (
    select open_words, open_weight, i from filled where open_words * weight <= cap * open_weight order by i limit 1
), aimed as (
    select f.source, f.position, f.source_size,
           case when f.i < l.i then f.cap::double
                else (l.open_words * f.weight)::double / l.open_weight::double end target
    from filled f cross join level l
), ranked as (
    select p.*, a.position, a.source_size, a.target,
           case when a.source_size > 0 then a.target / a.source_size else 0.0 end epochs,
           row_number() over (partition by a.position order by p.class, p.bucket, p.draw, p.size, p.doc_id) rnk
    from placed p join aimed a on p.source is not distinct from a.source
), starts as (
    select position, j,
           ('0x' || substr(md5(concat('9:', cast(position as varchar), ':', cast(j as varchar))), 1, 8))::bigint
               / 4294967296.0::double start
    from aimed cross join range(8) t(j)
), tried as (
    select r.*, s.j, s.start, (r.size * (floor(epochs) + floor(rnk * (epochs - floor(epochs)) + start)
               - floor((rnk - 1) * (epochs - floor(epochs)) + start)))::bigint taken
    from ranked r join starts s on r.position = s.position
), nearest as (
    select position, j, row_number() over (partition by position order by abs(sum(taken) - any_value(target)), j) k
    from tried group by position, j
)
select t.doc_id, t.size, t.source_size, t.target, t.taken
from tried t join nearest n on t.position = n.position and t.j = n.j and n.k = 1
"""
