"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

All documents of a source have the same expected number of copies, its target over its size. They are put in order of
size, so that the copies spread evenly over short and long documents, and the expected copies are summed up along that
order. After one random offset is added, a document is taken once for each whole number that its step crosses.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.frames import stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = 7
NAMES = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source (``source``, ``source_size``) its ``target``; sums of sizes in, one row per source out.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``most`` times its source's size. In
    order of size for weight, the level of the free sources rises with each source that stops and falls after the last
    of them, so the highest level is the settled one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sizes.withColumn("weight", cycle)
            .withColumn("room", most * F.col("source_size") / F.col("weight"))
            .withColumn("level", (F.sum("source_size").over(whole)
                                  - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                        / F.sum("weight").over(rest))
            .withColumn("free", F.max("level").over(whole))
            .select("source", "source_size",
                    F.when(F.col("room") < F.col("free"), (most * F.col("source_size")).cast("double"))
                    .otherwise(F.col("weight") * F.col("free")).alias("target")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED,
                size: Column | None = None) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` of each row.

    ``docs`` has ``doc_id``, ``source`` and, unless ``size`` is given, ``text``. Null texts have size 0; a null source is
    a source; null ids come first; repeated rows each count; an empty table gives no rows. A source without words has
    target 0 and its rows no copies. Other columns are kept, whatever their names; ones with the four names give way. The
    rank in a source comes from range partitions and their counts, so no source is gathered in one task.
    """
    mixed = _mixed(docs, weights, most, seed, size)
    kept = [F.col(f"mix_doc.`{c}`").alias(c) for c in docs.columns if c not in NAMES]
    return mixed.select(*kept, *NAMES)


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, size: Column | None) -> DataFrame:
    """``mix_doc``, the whole row, and the four columns of ``mix_sources``."""
    salt = F.monotonically_increasing_id()  # splits equal rows, which are interchangeable
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"), "doc_id", "source",
                        (word_count() if size is None else size).alias("mix_size"))
    placed = (sized.withColumn("mix_salt", salt)
              .repartitionByRange(F.col("source").asc_nulls_last(), F.col("mix_size").desc(), F.col("doc_id"), F.col("mix_salt"))
              .sortWithinPartitions(F.col("source").asc_nulls_last(), F.col("mix_size").desc(), F.col("doc_id"),
                                    F.col("mix_salt"))
              .drop("mix_salt", "doc_id").withColumn("mix_row", F.monotonically_increasing_id())
              .withColumn("mix_part", F.shiftright("mix_row", 33)))
    placed = stored(placed, "mix")
    runs = placed.groupBy("source", "mix_part").agg(
        F.min("mix_row").alias("first"), F.count("*").alias("n"), F.sum("mix_size").alias("size"))
    runs = stored(runs, "mix-runs")
    earlier = Window.partitionBy("source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = runs.select("source", "mix_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    targets = source_targets(runs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    known = ranks.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select(
        F.col("r.source").alias("mix_source"), F.col("mix_part").alias("mix_of"), "shift",
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    offset = F.lit(random.Random(seed).random())
    rank, step = F.col("mix_row") + F.col("shift"), F.try_divide("mix_target", "mix_source_size")
    copies = F.floor((rank + 1) * step + offset) - F.floor(rank * step + offset)
    return (placed.join(known, F.expr("mix_part = mix_of and source <=> mix_source"))
            .select("mix_doc", "mix_size", "mix_source_size", "mix_target",
                    F.least(F.coalesce(copies, F.lit(0)), F.lit(most)).cast("int").alias("mix_copies")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; edge cases as in ``mix_sources``."""
    mixed = _mixed(docs, weights, most, seed, None)
    return mixed.select(F.explode(F.array_repeat("mix_doc", F.col("mix_copies"))).alias("mix_doc")).select("mix_doc.*")


OFFSET_SQL = repr(random.Random(SEED).random())
MIX_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double weight from s),
r as (select *, 3 * source_size / weight room from w),
l as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by room, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by room, encode(source) nulls last rows between current row and unbounded following) lvl from r),
f as (select *, max(lvl) over () free from l),
t as (select source, source_size, case when room < free then (3 * source_size)::double else weight * free end target from f),
k as (select d.*, t.source_size, t.target, row_number() over (partition by d.source order by size desc, doc_id nulls first) - 1 rank
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (case when source_size = 0 then 0 else size * least(3,
    floor((rank + 1) * (target / source_size) + {OFFSET_SQL}::double) - floor(rank * (target / source_size) + {OFFSET_SQL}::double)) end)::bigint taken from k
"""
