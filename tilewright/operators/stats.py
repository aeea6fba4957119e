"""Attribute statistics of a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tilewright.model import Layer, LayerError

MAX_TOP = 50
SKETCH_BITS = 14  # log2 of the registers of a distinct-count sketch: errors of about 0.8 %


def _column(layer: Layer, column: str) -> str:
    for name in (column, column.lower()):
        if name in layer.fields:
            return name
    raise LayerError(f"column {column!r} does not exist on {layer.id}")


def _check_top(k: int) -> None:
    if not 1 <= k <= MAX_TOP:
        raise LayerError(f"k must be between 1 and {MAX_TOP}")


def attribute_summary(layer: Layer, column: str) -> DataFrame:
    """Rows, non-null rows, distinct values and smallest and largest text of one column."""
    values = _frequencies(layer, [_column(layer, column)])
    return _summaries(values)


def top_values(layer: Layer, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values without NULL; ties by value."""
    _check_top(k)
    name = _column(layer, column)
    c = _plain(F.col(f"`{name}`"), layer.fields[name])
    return (layer.frame.filter(c.isNotNull()).groupBy(c.alias("val")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("val")).limit(k))


def profile_layer(layer: Layer, approximate: bool = False) -> DataFrame:
    """Summary of every attribute column in one pass over the layer.

    ``approximate`` is for wide and large layers: distinct values are estimated by sketches of fixed size, which merge
    before the shuffle, so no value is shuffled; all else stays exact.
    """
    if not approximate:
        return _summaries(_frequencies(layer, list(layer.fields)))
    sketches = column_sketches(layer)
    return sketches.select("column_name", "total_rows", "non_null_count",
                           F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0).cast("bigint")).alias("distinct_count"),
                           "min_val", "max_val")


def column_sketches(layer: Layer, by: list[str] | None = None) -> DataFrame:
    """``by.., column_name, total_rows, non_null_count, sketch, min_val, max_val`` of every attribute column.

    ``sketch`` is a distinct-count sketch; ``merged_distinct`` joins those of several groups or days.
    """
    by, fields = by or [], layer.fields
    names = [n for n in fields if n not in by]
    measures = [F.count(F.lit(1)).alias("_rows")]
    for i, n in enumerate(names):
        text = _as_text(F.col(f"`{n}`"), fields[n])
        measures += [F.count(text).alias(f"_n{i}"), F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"_s{i}"),
                     F.min(text).alias(f"_a{i}"), F.max(text).alias(f"_z{i}")]
    wide = layer.frame.groupBy(*[F.col(f"`{b}`") for b in by]).agg(*measures)
    rows = [F.struct(F.lit(n).alias("column_name"), F.col("_rows").alias("total_rows"), F.col(f"_n{i}").alias("non_null_count"),
                     F.col(f"_s{i}").alias("sketch"), F.col(f"_a{i}").alias("min_val"), F.col(f"_z{i}").alias("max_val"))
            for i, n in enumerate(names)]
    return wide.select(*by, F.inline(F.array(*rows)))


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """``column_name, distinct_count`` over all groups of ``column_sketches``."""
    return sketches.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))


def profile_top_values(layer: Layer, k: int = 20) -> DataFrame:
    """The most frequent values, as text, of every attribute column."""
    _check_top(k)
    counted = _frequencies(layer, list(layer.fields)).filter(F.col("val").isNotNull())
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("val"))
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _plain(c: Column, dtype: T.DataType) -> Column:
    """The value with one zero: -0.0 and 0.0 are the same number."""
    return F.when(c == 0, F.lit(0).cast(dtype)).otherwise(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c


def _as_text(c: Column, dtype: T.DataType) -> Column:
    c = _plain(c, dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _frequencies(layer: Layer, names: list[str]) -> DataFrame:
    """``column_name, val, n``: how often each value, as text, occurs in each column.

    The count is the first aggregation, so that a frequent value is combined
    before the shuffle and distinct values need no second pass.
    """
    fields = layer.fields
    entries = [F.struct(F.lit(n).alias("column_name"), _as_text(F.col(f"`{n}`"), fields[n]).alias("val"))
               for n in names]
    return (layer.frame.select(F.inline(F.array(*entries)))
            .groupBy("column_name", "val").agg(F.count(F.lit(1)).alias("n")))


def _summaries(counted: DataFrame) -> DataFrame:
    here = F.col("val").isNotNull()
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0).cast("bigint")).alias("non_null_count"),
        F.count("val").alias("distinct_count"),
        F.min("val").alias("min_val"),
        F.max("val").alias("max_val"),
    )
