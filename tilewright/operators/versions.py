"""Dataset versions folded from a log of ``set`` and ``bump`` events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import strip


def after_bumps(base: Column, bumps: Column) -> Column:
    """Version text after ``bumps`` steps from a set value.

    A number grows by the bumps. From any other text its leading whole number
    is taken, 1 when there is none or it is zero.
    """
    whole, fraction = base.rlike(r"^-?\d+$"), base.rlike(r"^-?\d+\.\d+$")
    lead = F.regexp_extract(base, r"^\s*([+-]?\d+)", 1)
    number = F.coalesce(F.when(lead != "", lead).cast("bigint"), F.lit(0).cast("bigint"))
    number = F.when(whole, F.when(whole, base).cast("bigint")).when(number == 0, 1).otherwise(number)
    plain = (number + bumps).cast("string")
    real = (F.when(fraction, base).cast("double") + bumps).cast("string")
    return F.when(bumps == 0, base).when(fraction, real).otherwise(plain)


def fold_versions(events: DataFrame, default: str | int = 1) -> DataFrame:
    """``layer, version`` after all events ``seq, layer, op, v``.

    Only the last set of a layer and the bumps after it matter, so the ordered
    fold is two aggregations with partial sums and no ordered list per layer.
    """
    log = events.select("seq", F.lower(strip(F.col("layer"))).alias("layer"), "op", "v")
    last = log.filter(F.col("op") == "set").groupBy("layer").agg(
        F.max("seq").alias("set_seq"), F.max_by("v", "seq").alias("set_v"))
    told = log.join(last, "layer", "left")
    later = (F.col("op") == "bump") & (F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq")))
    folded = told.groupBy("layer").agg(F.count_if(later).alias("bumps"), F.max("set_v").alias("set_v"))
    base = F.coalesce("set_v", F.lit(str(default)))
    return folded.select("layer", after_bumps(base, F.col("bumps")).alias("version"))


def invalidated_keys(published: DataFrame, versions: DataFrame) -> DataFrame:
    """Published ``layer, tile_key`` rows whose key carries an outdated dataset version."""
    current = versions.select("layer", F.col("version").alias("current_version"))
    told = published.withColumn("layer", F.lower(strip(F.col("layer")))).join(current, "layer")
    held = F.regexp_extract("tile_key", r":d(.*?):z\d+:x\d+:y\d+:q", 1)
    return told.withColumn("held_version", held).filter(held != F.col("current_version"))
