"""Features of a layer as GeoJSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geojson import geometry_struct
from tilewright.model import Layer, LayerError
from tilewright.operators.filters import filter_layer

MAX_FEATURES = 200


def feature_text(layer: Layer) -> Column:
    """One GeoJSON Feature; properties keep their NULLs."""
    names = [f"`{n}`" for n in layer.fields]
    properties = F.struct(*names) if names else F.from_json(F.lit("{}"), "struct<>")
    body = F.struct(F.lit("Feature").alias("type"), geometry_struct(layer.geometry()).alias("geometry"),
                    properties.alias("properties"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def geojson_lines(layer: Layer, where: Any = None) -> DataFrame:
    """All features with a geometry, one GeoJSON text per row, next to their attributes."""
    layer = filter_layer(layer, where)
    g = layer.geometry()
    present = layer.frame.filter(F.col(g.box("u0")).isNotNull())
    return present.select(*[f"`{n}`" for n in layer.fields], feature_text(layer).alias("feature"))


def features(layer: Layer, where: Any = None, limit: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """The first features in the order of the attributes, at most ``limit`` of 1 to 200."""
    if not 1 <= limit <= MAX_FEATURES:
        raise LayerError(f"limit must be between 1 and {MAX_FEATURES}")
    order = order_by or list(layer.fields)
    return geojson_lines(layer, where).orderBy(*[F.col(f"`{n}`").asc() for n in order]).limit(limit)


def feature_collection(layer: Layer, where: Any = None, limit: int = 50,
                       order_by: list[str] | None = None) -> DataFrame:
    """The same features as one FeatureCollection text with ``total_returned``."""
    order = order_by or list(layer.fields)
    entry = F.struct(*[f"`{n}`" for n in order], "feature")
    gathered = features(layer, where, limit, order).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["feature"]), ",").alias("body"),
        F.count(F.lit(1)).alias("total_returned"))
    return gathered.select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit('],"total_returned":'),
                 F.col("total_returned").cast("string"), F.lit("}")).alias("collection"), "total_returned")
