"""Catalog reports: what layers there are, their columns, extents and TileJSON."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.functions.text import url_component
from tilewright.functions.types import tilejson_type
from tilewright.model import Layer
from tilewright.operators.filters import filter_layer, predicate_column
from tilewright.plans.tiles import layer_names
from tilewright.model import TileOptions

WORLD_BOUNDS = (-180.0, -85.0, 180.0, 85.0)  # bounds of a layer without features
MAX_TILE_ZOOM = 22
CENTER_ZOOM = 6


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def layer_extent(layer: Layer, geometry: str | None = None, where: Any = None) -> DataFrame:
    """One row: extent in metres and in degrees, NULL when there are no features."""
    g = layer.geometry(geometry)
    layer = filter_layer(layer, where)
    u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
    box = layer.frame.filter(u0.isNotNull()).agg(
        F.min(u0).alias("u0"), F.min(v0).alias("v0"), F.max(u1).alias("u1"), F.max(v1).alias("v1"))
    return box.select(*_extent_columns())


def _extent_columns():
    u0, v0, u1, v1 = (F.col(c) for c in ("u0", "v0", "u1", "v1"))
    return [tm.unit_to_mx(u0).alias("minx"), tm.unit_to_my(v1).alias("miny"), tm.unit_to_mx(u1).alias("maxx"),
            tm.unit_to_my(v0).alias("maxy"), tm.unit_to_lon(u0).alias("minlon"), tm.unit_to_lat(v1).alias("minlat"),
            tm.unit_to_lon(u1).alias("maxlon"), tm.unit_to_lat(v0).alias("maxlat")]


def layer_bounds(layer: Layer, where: Any = None) -> DataFrame:
    """Bounds in degrees over all geometry columns, and the centre.

    A geometry column without features counts with the default bounds.
    """
    keep = F.lit(True) if where is None else predicate_column(layer, where)
    aggs = []
    for g in layer.geometries:
        u0, v0, u1, v1 = (F.when(keep, F.col(n)) for n in g.box_names)
        aggs += [F.min(u0).alias(f"{g.name}__u0"), F.min(v0).alias(f"{g.name}__v0"),
                 F.max(u1).alias(f"{g.name}__u1"), F.max(v1).alias(f"{g.name}__v1")]
    box = layer.frame.agg(*aggs)  # one scan for all geometry columns
    sides: dict[str, list] = {"west": [], "south": [], "east": [], "north": []}
    for g in layer.geometries:
        u0, v0, u1, v1 = (F.col(f"{g.name}__{s}") for s in ("u0", "v0", "u1", "v1"))
        for side, value, default in zip(sides, (tm.unit_to_lon(u0), tm.unit_to_lat(v1), tm.unit_to_lon(u1),
                                                tm.unit_to_lat(v0)), WORLD_BOUNDS):
            sides[side].append(F.coalesce(value, F.lit(default)))

    def fold(side, pick):
        cols = sides[side]
        return (cols[0] if len(cols) == 1 else pick(*cols)).alias(side)

    out = box.select(fold("west", F.least), fold("south", F.least), fold("east", F.greatest),
                     fold("north", F.greatest))
    return out.select("*", ((F.col("west") + F.col("east")) / 2).alias("center_lon"),
                      ((F.col("south") + F.col("north")) / 2).alias("center_lat"), F.lit(CENTER_ZOOM).alias("zoom"))


def list_catalog(layers: list[Layer]) -> DataFrame:
    """One row per layer: kind, geometry columns, row counts and extent."""
    rows = []
    for layer in layers:
        g = layer.geometry()
        columns = F.array(*[
            F.struct(F.lit(c.name).alias("name"), F.lit(c.srid).alias("srid"), F.lit(c.kind).alias("type"),
                     F.lit(c.dimensions).alias("dimensions")) for c in layer.geometries])
        u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
        counted = layer.frame.agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(u0.isNull()).alias("null_geometries"),
            F.min(u0).alias("u0"), F.min(v0).alias("v0"), F.max(u1).alias("u1"), F.max(v1).alias("v1"))
        rows.append(counted.select(
            F.lit(layer.schema).alias("schema_name"), F.lit(layer.name).alias("table_name"),
            F.lit(layer.id).alias("id"), F.lit(layer.kind).alias("type"), columns.alias("geometry_columns"),
            "row_count", "null_geometries", *_extent_columns()[4:]))
    return _union(rows).orderBy("schema_name", "table_name")


def describe_layers(layers: list[Layer]) -> DataFrame:
    """One row per geometry column: type, SRID, fields and descriptions, with counts from the data."""
    rows = []
    for layer in layers:
        fields = _map({n: t.simpleString() for n, t in layer.fields.items()})
        names = layer_names(layer, TileOptions())
        counted = layer.frame.agg(*[F.count(F.col(g.box("u0"))).alias(g.name) for g in layer.geometries])
        for ordinal, g in enumerate(layer.geometries):
            label = names[g.name]
            rows.append(counted.select(
                F.lit(layer.schema).alias("schema_name"), F.lit(layer.name).alias("table_name"),
                F.lit(ordinal).alias("ordinal"), F.lit(g.name).alias("geometry_column"),
                F.lit(g.kind).alias("geometry_type"), F.lit(g.srid).alias("srid"),
                F.lit(g.dimensions).alias("dimensions"), fields.alias("fields"),
                F.coalesce(F.lit(g.comment), F.lit(layer.comment),
                           F.lit(f"Vector layer {label} ({g.kind})")).alias("description"),
                F.col(f"`{g.name}`").alias("geometry_count")))
    return _union(rows)


def field_map(layers: list[Layer], names: list[str] | None = None) -> DataFrame:
    """``id, column_name, data_type, tilejson_type, non_null_count`` of the attributes of many layers."""
    rows = []
    for layer in layers:
        if names is not None and layer.name not in names:
            continue
        fields = layer.fields
        counted = layer.frame.agg(*[F.count(f"`{n}`").alias(n) for n in fields])
        entries = [F.struct(F.lit(layer.id).alias("id"), F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"),
                            F.lit(t.simpleString()).alias("data_type"),
                            F.lit(tilejson_type(t)).alias("tilejson_type"), F.col(f"`{n}`").alias("non_null_count"))
                   for i, (n, t) in enumerate(fields.items())]
        rows.append(counted.select(F.inline(F.array(*entries))))
    return _union(rows)


def _map(values: dict[str, str]):
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tilejson(layers: list[Layer], base_url: str, where: Any = None) -> DataFrame:
    """One TileJSON 3.0.0 document per layer, as struct fields and as text."""
    rows = []
    for layer in layers:
        names = layer_names(layer, TileOptions())
        fields = _map({n: tilejson_type(t) for n, t in layer.fields.items()})
        vector_layers = F.array(*[
            F.struct(F.lit(names[g.name]).alias("id"),
                     F.lit(g.comment or layer.comment or f"Vector layer {names[g.name]} ({g.kind})").alias("description"),
                     F.lit(0).alias("minzoom"), F.lit(MAX_TILE_ZOOM).alias("maxzoom"), fields.alias("fields"))
            for g in layer.geometries])
        url = F.lit(f"{base_url}/tiles/{layer.id}/{{z}}/{{x}}/{{y}}")
        if where is not None:
            text = json.dumps(where, separators=(",", ":"), default=str)
            url = F.concat(url, F.lit("?where="), url_component(F.lit(text)))
        description = layer.comment or f"Spatial catalog layer for {layer.id}"
        rows.append(layer_bounds(layer, where).select(
            F.lit("3.0.0").alias("tilejson"), F.lit(layer.id).alias("name"), F.lit(description).alias("description"),
            F.lit("1.0.0").alias("version"), F.lit("xyz").alias("scheme"), F.lit(0).alias("minzoom"),
            F.lit(MAX_TILE_ZOOM).alias("maxzoom"), F.array("west", "south", "east", "north").alias("bounds"),
            F.array("center_lon", "center_lat", F.col("zoom").cast("double")).alias("center"),
            F.array(url).alias("tiles"), vector_layers.alias("vector_layers")))
    documents = _union(rows)
    return documents.withColumn("document", F.to_json(F.struct(*documents.columns)))
