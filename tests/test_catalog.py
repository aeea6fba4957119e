from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from queryset.fixtures import layer
from tilewright.functions.text import split_catalog_id
from tilewright.functions.types import tilejson_type, type_bucket
from tilewright.model import LayerError, TileOptions
from tilewright.operators.features import feature_collection, features
from tilewright.operators.publish import missing_tiles, tile_etags, tile_keys
from tilewright.operators.stats import attribute_summary, column_sketches, merged_distinct, profile_layer, top_values
from tilewright.plans.catalog import layer_bounds, tilejson
from tilewright.plans.tiles import get_or_make, tile_pyramid
from tilewright.sources import sinks
from tilewright.sources.layers import as_layer, with_points
from tilewright.sources.tables import bbox_filter, open_layer, save_layer, scan_catalog


def test_ids_split():
    assert split_catalog_id("buildings") == ("public", "buildings")
    assert split_catalog_id("a.b.c") == ("a", "b.c")


def test_saved_layer_opens_again(spark, sf):
    made = layer(spark, sf, "order_line")
    spark.sql("create database if not exists maps")
    save_layer(made, "maps.roads", files=4)
    again = open_layer(spark, "maps.roads")
    assert again.geometries == made.geometries and list(again.fields) == list(made.fields) and again.kind == "table"
    assert again.frame.count() == made.frame.count()
    near = bbox_filter(again, 0.5, 0.25, 0.75, 0.5)
    assert near.count() == bbox_filter(made, 0.5, 0.25, 0.75, 0.5).count()
    assert "PushedFilters: [IsNotNull(geom_u1)" in near._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(LayerError):
        open_layer(spark, "maps.nothing")


def test_types(spark):
    schema = spark.createDataFrame([], "a string, b decimal(5,1), c boolean, d timestamp, e array<int>, f map<string,int>").schema
    assert [type_bucket(f.dataType) for f in schema] == ["string", "numeric", "boolean", "datetime", "unknown", "unknown"]
    assert [tilejson_type(f.dataType) for f in schema] == ["String", "Number", "Boolean", "String", "String", "String"]


def test_empty_layer_has_world_bounds(spark, sf):
    b = layer_bounds(layer(spark, sf, "customer_pt"), ["=", "name", "nobody"]).first()
    assert (b.west, b.south, b.east, b.north, b.zoom) == (-180.0, -85.0, 180.0, 85.0, 6)


def test_tilejson_is_json(spark, sf):
    doc = json.loads(tilejson([layer(spark, sf, "customer_multi")], "http://t").first().document)
    assert [v["id"] for v in doc["vector_layers"]] == ["customer_multi_geom", "customer_multi_area"]
    assert doc["tiles"] == ["http://t/tiles/public.customer_multi/{z}/{x}/{y}"] and len(doc["bounds"]) == 4


def test_collection_is_json(spark, sf):
    made = layer(spark, sf, "supplier_area")
    doc = json.loads(feature_collection(made, None, 5, ["id"]).first().collection)
    assert doc["total_returned"] == 5 and [f["properties"]["id"] for f in doc["features"]] == [0, 1, 2, 3, 4]
    assert doc["features"][0]["geometry"]["type"] == "Polygon"
    for limit in (0, 201):
        with pytest.raises(LayerError):
            features(made, limit=limit)


def test_statistics_check_their_arguments(spark, sf):
    made = layer(spark, sf, "customer_pt")
    with pytest.raises(LayerError):
        attribute_summary(made, "nothing")
    with pytest.raises(LayerError):
        top_values(made, "segment", 51)


def test_sinks(spark, sf, tmp_path):
    made = layer(spark, sf, "customer_pt")
    tiles = tile_pyramid(made, 0, 2)
    sinks.write_tiles(tiles, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles")).filter("layer = 'customer_pt' and z = 1")
    assert back.count() == tiles.filter("z = 1").count()
    sinks.write_geojson(made, str(tmp_path / "geojson"))
    lines = spark.read.text(str(tmp_path / "geojson")).collect()
    assert len(lines) == made.frame.filter("geom is not null").count() and json.loads(lines[0][0])["type"] == "Feature"


def test_keys(spark):
    base = {"catalog_id": " Public.Roads ", "version": None, "z": 1, "x": 1, "y": 0, "where": None, "properties": None,
            "tenant_id": None}
    cases = [base, {**base, "properties": "b, a,,b"}, {**base, "properties": "a,b"}, {**base, "where": " x = 1 "},
             {**base, "where": "x = 1"}, {**base, "tenant_id": " t9 "}, {**base, "version": "v2"}, {**base, "where": "  "}]
    schema = ("catalog_id string, version string, z int, x int, y int, `where` string, properties string, tenant_id string")
    rows = [tuple(c.values()) for c in cases]
    keys = [r.tile_key for r in tile_keys(spark.createDataFrame(rows, schema)).collect()]
    assert keys[0] == "mvt:v1:public.roads:d1:z1:x1:y0:q44136fa355b3678a" == keys[7]
    assert keys[1] == keys[2] != keys[0] and keys[3] == keys[4] != keys[0]
    assert keys[5].endswith(":tt9") and ":dv2:" in keys[6]


def test_etag_of_an_empty_tile(spark, sf):
    tiles = tile_pyramid(layer(spark, sf, "customer_pt"), 0, 0).withColumn("tile", F.lit(b""))
    assert tile_etags(tiles).first().etag == 'W/"0-empty"'


def test_missing(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "tile_key string")
    held = spark.createDataFrame([("b",)], "tile_key string")
    assert [r.tile_key for r in missing_tiles(asked, held).collect()] == ["a"]


def test_bare_names_and_databases(spark, sf):
    points, areas = layer(spark, sf, "customer_pt"), layer(spark, sf, "supplier_area")
    save_layer(points, "own_points")
    assert open_layer(spark, "own_points").id == f"{spark.catalog.currentDatabase()}.own_points"
    spark.sql("create database if not exists other")
    save_layer(areas, "other.own_points")
    spark.sql("create or replace view other.some as select * from other.own_points where balance > 0")
    assert open_layer(spark, "other.own_points").geometry().kind == "POLYGON"
    kinds = {x.id: x.kind for x in scan_catalog(spark) if "own_points" in x.id or x.name == "some"}
    assert kinds == {"default.own_points": "table", "other.own_points": "table", "other.some": "view"}
    areas.frame.createOrReplaceTempView("own_points")
    assert open_layer(spark, "own_points").id == "public.own_points"  # a temporary view comes first
    spark.catalog.dropTempView("own_points")


def test_files_are_clustered_in_both_directions(spark, sf):
    made = layer(spark, sf, "lineitem_pt")
    save_layer(made, "clustered", files=16)
    files = open_layer(spark, "clustered").frame.groupBy(F.input_file_name()).agg(*[
        f(f"geom_{c}0").alias(f"{n}{c}") for c in "uv" for n, f in (("a", F.min), ("z", F.max))]).collect()
    for c in "uv":
        assert len(files) >= 12 and sum(r[f"a{c}"] <= 0.3 and r[f"z{c}"] >= 0.28 for r in files) <= len(files) * 0.6


def test_zero_counts_once(spark):
    frame = spark.createDataFrame([(-0.0, 1.0), (0.0, 1.0), (1.5, 1.0), (None, 1.0), (float("nan"), 1.0)], "v double, lon double")
    made = as_layer(with_points(frame.withColumn("lat", F.lit(2.0)), "lon", "lat"), "zeros", drop=("lon", "lat"))
    assert attribute_summary(made, "v").first().distinct_count == 3
    assert top_values(made, "v").first().n == 2


def test_sketches_are_close_and_merge(spark, sf):
    made = layer(spark, sf, "lineitem_pt")
    exact = {r.column_name: r for r in profile_layer(made).collect()}
    about = {r.column_name: r for r in profile_layer(made, approximate=True).collect()}
    for name, want in exact.items():
        got = about[name]
        assert abs(got.distinct_count - want.distinct_count) <= 0.02 * want.distinct_count + 1
        assert (got.total_rows, got.non_null_count, got.min_val, got.max_val) == (
            want.total_rows, want.non_null_count, want.min_val, want.max_val)
    merged = {r.column_name: r.distinct_count for r in merged_distinct(column_sketches(made, ["flag"])).collect()}
    assert set(merged) == set(exact) - {"flag"} and abs(merged["id"] - exact["id"].distinct_count) <= 0.02 * exact["id"].distinct_count


def test_id_column_is_part_of_the_key(spark, sf):
    made = layer(spark, sf, "customer_pt")
    asked = spark.createDataFrame([(0, 0, 0)], "z int, x int, y int")
    none = spark.createDataFrame([], "tile_key string, layer string, z int, x int, y int, part int, n_parts int, tile binary, "
                                     "n_features bigint, keys array<string>")
    keys = {get_or_make(made, asked, none, options=o).first().tile_key for o in (
        TileOptions(), TileOptions(id_column="id"), TileOptions(id_column="code"), TileOptions(properties=("code",)),
        TileOptions(properties=("code",), id_column="id"))}
    assert len(keys) == 5
