from __future__ import annotations

from pyspark.sql import functions as F

from queryset.fixtures import WORLD, duck, layer, table
from queryset.registry import query
from tilewright.functions.text import catalog_schema_of, catalog_table_of
from tilewright.model import TileOptions
from tilewright.plans import catalog as plans
from tilewright.plans.tiles import layer_names
from tilewright.sources.tables import register, save_layer, scan_catalog
from tilewright.streaming.runs import work_folder

NAMES = ["customer_multi", "customer_pt", "lineitem_pt", "order_line", "supplier_area"]
ALL = duck("customer_pt", "customer_multi", "lineitem_pt", "order_line", "supplier_area")
EXTENT = ("minx", "miny", "maxx", "maxy")
DEGREES = ("minlon", "minlat", "maxlon", "maxlat")


def _layers(spark, sf):
    """Register the layers as views and find them again through the session catalog."""
    for name in NAMES:
        register(layer(spark, sf, name))
    return [found for found in scan_catalog(spark, "public") if found.name in NAMES]


def _rounded(frame, *keep):
    return frame.select(*keep, *[F.round(c, 3).alias(c) for c in EXTENT], *[F.round(c, 9).alias(c) for c in DEGREES])


def my(lat: str) -> str:
    return f"ln(tan(pi()/4 + radians({lat})/2))*{WORLD}/pi()"


def extent_sql(source: str, sides: tuple[str, str, str, str], where: str = "true") -> str:
    w, s, e, n = sides
    return f"""select round(min({w})*{WORLD}/180, 3) as minx, round({my(f'min({s})')}, 3) as miny,
 round(max({e})*{WORLD}/180, 3) as maxx, round({my(f'max({n})')}, 3) as maxy, round(min({w}), 9) as minlon,
 round(min({s}), 9) as minlat, round(max({e}), 9) as maxlon, round(max({n}), 9) as maxlat
from {source} where {where}"""


@query("layer_extent", f"{duck('order_line')} {extent_sql('order_line', ('lon0', 'lat0', 'lon1', 'lat1'))}")
def layer_extent(spark, sf):
    return _rounded(plans.layer_extent(layer(spark, sf, "order_line")))


@query("layer_extent_filtered", f"""{duck('customer_pt')}
{extent_sql('customer_pt', ('lon', 'lat', 'lon', 'lat'), "lon is not null and segment = 'MACHINERY'")}""")
def layer_extent_filtered(spark, sf):
    return _rounded(plans.layer_extent(layer(spark, sf, "customer_pt"), where=["=", "segment", "MACHINERY"]))


@query("layer_extent_empty", f"""{duck('customer_pt')}
select coalesce(min(lon), -180.0) as west, coalesce(min(lat), -85.0) as south, coalesce(max(lon), 180.0) as east,
 coalesce(max(lat), 85.0) as north, (coalesce(min(lon), -180.0)+coalesce(max(lon), 180.0))/2 as center_lon,
 (coalesce(min(lat), -85.0)+coalesce(max(lat), 85.0))/2 as center_lat, 6 as zoom
from (select cast(lon as double) as lon, lat from customer_pt where name = 'nobody') q""")
def layer_extent_empty(spark, sf):
    return plans.layer_bounds(layer(spark, sf, "customer_pt"), ["=", "name", "nobody"])


@query("layer_bounds", f"""{duck('customer_pt', 'customer_multi')}
select round(west, 9) as west, round(south, 9) as south, round(east, 9) as east, round(north, 9) as north,
 round((west+east)/2, 9) as center_lon, round((south+north)/2, 9) as center_lat, 6 as zoom
from (select min(least(lon, west)) as west, min(least(lat, south)) as south, max(greatest(lon, east)) as east,
 max(greatest(lat, north)) as north from customer_multi where lon is not null) q""")
def layer_bounds(spark, sf):
    b = plans.layer_bounds(layer(spark, sf, "customer_multi"))
    return b.select(*[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north", "center_lon", "center_lat")], "zoom")


GEOMETRIES = {
    "customer_multi": [("geom", "POINT"), ("area", "POLYGON")], "customer_pt": [("geom", "POINT")],
    "lineitem_pt": [("geom", "POINT")], "order_line": [("geom", "LINESTRING")], "supplier_area": [("geom", "POLYGON")],
}
SIDES = {
    "customer_multi": ("lon", "lat", "lon", "lat"), "customer_pt": ("lon", "lat", "lon", "lat"),
    "lineitem_pt": ("lon", "lat", "lon", "lat"), "order_line": ("lon0", "lat0", "lon1", "lat1"),
    "supplier_area": ("west", "south", "east", "north"),
}
FIELDS = {
    "customer_pt": [("id", "bigint"), ("name", "string"), ("segment", "string"), ("balance", "double"), ("code", "string"),
                    ("active", "boolean"), ("srid", "int")],
    "lineitem_pt": [("id", "bigint"), ("flag", "string"), ("quantity", "double"), ("shipped", "timestamp_ntz")],
    "order_line": [("id", "bigint"), ("status", "string"), ("price", "double"), ("placed", "timestamp_ntz")],
    "supplier_area": [("id", "bigint"), ("name", "string"), ("balance", "double")],
}
FIELDS["customer_multi"] = FIELDS["customer_pt"]
TILEJSON_TYPE = {"bigint": "Number", "double": "Number", "int": "Number", "boolean": "Boolean"}


def _geometry_list(name: str) -> str:
    items = "|".join(f"{g}:4326:{t}:2" for g, t in GEOMETRIES[name])
    return f"'{items}'"


CATALOG_SQL = " union all ".join(f"""
select 'public' as schema_name, '{n}' as table_name, 'public.{n}' as id, 'view' as type, {_geometry_list(n)} as geometries,
 count(*) as row_count, count_if({SIDES[n][0]} is null) as null_geometries, round(min({SIDES[n][0]}), 9) as minlon,
 round(min(case when {SIDES[n][0]} is not null then {SIDES[n][1]} end), 9) as minlat, round(max({SIDES[n][2]}), 9) as maxlon,
 round(max(case when {SIDES[n][0]} is not null then {SIDES[n][3]} end), 9) as maxlat from {n}""" for n in NAMES)


@query("catalog_list", f"{ALL} {CATALOG_SQL}")
def catalog_list(spark, sf):
    items = F.array_join(F.transform("geometry_columns", lambda g: F.concat_ws(
        ":", g["name"], g["srid"].cast("string"), g["type"], g["dimensions"].cast("string"))), "|")
    rows = plans.list_catalog(_layers(spark, sf))
    return rows.select("schema_name", "table_name", "id", "type", items.alias("geometries"), "row_count",
                       "null_geometries", *[F.round(c, 9).alias(c) for c in DEGREES])


DATABASE_SQL = " union all ".join(f"""
select '{db}' as schema_name, '{n}' as table_name, '{db}.{n}' as id, '{kind}' as type, count(*) as row_count,
 count_if({SIDES[of][0]} is null) as null_geometries, round(min({SIDES[of][0]}), 9) as minlon, round(max({SIDES[of][2]}), 9) as maxlon
from {of} where {where}""" for db, n, kind, of, where in (
    ("atlas_areas", "rich", "view", "supplier_area", "balance > 0"), ("atlas_areas", "supplier_area", "table", "supplier_area", "true"),
    ("atlas_points", "customer_pt", "table", "customer_pt", "true")))


@query("catalog_databases", f"{ALL} {DATABASE_SQL}")
def catalog_databases(spark, sf):
    """Tables and a view of two databases, saved and found again."""
    for database, name in (("atlas_points", "customer_pt"), ("atlas_areas", "supplier_area")):
        made = layer(spark, sf, name)
        spark.sql(f"drop database if exists {database} cascade")
        spark.sql(f"create database {database} location '{work_folder(made.frame, database)}'")
        save_layer(made, f"{database}.{name}")
    spark.sql("create view atlas_areas.rich as select * from atlas_areas.supplier_area where balance > 0")
    found = [x for x in scan_catalog(spark) if x.schema.startswith("atlas_")]
    return plans.list_catalog(found).select("schema_name", "table_name", "id", "type", "row_count", "null_geometries",
                                            *[F.round(c, 9).alias(c) for c in ("minlon", "maxlon")])


def _label(n: str, g: str) -> str:
    return f"{n}_{g}" if len(GEOMETRIES[n]) > 1 else n


SCHEMA_SQL = " union all ".join(f"""
select '{n}' as table_name, {i} as ordinal, '{g}' as geometry_column, '{t}' as geometry_type, 4326 as srid, 2 as dimensions,
 '{",".join(f"{c}:{ty}" for c, ty in FIELDS[n])}' as fields,
 'Vector layer {_label(n, g)} ({t})' as description, count_if({SIDES[n][0]} is not null) as geometry_count from {n}"""
                               for n in NAMES for i, (g, t) in enumerate(GEOMETRIES[n]))


@query("catalog_schema", f"{ALL} {SCHEMA_SQL}")
def catalog_schema(spark, sf):
    text = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    rows = plans.describe_layers(_layers(spark, sf))
    return rows.select("table_name", "ordinal", "geometry_column", "geometry_type", "srid", "dimensions",
                       text.alias("fields"), "description", "geometry_count")


def _fields_sql(names: list[str]) -> str:
    return " union all ".join(f"""
select 'public.{n}' as id, {i} as ordinal, '{c}' as column_name, '{t}' as data_type,
 '{TILEJSON_TYPE.get(t, "String")}' as tilejson_type, count({c}) as non_null_count from {n}"""
                              for n in names for i, (c, t) in enumerate(FIELDS[n]))


@query("catalog_fields", f"{ALL} {_fields_sql(['customer_pt', 'order_line'])}")
def catalog_fields(spark, sf):
    return plans.field_map(_layers(spark, sf), ["customer_pt", "order_line"])


@query("tilejson_fields", f"{ALL} select id, column_name, tilejson_type, non_null_count from ({_fields_sql(NAMES)}) f")
def tilejson_fields(spark, sf):
    return plans.field_map(_layers(spark, sf)).select("id", "column_name", "tilejson_type", "non_null_count")


@query("catalog_resolve", """
select id, case when instr(id, '.') > 0 then regexp_extract(id, '^([^.]*)\\.', 1) else 'public' end as schema_name,
 case when instr(id, '.') > 0 then regexp_extract(id, '^[^.]*\\.(.*)$', 1) else id end as table_name, n
from (select case event_id % 3 when 0 then concat('s', cast(user_id as varchar), '.', event_type)
   when 1 then event_type else concat('a.', event_type, '.x') end as id, count(*) as n from events group by all) q""")
def catalog_resolve(spark, sf):
    i = F.col("event_id") % 3
    name = F.when(i == 0, F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("."), "event_type")).when(
        i == 1, F.col("event_type")).otherwise(F.concat(F.lit("a."), "event_type", F.lit(".x")))
    ids = table(spark, sf, "events").groupBy(name.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.select("id", catalog_schema_of(F.col("id")).alias("schema_name"),
                      catalog_table_of(F.col("id")).alias("table_name"), "n")


@query("layer_names", f"""{duck('customer_pt', 'customer_multi')}
select * from (select 'default' as asked, 'geom' as geometry_column, 'customer_multi_geom' as layer_name, count(lon) as n from customer_multi
 union all select 'default', 'area', 'customer_multi_area', count(lon) from customer_multi
 union all select 'custom', 'geom', 'mine_geom', count(lon) from customer_multi
 union all select 'custom', 'area', 'mine_area', count(lon) from customer_multi
 union all select 'custom one', 'area', 'mine', count(lon) from customer_multi
 union all select 'one', 'area', 'customer_multi_area', count(lon) from customer_multi
 union all select 'single', 'geom', 'customer_pt', count(lon) from customer_pt) q""")
def layer_names_query(spark, sf):
    multi, single = layer(spark, sf, "customer_multi"), layer(spark, sf, "customer_pt")
    cases = [("default", multi, TileOptions()), ("custom", multi, TileOptions(layer_name="mine")),
             ("custom one", multi, TileOptions(layer_name="mine", geometry="area")),
             ("one", multi, TileOptions(geometry="area")), ("single", single, TileOptions())]
    out = None
    for label, made, options in cases:
        names = layer_names(made, options)
        entries = [F.struct(F.lit(label).alias("asked"), F.lit(g).alias("geometry_column"), F.lit(n).alias("layer_name"),
                            F.col(f"n_{g}").alias("n")) for g, n in names.items()]
        counted = made.frame.agg(*[F.count(made.geometry(g).box("u0")).alias(f"n_{g}") for g in names])
        rows = counted.select(F.inline(F.array(*entries)))
        out = rows if out is None else out.unionByName(rows)
    return out


def _tilejson_sql(n: str, sides: tuple[str, str, str, str], where: str, comment: str | None) -> str:
    w, s, e, n_ = sides
    url = f"http://tiles.example/tiles/public.{n}/{{z}}/{{x}}/{{y}}?where=%5B%22%3E%22%2C%22balance%22%2C100%5D"
    about = comment or f"Spatial catalog layer for public.{n}"
    layers = ",".join(f"{_label(n, g)}={comment or f'Vector layer {_label(n, g)} ({t})'}=0=22" for g, t in GEOMETRIES[n])
    return f"""select '3.0.0' as tilejson, 'public.{n}' as name, '{about}' as description, '1.0.0' as version, 'xyz' as scheme,
 0 as minzoom, 22 as maxzoom, round(min({w}), 9) as west, round(min({s}), 9) as south, round(max({e}), 9) as east,
 round(max({n_}), 9) as north, round((min({w})+max({e}))/2, 9) as center_lon, round((min({s})+max({n_}))/2, 9) as center_lat,
 '{url}' as url, '{layers}' as vector_layers,
 '{",".join(f"{c}:{TILEJSON_TYPE.get(t, 'String')}" for c, t in FIELDS[n])}' as fields from {n} where {where}"""


@query("tilejson", f"""{duck('customer_pt', 'customer_multi', 'supplier_area')}
{_tilejson_sql('customer_multi', ('west', 'south', 'east', 'north'), 'lon is not null and balance > 100', None)} union all
{_tilejson_sql('customer_pt', SIDES['customer_pt'], 'lon is not null and balance > 100', None)} union all
{_tilejson_sql('supplier_area', SIDES['supplier_area'], 'balance > 100', 'Areas served')}""")
def tilejson(spark, sf):
    layers = [layer(spark, sf, n) for n in ("customer_multi", "customer_pt", "supplier_area")]
    docs = plans.tilejson(layers, "http://tiles.example", [">", "balance", 100])
    side = {n: F.round(F.col("bounds")[i], 9).alias(n) for i, n in enumerate(("west", "south", "east", "north"))}
    fields = F.array_join(F.transform(F.map_entries(F.col("vector_layers")[0]["fields"]),
                                      lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    named = F.array_join(F.transform("vector_layers", lambda v: F.concat_ws(
        "=", v["id"], v["description"], v["minzoom"].cast("string"), v["maxzoom"].cast("string"))), ",")
    return docs.select("tilejson", "name", "description", "version", "scheme", "minzoom", "maxzoom", *side.values(),
                       F.round(F.col("center")[0], 9).alias("center_lon"), F.round(F.col("center")[1], 9).alias("center_lat"),
                       F.col("tiles")[0].alias("url"), named.alias("vector_layers"), fields.alias("fields"))


@query("url_component", """
select event_id, replace(replace(replace(replace(replace(url_encode(t), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')'), '%21', '!') as encoded
from (select event_id, concat(event_type, ' = ''', props, '''!(~*) + ', cast(value as varchar)) as t from events) q""")
def url_component_query(spark, sf):
    from tilewright.functions.text import url_component
    text = F.concat("event_type", F.lit(" = '"), "props", F.lit("'!(~*) + "), F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", url_component(text).alias("encoded"))
