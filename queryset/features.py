from __future__ import annotations

from queryset.fixtures import duck, layer
from queryset.registry import query
from tilewright.operators import features as ops
from tilewright.operators import stats


def _number(c: str) -> str:
    return f"cast({c} + 0 as varchar)" if c.startswith("round") else f"cast({c} as varchar)"  # no minus zero


def _string(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


POINT_FEATURE = f"""concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', {_number('round(lon, 9)')}, ',',
 {_number('round(lat, 9)')}, ']}},"properties":{{"id":', {_number('id')}, ',"name":', {_string('name')}, ',"segment":',
 {_string('segment')}, ',"balance":', {_number('balance')}, ',"code":', {_string('code')}, ',"active":', {_number('active')},
 ',"srid":', {_number('srid')}, '}}}}')"""
LINE_FEATURE = f"""concat('{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[', {_number('round(lon0, 9)')}, ',',
 {_number('round(lat0, 9)')}, '],[', {_number('round(lon1, 9)')}, ',', {_number('round(lat1, 9)')}, ']]}},"properties":{{"id":',
 {_number('id')}, ',"status":', {_string('status')}, ',"price":', {_number('price')}, ',"placed":"',
 strftime(placed, '%Y-%m-%dT%H:%M:%S.000'), '"}}}}')"""
AREA_FEATURE = f"""concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[', w, ',', s, '],[', e, ',', s, '],[', e, ',',
 n, '],[', w, ',', n, '],[', w, ',', s, ']]]}},"properties":{{"id":', {_number('id')}, ',"name":', {_string('name')},
 ',"balance":', {_number('balance')}, '}}}}')"""
AREA_ROWS = f"""(select id, name, balance, {_number('round(west, 9)')} as w, {_number('round(south, 9)')} as s,
 {_number('round(east, 9)')} as e, {_number('round(north, 9)')} as n from supplier_area) a"""
WHERE = ["and", ["=", "active", True], ["in", "segment", ["MACHINERY", "HOUSEHOLD"]]]
WHERE_SQL = "lon is not null and active and segment in ('MACHINERY','HOUSEHOLD')"


@query("features_geojson", f"""{duck('customer_pt')} select id, {POINT_FEATURE} as feature from customer_pt
where {WHERE_SQL} order by id limit 50""")
def features_geojson(spark, sf):
    """The feature itself returns the first 50 of a filtered layer."""
    return ops.features(layer(spark, sf, "customer_pt"), WHERE, 50, ["id"]).select("id", "feature")


@query("feature_collection", f"""{duck('customer_pt')}
select concat('{{"type":"FeatureCollection","features":[', string_agg(feature, ',' order by id), '],"total_returned":',
 cast(count(*) as varchar), '}}') as collection, count(*) as total_returned from (
 select id, {POINT_FEATURE} as feature from customer_pt where {WHERE_SQL} order by id limit 200) q""")
def feature_collection(spark, sf):
    return ops.feature_collection(layer(spark, sf, "customer_pt"), WHERE, 200, ["id"])


@query("geojson_points", f"{duck('customer_pt')} select id, {POINT_FEATURE} as feature from customer_pt where lon is not null")
def geojson_points(spark, sf):
    return ops.geojson_lines(layer(spark, sf, "customer_pt")).select("id", "feature")


@query("geojson_lines", f"{duck('order_line')} select id, {LINE_FEATURE} as feature from order_line")
def geojson_lines(spark, sf):
    return ops.geojson_lines(layer(spark, sf, "order_line")).select("id", "feature")


@query("geojson_areas", f"{duck('supplier_area')} select id, {AREA_FEATURE} as feature from {AREA_ROWS}")
def geojson_areas(spark, sf):
    return ops.geojson_lines(layer(spark, sf, "supplier_area")).select("id", "feature")


def summary_sql(source: str, columns: list[str]) -> str:
    one = " union all ".join(
        f"""select '{c}' as column_name, count(*) as total_rows, count({c}) as non_null_count,
 count(distinct {c}) as distinct_count, min(cast({c} as varchar)) as min_val, max(cast({c} as varchar)) as max_val
from {source}""" for c in columns)
    return f"{duck(source)} {one}"


@query("attr_summary", summary_sql("lineitem_pt", ["quantity"]))
def attr_summary(spark, sf):
    return stats.attribute_summary(layer(spark, sf, "lineitem_pt"), "quantity")


@query("attr_top_values", f"""{duck('customer_pt')} select segment as val, count(*) as n from customer_pt
where segment is not null group by segment order by n desc, val limit 20""")
def attr_top_values(spark, sf):
    return stats.top_values(layer(spark, sf, "customer_pt"), "segment")


@query("attr_top_quantities", f"""{duck('lineitem_pt')} select quantity as val, count(*) as n from lineitem_pt
where quantity is not null group by quantity order by n desc, val limit 10""")
def attr_top_quantities(spark, sf):
    return stats.top_values(layer(spark, sf, "lineitem_pt"), "quantity", 10)


CUSTOMER_COLUMNS = ["id", "name", "segment", "balance", "code", "active", "srid"]


@query("profile_layer", summary_sql("customer_pt", CUSTOMER_COLUMNS))
def profile_layer(spark, sf):
    return stats.profile_layer(layer(spark, sf, "customer_pt"))


@query("profile_lineitem", summary_sql("lineitem_pt", ["id", "flag", "quantity", "shipped"]))
def profile_lineitem(spark, sf):
    return stats.profile_layer(layer(spark, sf, "lineitem_pt"))


TOP_SQL = " union all ".join(f"select '{c}' as column_name, cast({c} as varchar) as val from customer_pt"
                             for c in CUSTOMER_COLUMNS)


@query("profile_top_values", f"""{duck('customer_pt')}
select column_name, val, n, cast(rank as int) as rank from (
 select *, row_number() over (partition by column_name order by n desc, val) as rank from (
  select column_name, val, count(*) as n from ({TOP_SQL}) s where val is not null group by column_name, val) c) r
where rank <= 20""")
def profile_top_values(spark, sf):
    return stats.profile_top_values(layer(spark, sf, "customer_pt"))
