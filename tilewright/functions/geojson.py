"""GeoJSON text as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import tilemath as tm
from tilewright.model import GeometryColumn

DIGITS = 9  # decimals of a coordinate

# fixed values: GeoJSON type names
TYPE_NAMES = {
    "POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon",
}


def geometry_struct(g: GeometryColumn) -> Column:
    """STRUCT<type, coordinates> in EPSG:4326 for the kind of the column."""

    def position(p: Column) -> Column:
        lon, lat = p["x"], p["y"]
        if g.srid == 3857:
            lon, lat = tm.lon_of_mercator(lon), tm.lat_of_mercator(lat)
        return F.array(F.round(lon, DIGITS), F.round(lat, DIGITS))

    parts = F.col(g.name)["parts"]

    def ring(r: Column) -> Column:
        return F.transform(r, position)

    nested = {
        "POINT": lambda: position(parts[0][0][0]),
        "MULTIPOINT": lambda: F.transform(parts, lambda part: position(part[0][0])),
        "LINESTRING": lambda: ring(parts[0][0]),
        "MULTILINESTRING": lambda: F.transform(parts, lambda part: ring(part[0])),
        "POLYGON": lambda: F.transform(parts[0], ring),
        "MULTIPOLYGON": lambda: F.transform(parts, lambda part: F.transform(part, ring)),
    }[g.kind]()
    return F.struct(F.lit(TYPE_NAMES[g.kind]).alias("type"), nested.alias("coordinates"))


def geometry_text(g: GeometryColumn) -> Column:
    return F.when(F.col(g.name).isNotNull(), F.to_json(geometry_struct(g)))
