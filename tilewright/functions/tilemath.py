"""Web-mercator tile arithmetic as Columns.

Positions are kept as *unit coordinates*: ``u`` runs 0..1 from west to east and
``v`` runs 0..1 from north to south over the square web-mercator world. The
position in tiles at zoom ``z`` is ``u * 2^z``; multiplying by a power of two is
exact, so a feature is placed consistently at every zoom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WORLD = 20037508.342789244  # half the width of the EPSG:3857 world, metres
MAX_LAT = 85.0511  # latitude limit of a tile lookup
MAX_ZOOM = 30  # deepest tile address
MAX_POINT_ZOOM = 22  # deepest zoom of a point lookup
DEFAULT_SRID = 4326
SUPPORTED_SRIDS = (4326, 3857)


def tiles_across(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def normal_srid(srid: Column, default: int = DEFAULT_SRID) -> Column:
    """A missing or zero SRID means the configured default."""
    return F.when(srid.isNull() | (srid == 0), F.lit(default)).otherwise(srid)


def unit_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def _stretched(lat: Column) -> Column:
    """Mercator ordinate of a latitude in radians: finite and symmetric up to and at both poles."""
    phi = F.radians(F.when(lat.isNotNull(), F.least(F.abs(lat), F.lit(90.0))))  # least alone would turn null into 90
    return F.signum(lat) * F.log(F.tan(phi) + 1.0 / F.cos(phi))


def unit_y(lat: Column) -> Column:
    return (1.0 - _stretched(lat) / math.pi) / 2.0


def unit_x_of(x: Column, srid: int) -> Column:
    return unit_x(x) if srid == 4326 else x / (2.0 * WORLD) + 0.5


def unit_y_of(y: Column, srid: int) -> Column:
    return unit_y(y) if srid == 4326 else 0.5 - y / (2.0 * WORLD)


def unit_to_lon(u: Column) -> Column:
    return u * 360.0 - 180.0


def unit_to_lat(v: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * v))))


def unit_to_mx(u: Column) -> Column:
    return (u - 0.5) * (2.0 * WORLD)


def unit_to_my(v: Column) -> Column:
    return (0.5 - v) * (2.0 * WORLD)


def mercator_x(lon: Column) -> Column:
    return lon * (WORLD / 180.0)


def mercator_y(lat: Column) -> Column:
    return _stretched(lat) * (WORLD / math.pi)


def lon_of_mercator(x: Column) -> Column:
    return x * (180.0 / WORLD)


def lat_of_mercator(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y * (math.pi / WORLD))))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def point_tile(lat: Column, lon: Column, zoom: Column) -> Column:
    """STRUCT<z,x,y>: the one tile that holds a point."""
    z = clamp(F.floor(zoom), F.lit(0), F.lit(MAX_POINT_ZOOM)).cast("int")
    across = tiles_across(z)
    lat = clamp(lat, F.lit(-MAX_LAT), F.lit(MAX_LAT))
    lon = clamp(lon, F.lit(-180.0), F.lit(180.0))
    last = across - 1.0
    x = clamp(F.floor(unit_x(lon) * across).cast("double"), F.lit(0.0), last)
    y = clamp(F.floor(unit_y(lat) * across).cast("double"), F.lit(0.0), last)
    return F.struct(z.alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def tile_lonlat_box(z: Column, x: Column, y: Column) -> Column:
    """STRUCT<west,south,east,north> in degrees."""
    across = tiles_across(z)
    return F.struct(
        unit_to_lon(x / across).alias("west"),
        unit_to_lat((y + 1) / across).alias("south"),
        unit_to_lon((x + 1) / across).alias("east"),
        unit_to_lat(y / across).alias("north"),
    )


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """STRUCT<minx,miny,maxx,maxy> in EPSG:3857 metres."""
    across = tiles_across(z)
    return F.struct(
        unit_to_mx(x / across).alias("minx"),
        unit_to_my((y + 1) / across).alias("miny"),
        unit_to_mx((x + 1) / across).alias("maxx"),
        unit_to_my(y / across).alias("maxy"),
    )


def tile_pixel(unit: Column, z: Column, index: Column, extent: int) -> Column:
    """Position inside a tile on its integer grid (y grows downwards)."""
    return F.rint((unit * tiles_across(z) - index) * F.lit(float(extent))).cast("int")


def first_tile(unit_low: Column, z: Column) -> Column:
    """Lowest tile index touched; a shared edge belongs to both tiles."""
    return F.greatest(F.ceil(unit_low * tiles_across(z)) - 1, F.lit(0)).cast("int")


def last_tile(unit_high: Column, z: Column) -> Column:
    across = tiles_across(z)
    return F.least(F.floor(unit_high * across), (across - 1).cast("bigint")).cast("int")


def tile_number(z: Column, x: Column, y: Column) -> Column:
    """All tiles of all zooms counted through, zoom by zoom and row by row: one BIGINT per address."""
    across = tiles_across(z).cast("bigint")
    before = F.call_function("div", across * across - 1, F.lit(3))
    return before + y.cast("bigint") * across + x


def curve_place(u: Column, v: Column) -> Column:
    """Place of a unit position along a space-filling curve: the bits of both coordinates in turn, 16 of each."""

    def spread(unit: Column) -> Column:
        bits = F.floor(clamp(unit, F.lit(0.0), F.lit(1.0)) * 65535.0).cast("bigint")
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = F.shiftleft(bits, step).bitwiseOR(bits).bitwiseAND(F.lit(mask).cast("bigint"))
        return bits

    return F.when(u.isNotNull() & v.isNotNull(), F.shiftleft(spread(v), 1).bitwiseOR(spread(u)))


def box_touches_tile(u0, v0, u1, v1, z: Column, x: Column, y: Column) -> Column:
    """Inclusive overlap of a unit box with a tile (no buffer)."""
    across = tiles_across(z)
    return (u1 * across >= x) & (u0 * across <= x + 1) & (v1 * across >= y) & (v0 * across <= y + 1)


def home_zoom(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """Deepest zoom at which a box is no wider and no higher than a tile."""
    size = F.greatest(u1 - u0, v1 - v0)
    fits = F.floor(-F.log2(F.greatest(size, F.lit(0.5**MAX_ZOOM))))
    return F.greatest(fits, F.lit(0)).cast("int")


def ancestor(index: Column, z: Column, at: Column) -> Column:
    """Column or row at zoom ``at`` of the tile that holds a tile of zoom ``z``."""
    return F.floor(index / tiles_across(z - at)).cast("int")


def address_problem(z: Column, x: Column, y: Column) -> Column:
    """Reason a tile address is refused, NULL when it is good."""
    across = tiles_across(F.least(z, F.lit(MAX_ZOOM)))
    return (
        F.when(z.isNull() | x.isNull() | y.isNull(), "not an integer")
        .when((z < 0) | (z > MAX_ZOOM), "zoom out of range")
        .when((x < 0) | (x >= across), "x out of range")
        .when((y < 0) | (y >= across), "y out of range")
    )
